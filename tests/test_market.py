"""Bars, grids, as-of joins, features, formations and outcomes on small inputs."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.numeric import first_positive
from tidemark.operators import asof, bars, chunks, features, labels, patterns, relational

MIN = 60_000


def _rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy(names[0]).collect()]


def test_bars_break_ties_by_event(spark):
    t = spark.createDataFrame([("s", 5, 2, "Sell", 11.0, 1.0), ("s", 5, 1, "Buy", 10.0, 2.0), ("s", MIN, 3, "Buy", 9.0, 0.0)], "channel string, ts_ms long, event_id long, side string, price double, size double")
    got = bars.flow(bars.ohlcv(t, MIN)).orderBy("bar_ms").collect()
    assert (got[0].open, got[0].close, got[0].delta, got[0].vwap) == (10.0, 11.0, 1.0, pytest.approx(31 / 3, abs=1e-6))
    assert got[1].vwap is None and got[1].delta_ratio is None


def test_grid_is_filled_forward_only(spark):
    b = spark.createDataFrame([("s", 2 * MIN, 1.0, 2.0, 0.5, 1.5, 3, 1.0, 1.0, 1.0), ("s", 5 * MIN, 2.0, 2.0, 2.0, 2.0, 1, 1.0, 1.0, 1.0), ("p", 0, 7.0, 7.0, 7.0, 7.0, 1, 1.0, 1.0, 1.0)], "channel string, bar_ms long, open double, high double, low double, close double, n long, volume double, delta double, turnover double")
    got = asof.fill_bars(b, "bar_ms", MIN).where("channel = 's'")
    assert _rows(got, "bar_ms", "close", "volume", "missing") == [(0, None, 0.0, 1), (MIN, None, 0.0, 1), (2 * MIN, 1.5, 1.0, 0), (3 * MIN, 1.5, 0.0, 1), (4 * MIN, 1.5, 0.0, 1), (5 * MIN, 2.0, 1.0, 0)]


def test_asof_takes_equal_times_and_any_distance(spark):
    left = spark.createDataFrame([(0,), (10,), (9 * asof.DAY,)], "at long")
    right = spark.createDataFrame([(10, 1.0), (11, 2.0)], "t long, v double")
    assert _rows(asof.asof_join(left, right, "at", "t", ["v"], "r_"), "at", "r_t", "r_v") == [(0, None, None), (10, 10, 1.0), (9 * asof.DAY, 11, 2.0)]


def test_carry_and_numbers_cross_chunks(spark):
    df = spark.createDataFrame([("a", i, float(i) if i in (1, 7) else None) for i in range(10)], "k string, i long, v double")
    got = chunks.carry(df, ["k"], ["i"], F.floor(F.col("i") / 2), {"last": F.col("v")})
    assert [r.last for r in got.orderBy("i").collect()] == [None, 1, 1, 1, 1, 1, 1, 7, 7, 7]
    assert [r.n for r in chunks.numbered(df, ["k"], ["i"], F.floor(F.col("i") / 3), "n").orderBy("i").collect()] == list(range(1, 11))
    assert [r.p for r in chunks.previous(df, ["k"], ["i"], F.floor(F.col("i") / 3), "p", "v").orderBy("i").collect()] == [None, None, 1, None, None, None, None, None, 7, None]


def test_ema_in_chunks_equals_the_loop(spark):
    xs = [math.sin(i) + 2 if i % 7 else None for i in range(100)]
    df = spark.createDataFrame([("a", i * MIN, x) for i, x in enumerate(xs)], "k string, t long, x double")
    got = [r.e for r in features.ema(df, ["k"], "t", "x", 9, "e", chunk=13 * MIN).orderBy("t").collect()]
    y, want = None, []
    for x in xs:
        y = y if x is None else x if y is None else y + 0.2 * (x - y)
        want.append(y)
    assert got[0] is None and got[1:] == pytest.approx(want[1:], abs=1e-12)


def test_rolling_in_chunks_equals_one_window(spark):
    df = spark.createDataFrame([("a", i * MIN, 100 + math.sin(i), 101 + math.sin(i), 99 + math.sin(i), float(i % 5), 1.0) for i in range(200)], "k string, t long, close double, high double, low double, volume double, delta double")
    make = lambda r: features.returns(r, (5,)) | features.volatility(r, (1, 5)) | features.z_scores(r, "volume", (5,))
    small = features.rolling(df, ["k"], "t", MIN, 5, make, features.one_step, chunk=7 * MIN).orderBy("t").collect()
    large = features.rolling(df, ["k"], "t", MIN, 5, make, features.one_step, chunk=10**9).orderBy("t").collect()
    assert len(small) == 200 and [r.rv_1 for r in small] == [None] * 200
    for a, b in zip(small, large, strict=True):
        assert a.ret_5 == b.ret_5 and (a.rv_5 is None) == (b.rv_5 is None) and (a.rv_5 is None or a.rv_5 == pytest.approx(b.rv_5, abs=1e-9))


def _series(spark, lows):
    rows = [("s", i * MIN, float(x), float(i + 20), float(i + 15)) for i, x in enumerate(lows)]
    return patterns.indexed(spark.createDataFrame(rows, "k string, t long, low double, high double, close double"), ["k"], "t")


def test_pivots_are_not_backdated(spark):
    b = _series(spark, [10, 9, 8, 7, 6, 5, 6, 7, 8, 9, 10, 11, 10, 9, 8, 7, 8, 9, 10, 11])
    got = patterns.confirmed_pivots(b, ["k"], "t", MIN, 2).where("kind = 'low'").orderBy("idx").collect()
    assert [(r.idx, r.confirm_idx, r.signal_ms) for r in got] == [(5, 7, 7 * MIN), (15, 17, 17 * MIN)]


def test_double_needs_gap_tolerance_and_rebound(spark):
    b = _series(spark, [10, 9, 8, 7, 6, 5, 6, 7, 8, 9, 10, 11, 10, 9, 8, 7, 8, 9, 10, 11])
    pivots = patterns.confirmed_pivots(b, ["k"], "t", MIN, 2).where("kind = 'low'")
    dev = 2 / 6 * 1e4
    loose = patterns.Profile("x", 2, 10, 10, dev + 1e-6, 10.0)
    [d] = patterns.doubles(pivots, b, ["k"], loose).collect()
    assert (d.first_idx, d.last_idx, d.neckline, d.direction) == (5, 15, 35.0, 1) and d.dev_bps == pytest.approx(dev)
    for p in (patterns.Profile("x", 2, 11, 20, dev + 1, 10.0), patterns.Profile("x", 2, 1, 20, dev - 1, 10.0), patterns.Profile("x", 2, 1, 20, dev + 1, 1e6)):
        assert patterns.doubles(pivots, b, ["k"], p).count() == 0


def test_episodes_begin_after_the_gap(spark):
    s = spark.createDataFrame([("k", m * MIN, d, "double") for m, d in ((0, 1), (5, 1), (21, 1), (4, -1), (36, 1))], "k string, signal_ms long, direction int, formation string")
    got = patterns.signal_episodes(s, ["k"], 15 * MIN).where("direction = 1")
    assert _rows(got, "signal_ms", "is_first", "episode_id") == [(0, 1, "L0000001"), (5 * MIN, 0, "L0000001"), (21 * MIN, 1, "L0000002"), (36 * MIN, 0, "L0000002")]


def _path(spark, prices, missing=()):
    rows = [("k", i * MIN, None if i in missing else h, None if i in missing else low, None if i in missing else c, int(i in missing)) for i, (h, low, c) in enumerate(prices)]
    return spark.createDataFrame(rows, "k string, t long, high double, low double, close double, price_missing int")


def _outcome(spark, prices, direction=1, missing=(), at=0, horizon=3):
    s = spark.createDataFrame([("k", at * MIN, direction)], "k string, signal_ms long, direction int")
    [r] = labels.triple_barrier(s, _path(spark, prices, missing), ["k"], "t", MIN, labels.Target(100.0, 50.0, horizon)).collect()
    return r.outcome, r.hit_bars, r.label


def test_barriers(spark):
    flat = (100.0, 100.0, 100.0)
    assert _outcome(spark, [flat, (101.5, 99.0, 100.0), flat, flat]) == ("sl", 1, 0)  # both in one bar: the stop
    assert _outcome(spark, [flat, flat, (101.0, 100.0, 100.0), flat]) == ("tp", 2, 1)
    assert _outcome(spark, [flat, flat, (101.0, 100.0, 100.0), flat], direction=-1) == ("sl", 2, 0)
    assert _outcome(spark, [flat] * 4) == ("timeout", None, 0)
    assert _outcome(spark, [flat] * 3) == ("censored", None, None)
    assert _outcome(spark, [flat] * 4, missing=(2,)) == ("censored_gap", None, None)
    assert _outcome(spark, [flat] * 5, missing=(0,)) == ("censored", None, None)


def test_index_barrier_is_censored_at_the_end(spark):
    b = _series(spark, [float(i) for i in range(30)])
    s = spark.createDataFrame([("k", 25, 1)], "k string, idx long, direction int")
    [r] = labels.index_barrier(s, b, ["k"], labels.Target(50.0, 25.0, 10)).collect()
    assert r.label is None


def test_excursions_are_cut_not_censored(spark):
    s = spark.createDataFrame([("k", 0, 1)], "k string, signal_ms long, direction int")
    [r] = labels.excursions(s, _path(spark, [(100.0, 100.0, 100.0), (102.0, 99.0, 100.0)]), ["k"], "t", MIN, 5).collect()
    assert (r.mfe_bps, r.mae_bps, r.mfe_complete) == (pytest.approx(200), pytest.approx(100), False)


def test_gaps_and_overlaps(spark):
    b = spark.createDataFrame([("a", 0, 100), ("b", 5101, 9000), ("c", 3999, 9500), ("d", 9500, 9600)], "batch_id string, start_ms long, end_ms long")
    got = {r.batch_id: r.kind for r in relational.sequence_gaps(b, 5000).collect()}
    assert got == {"a": "ok", "c": "ok", "b": "ok", "d": "ok"}
    got = {r.batch_id: r.kind for r in relational.sequence_gaps(b, 1000).collect()}
    assert got == {"a": "ok", "c": "gap", "b": "overlap", "d": "ok"}


def test_event_time_takes_the_first_positive_number(spark):
    df = spark.createDataFrame([("0", "x", "7"), (None, "5", "7"), ("-1", None, None)], "a string, b string, c string")
    assert [r[0] for r in df.select(first_positive("a", "b", "c")).collect()] == [7, 5, None]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "channel string, bar_ms long, open double, high double, low double, close double, n long, volume double, delta double, turnover double")
    assert asof.fill_bars(empty, "bar_ms", MIN).count() == 0
    assert relational.keep_last(empty, ["channel"], ["bar_ms"]).count() == 0
