"""Policies, episodes, splits and metrics on small inputs."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import episodes as ep
from tidemark.operators import bars, metrics, models, validation
from tidemark.operators import policy as po
from tidemark.operators import ticks as ti
from tidemark.sources.tables import clean_json, synthetic_ticks

BASE = {"price_range_bp": 0.1, "tick_travel_bp": 0.1, "trade_rate_s": 10.0, "quote_volume_s": 10_000.0, "book_churn_s": 100.0, "imbalance_delta": 0.02}
EVENT = {"price_range_bp": 1.0, "tick_travel_bp": 1.0, "trade_rate_s": 10.0, "quote_volume_s": 100.0, "book_churn_s": 10.0, "imbalance_delta": 0.1}


def _ticks(spark, n, **changes):
    rows = []
    for i in range(n):
        row = dict.fromkeys(po.ALL, 0.0)
        for name, values in changes.items():
            row[name] = float(values.get(i, 0.0))
        rows.append((i * 250, 100.0, 0.1, *(row[s] for s in po.ALL)))
    return spark.createDataFrame(rows, "ts_ms long, mid double, imbalance double, " + ", ".join(f"fast_{s} double" for s in po.ALL))


def _decide(spark, ticks, transform="sqrt_excess", tau=1400.0, gain=0.8, events=None):
    rows = po.variant_rows((tau,), (gain,), (transform,), {"balanced": po.WEIGHTS["balanced"]}, {"balanced": po.RESPONSES["balanced"]})
    events = events or {s: BASE[s] * 10 for s in po.ALL}
    row = {f"base_{k}": v for k, v in BASE.items()} | {f"event_{k}": v for k, v in events.items()}
    calibration = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))
    return po.simulate(po.energised(ticks, po.variants(spark, rows), calibration, 250)).orderBy("ts_ms").collect()


def test_heat_decays_and_quiet_is_slow(spark):
    got = _decide(spark, _ticks(spark, 12, price_range_bp={0: 2}, tick_travel_bp={0: 2}), "log_excess", 2000.0, 2.0)
    assert got[0].heat > got[-1].heat
    assert {r.interval_ms for r in _decide(spark, _ticks(spark, 10))} == {5000}


def test_speed_up_takes_a_snapshot(spark):
    [*_, r, _] = _decide(spark, _ticks(spark, 6, price_range_bp={4: 0.8}, tick_travel_bp={4: 0.8}), "log_excess", 2000.0, 9.0)
    assert r.snapshot == 1 and r.reason == "speedup"


def test_shocks_and_release(spark):
    r = _decide(spark, _ticks(spark, 60, price_range_bp={4: 1.2}))
    assert (r[4].interval_ms, r[4].snapshot, r[4].price_shock, r[4].reason) == (800, 1, 1, "price_shock+speedup")
    assert all(x.interval_ms >= 2500 for x in r[20:])
    events = EVENT | {"trade_rate_s": 50.0, "book_churn_s": 300.0}
    r = _decide(spark, _ticks(spark, 6, trade_rate_s={4: 50}, book_churn_s={4: 300}), events=events)
    assert r[4].interval_ms <= 1500 and r[4].snapshot == 1 and r[4].micro_shock == 1 and r[4].confluence == 1


def test_noise_below_the_dead_zone_is_ignored(spark):
    r = _decide(spark, _ticks(spark, 50, book_churn_s=dict.fromkeys(range(4, 21), 120)))
    assert max(x.heat for x in r) < 0.05 and {x.interval_ms for x in r} == {5000}


def test_grid_of_variants():
    rows = po.variant_rows()
    assert len(rows) == 480 and len({r["variant"] for r in rows}) == 480
    assert [r["ordinal"] for r in po.shuffled(rows, 1, 5)] == list(range(5)) and po.shuffled(rows, 1) == po.shuffled(rows, 1)


def test_registered_sweep_is_the_whole_grid():
    from tidemark.plans import study_plans as sp

    assert [r["variant"] for r in sp.ROWS] == [r["variant"] for r in po.variant_rows()] and len(sp._one()) == 1


def _truth(spark, n, **changes):
    ticks = _ticks(spark, n, **changes)
    marked = ep.tiers(ticks, EVENT)
    strong = ep.episodes(marked, ep.Rules())
    return ticks, strong, ep.lone_episodes(marked, strong, ep.Rules())


def _fixed(spark, n, interval, snapshot):
    return spark.createDataFrame([("v", i * 250, interval(i), int(snapshot(i))) for i in range(n)], "variant string, ts_ms long, interval_ms long, snapshot int")


def test_tiers_merge_within_the_gap(spark):
    _, strong, lone = _truth(spark, 40, price_range_bp={4: 2}, trade_rate_s={7: 20}, book_churn_s={7: 20, 20: 20})
    assert [(r.tier, r.points) for r in strong.collect()] == [("A", 2)] and [r.start_ms for r in lone.collect()] == [5000]


def test_next_event_stops_the_clock(spark):
    ticks, strong, lone = _truth(spark, 60, price_range_bp={4: 2, 16: 2})
    got = {r.start_ms: (r.how, r.oversampling_ms) for r in ep.oversampling(strong, _fixed(spark, 60, lambda i: 800, lambda i: i % 4 == 0), ep.Rules(), ["variant"]).collect()}
    assert got == {1000: ("next", 3000), 4000: ("censored", None)}


def test_tier_c_is_no_gate(spark):
    ticks, strong, lone = _truth(spark, 80, price_range_bp={4: 2}, trade_rate_s={30: 20}, book_churn_s={30: 20, 60: 20})
    interval = lambda i: {4: 800, 30: 1500}.get(i, 5000)
    m = ep.evaluate(ticks, _fixed(spark, 80, interval, lambda i: interval(i) <= 1500), strong, lone, ep.Rules(), ["variant"]).first()
    assert m.tier_c_recall == 0 and "tier_c_recall" not in m.checks and m.tier_a_recall == m.tier_b_recall == 1.0 and len(m.checks) == 9


def test_published_reductions(spark):
    """The published counts give the published reductions."""
    for n, kept, want in ((12_605, 3437, 0.727330), (35_105, 10_834, 0.691383)):
        decisions = spark.range(n).select(F.lit("v").alias("variant"), (F.col("id") * 1000).alias("ts_ms"), F.lit(5000).cast("long").alias("interval_ms"), (F.col("id") < kept).cast("int").alias("snapshot"))
        ticks = decisions.select("ts_ms", F.lit(1.0).alias("mid"), F.lit(0.0).alias("imbalance"), *(F.lit(0.0).alias(f"fast_{s}") for s in po.ALL))
        marked = ep.tiers(ticks, EVENT)
        strong = ep.episodes(marked, ep.Rules())
        m = ep.evaluate(ticks, decisions, strong, ep.lone_episodes(marked, strong, ep.Rules()), ep.Rules(), ["variant"]).first()
        assert (m.snapshot_count, m.base_snapshot_count) == (kept, n) and m.snapshot_reduction == pytest.approx(want, abs=1e-6)


def _plain_decisions(ticks, row, calibration, tick):
    """Heat, interval and snapshots of one policy, tick by tick."""
    import math

    heat, taken, interval, out = 0.0, None, row["interval_quiet"], []
    times = [t["ts_ms"] for t in ticks]
    for n, t in enumerate(ticks):
        dt = max(1, times[n] - times[n - 1]) if n else tick
        x = {s: t[f"fast_{s}"] / max(calibration[f"base_{s}"], 1e-9) for s in po.ALL}
        over = {f: any(x[s] > row[f"dead_{f}"] for s in names) for f, names in po.SENSORS.items()}
        high = {f: any(t[f"fast_{s}"] / calibration[f"event_{s}"] >= row["shock"] for s in names) for f, names in po.SENSORS.items()}
        both = over["flow"] and over["book"]
        energy = row["bonus"] * both
        for f, names in po.SENSORS.items():
            for s in names:
                excess = max(0.0, x[s] / row[f"dead_{f}"] - 1)
                energy += row[f"w_{s}"] * (math.sqrt(excess) if row["transform"] == "sqrt_excess" else math.log1p(excess)) * (1.0 if both or f == "price" else row["single"])
        tau = row["tau"] if over["price"] or both else max(row["least_tau"], row["tau"] * row["quiet"])
        heat = min(row["max_heat"], heat * math.exp(-dt / tau) + row["gain"] * energy * dt / row["unit_ms"])
        new = next((row[f"interval_{r}"] for r in ("extreme", "active", "normal") if heat >= row[f"heat_{r}"]), row["interval_quiet"])
        if high["price"]:
            new = min(new, row["interval_extreme"])
        elif high["flow"] and high["book"]:
            new = min(new, row["interval_active"])
        snap = taken is None or times[n] - taken >= new or new < interval
        if snap:
            taken = times[n]
        interval = new
        out.append((row["variant"], times[n], round(heat, 9), new, int(snap)))
    return out


@pytest.mark.parametrize("chunk", [1000, 7000, 10**9])
def test_policies_on_gapped_timelines_against_a_plain_loop(spark, chunk):
    import random

    rng, at, ticks = random.Random(chunk), 0, []
    for _ in range(400):
        at += rng.choice([250, 250, 250, 1, 40, 900, 6000])
        ticks.append({"ts_ms": at, "mid": 100.0, "imbalance": 0.1} | {f"fast_{s}": BASE[s] * rng.choice([0, 0.5, 1, 1.6, 4, 9]) for s in po.ALL})
    calibration = {f"base_{k}": v for k, v in BASE.items()} | {f"event_{k}": 9.5 * v for k, v in BASE.items()}
    table = spark.createDataFrame([tuple(calibration.values())], ", ".join(f"{k} double" for k in calibration))
    rows = po.variant_rows()[::67]
    line = spark.createDataFrame([tuple(t.values()) for t in ticks], "ts_ms long, mid double, imbalance double, " + ", ".join(f"fast_{s} double" for s in po.ALL)).repartition(5)
    got = po.simulate(po.energised(line, po.variants(spark, rows), table, 250), chunk_ms=chunk).collect()
    want = [d for r in rows for d in _plain_decisions(ticks, r, calibration, 250)]
    assert sorted((r.variant, r.ts_ms, round(r.heat, 9), r.interval_ms, r.snapshot) for r in got) == sorted(want)


@pytest.mark.parametrize("chunk", [700, 10**9])
def test_fixed_intervals_on_gapped_timelines(spark, chunk):
    import random

    rng, times = random.Random(3), [0, 250, 500, 750, 10_100]
    for _ in range(200):
        times.append(times[-1] + rng.choice([1, 100, 250, 400, 2600]))
    line = spark.createDataFrame([(t,) for t in times], "ts_ms long").repartition(4)
    want = set()
    for name, interval in po.FIXED.items():
        last = None
        for t in times:
            if last is None or t - last >= interval:
                last = t
                want.add((name, t))
    assert {(r.variant, r.ts_ms) for r in po.fixed(line, chunk_ms=chunk).collect() if r.snapshot} == want
    some = bars.greedy_cadence(line, 1000, chunk=chunk)
    assert {r.ts_ms for r in some.collect() if r.snapshot} == {t for n, t in want if n == "fixed-1s"}
    assert bars.greedy_cadence(line.limit(0), 1000).count() == 0


def test_evaluation_without_episodes(spark):
    ticks, strong, lone = _truth(spark, 20)
    m = ep.evaluate(ticks, _fixed(spark, 20, lambda i: 5000, lambda i: i == 0), strong, lone, ep.Rules(), ["variant"]).first()
    assert m.tier_a_recall == 1.0 and m.ab_weighted_recall == 1.0 and m.oversampling_p95_ms == 0.0


def test_calibration(spark):
    c = po.calibrate(synthetic_ticks(spark, 2400), floors={"trade_rate_s": 1000.0}).first()
    assert 2 < c.base_trade_rate_s < 4 and c.event_trade_rate_s == 1000.0 and c.event_price_range_bp > 1 and c.rows == 2400
    assert po.matches_universe({"sensorUniverse": {"spotSymbol": "A"}, "baselines": {}, "event_thresholds": {}}, {"spotSymbol": "A"})
    assert not po.matches_universe({"sensorUniverse": {"spotSymbol": "A"}, "baselines": {}, "event_thresholds": {}}, {"spotSymbol": "B"})


def test_walk_forward_keeps_the_embargo(spark):
    rows = spark.range(200).select((F.col("id") * 60_000).alias("t"), F.col("id"))
    f = validation.walk_forward_folds(rows, "t", "id", 4, 0.4, 600_000)
    got = f.groupBy("fold").agg(F.max(F.when(F.col("part") == "train", F.col("t"))).alias("a"), F.min(F.when(F.col("part") == "test", F.col("t"))).alias("b")).collect()
    assert len(got) >= 2 and all(r.a < r.b - 600_000 for r in got)
    assert validation.fold_edges(29, 4, 0.4) == [] and validation.archive_split(1) == (1, 1) and validation.archive_split(56) == (40, 42)
    small = validation.embargo_split(rows.limit(30), "t", "id", 0.2, 0)
    assert {r.part for r in small.select("part").distinct().collect()} == {"selection"}


def test_metrics_against_brute_force(spark):
    data = [(int(i * 7 % 5 < 2), round((i * 37 % 20) / 20, 2)) for i in range(60)]
    df = spark.createDataFrame(data, "label int, prob double")
    pos, neg = [p for y, p in data if y], [p for y, p in data if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(df).first()[0] == pytest.approx(auc)
    ap = sum(sum(y for y, p in data if p >= t) / sum(1 for y, p in data if p >= t) * sum(y for y, p in data if p == t) for t in {p for _, p in data}) / len(pos)
    assert metrics.average_precision(df).first()[0] == pytest.approx(ap)
    one = spark.createDataFrame([(1, 0.5)], "label int, prob double")
    assert metrics.roc_auc(one).first()[0] is None
    assert [r.signals for r in metrics.threshold_table(one, 1.0, 1.0, [0.4, 0.6]).orderBy("threshold").collect()] == [1, 0]


def test_boosting_uses_what_varies(spark):
    rows = spark.range(120).select((F.col("id") * 60_000).alias("t"), "id", F.sin(F.col("id") / 7).alias("varying"), F.lit(1.0).alias("constant"), F.lit(None).cast("double").alias("empty"), (F.sin(F.col("id") / 7) + F.sin(F.col("id")) > 0).cast("int").alias("label"))
    bundle = models.fit(rows, ["varying", "constant", "empty"], models.Params(2, 5), "t", "id")
    assert bundle.features == ["varying"]
    probs = [r.prob for r in bundle.predict(rows.limit(10)).collect()]
    assert len(probs) == 10 and all(0 <= p <= 1 for p in probs)
    assert models.historical(["spot_ob_x", "ret_5"]) == ["ret_5"]
    model, used = models.excursion_model(rows.withColumn("mfe", F.col("varying") * 3), ["varying"], "mfe")
    assert models.excursion_error(model, used, rows.withColumn("mfe", F.col("varying") * 3), "mfe") < 2
    assert models.excursion_model(rows.limit(10).withColumn("mfe", F.lit(1.0)), ["varying"], "mfe") == (None, [])


def test_json_has_no_nan():
    assert clean_json({"a": [float("nan"), 1.5], "b": float("inf")}) == {"a": [None, 1.5], "b": None}


def test_model_queries_use_every_feature_and_the_whole_grid(spark, monkeypatch):
    from tidemark.plans import model_plans as mp

    hour, n = 3_600_000, 300
    rows = spark.range(n).select(F.lit("spot").alias("channel"), (F.col("id") * hour).alias("bar_ms"), (F.col("id") % 3 == 0).cast("int").alias("label"), *(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(97)).cast("double").alias(c) for k, c in enumerate(mp.FEATURES)))
    seen = {}
    monkeypatch.setattr(mp, "training_rows", lambda spark, sf_dir: rows)
    monkeypatch.setattr(mp.models, "select_params", lambda rows, features, at, tie, grid=models.GRID: seen.setdefault("grid", tuple(grid))[-1])
    monkeypatch.setattr(mp.models, "fit", lambda rows, features, params, at, tie: seen.update(fit=(rows, list(features), params)))
    monkeypatch.setattr(mp.models, "permutation_importance", lambda bundle, rows, at, tie, repeats=3: seen.update(held=rows, repeats=repeats))
    mp.feature_importance(spark, "")
    fitted, features, params = seen["fit"]
    assert features == mp.FEATURES and params == models.GRID[2] and seen["repeats"] == 3
    assert seen["held"].count() == 60 and fitted.agg(F.max("bar_ms")).first()[0] < seen["held"].agg(F.min("bar_ms")).first()[0] - 6 * hour
    monkeypatch.setattr(mp.models, "walk_forward", lambda rows, features, params, *_: rows.selectExpr("0 as fold", "bar_ms", "label", f"{params.depth} as prob"))
    seen.clear()
    assert mp.gbt_walk_forward(spark, "").first().prob == models.GRID[2].depth and seen["grid"] == models.GRID


@pytest.mark.parametrize("step", [1, 500])
def test_sensors_of_dense_events_against_a_plain_loop(spark, monkeypatch, step):
    import random

    rng, tick, width = random.Random(step), 500, 2000
    events = [(rng.choice([rng.randrange(9000), 500 * rng.randrange(18)]), i, rng.choice([None, *(100.0 + k for k in range(9))]), float(i % 11), i % 7, i % 3 > 0) for i in range(3000)]
    rows = spark.createDataFrame(events, "ts_ms long, event_id long, price double, quote double, churn long, is_primary boolean").repartition(4)
    seen = []
    real = ti.in_chunks
    monkeypatch.setattr(ti, "in_chunks", lambda df, *a, **k: seen.append(df) or real(df, *a, **k))
    grid = ti.tick_grid(rows, tick, width)
    got = {r.ts_ms: r for r in ti.window_sensors(rows, grid, width, "x_", chunk=3000, step=step).collect()}
    prices = {r.ts_ms: r.price for r in ti.last_price(rows, grid, step).collect()}
    if step > 1:  # frames hold a row for each segment and kind of event, not for each event
        assert seen[0].count() <= 5 * len(got)
    own, before = {}, None
    for t, i, p, *_, primary in sorted(events, key=lambda e: e[:2]):
        if primary:
            own[i], before = None if p is None or before is None else abs(p - before), p
    assert sorted(got) == sorted(prices) == list(range(0, max(got) + 1, tick))
    for t, r in got.items():
        inside = sorted(e for e in events if t - width < e[0] < t)
        main = [e for e in inside if e[5]]
        known = [e[2] for e in main if e[2] is not None]
        first = main[0][2] if main else None
        way = sum(own[e[1]] or 0.0 for e in main) - ((own[main[0][1]] or 0.0) if main else 0.0)
        span = max(known) - min(known) if known else 0.0
        want = (span / first * 1e4 if first else 0.0, way / first * 1e4 if first else 0.0, sum(e[2] is not None for e in inside) / 2, sum(e[3] for e in inside) / 2, sum(e[4] for e in inside) / 2)
        assert tuple(r)[1:] == pytest.approx(want)
        assert prices[t] == max(((e[0], e[1], e[2]) for e in events if e[5] and e[2] is not None and e[0] < t), default=(None,))[-1]


def test_ticks_spread_before_policies_multiply_them(spark):
    """A few ticks in one partition become rows of every policy in several tasks."""
    calibration = spark.createDataFrame([(*BASE.values(), *EVENT.values())], ", ".join(f"{k} double" for k in (*(f"base_{s}" for s in BASE), *(f"event_{s}" for s in EVENT))))
    energy = po.energised(_ticks(spark, 200).coalesce(1), po.variants(spark, po.variant_rows()[:3]), calibration, 250)
    assert energy.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def _event_table(spark, folder, n=400):
    """A small events table of its own; some values, users and times are missing."""
    import datetime
    import random

    rng, start = random.Random(n), datetime.datetime(2024, 1, 1)
    rows = [
        (i, None if i == 7 else start + datetime.timedelta(seconds=rng.choice([900 * rng.randrange(100), rng.randrange(90_000)])), rng.choice([None, 1, 2, 3]), rng.choice(["click", "view", "purchase", "error"]), rng.choice([None, 1.5, 20.0, 77.25]), f'{{"k": {i % 9}}}')
        for i in range(n)
    ]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_timeline_reads_the_events_once(spark, tmp_path, monkeypatch):
    from tidemark.plans import study_plans as sp

    made, real = [], sp.written
    monkeypatch.setattr(sp, "written", lambda df, name: made.append(df) or real(df, name))
    line = sp.timeline(spark, _event_table(spark, tmp_path))
    reads = [df for df in (*made, line) if any("events.parquet" in f for f in df.inputFiles())]
    assert len(reads) == 1 and reads[0]._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    events = sp.trades(spark, str(tmp_path)).withColumn("is_primary", F.col("channel") == "spot")
    grid = ti.tick_grid(events, sp.TICK, sp.SLOW)
    mids = {r.ts_ms: r.price for r in ti.last_price(events, grid, sp.TICK).collect()}
    flow = {}
    for r in events.where("ts_ms is not null").collect():
        both = flow.setdefault(r.ts_ms // sp.TICK * sp.TICK + sp.TICK, [0.0, 0.0])
        both[0] += r["size"] if r.side == "Buy" else -r["size"]
        both[1] += r["size"]
    got = line.collect()
    assert {r.ts_ms: r.mid for r in got} == mids
    for r in got:
        signed, size = flow.get(r.ts_ms, (0.0, 0.0))
        assert r.imbalance == (pytest.approx(signed / size, abs=1e-6) if size else None)


def test_policies_share_frames(spark, monkeypatch):
    """Many policies are solved in a few frames, whatever their number; their decisions stay their own."""
    from tidemark.operators import chunks

    rows = po.variant_rows()[:96]
    calibration = spark.createDataFrame([(*BASE.values(), *EVENT.values())], ", ".join(f"{k} double" for k in (*(f"base_{s}" for s in BASE), *(f"event_{s}" for s in EVENT))))
    ticks = _ticks(spark, 60, price_range_bp={4: 1.2, 31: 0.7}, tick_travel_bp={4: 1.2}, book_churn_s=dict.fromkeys(range(10, 30), 160))
    monkeypatch.setattr(chunks, "SLICES", 3)
    frames, real = [], chunks.solve
    monkeypatch.setattr(chunks, "solve", lambda df, *a: frames.append(df) or real(df, *a))
    together = po.simulate(po.energised(ticks, po.variants(spark, rows), calibration, 250), chunk_ms=4000).collect()
    assert len(frames) == 2
    some = [rows[k] for k in (0, 50, 95)]
    alone = {r for row in some for r in po.simulate(po.energised(ticks, po.variants(spark, [row]), calibration, 250), chunk_ms=4000).collect()}
    names = {row["variant"] for row in some}
    assert len(together) == 60 * len(rows) and {r for r in together if r.variant in names} == alone


def _made(spark, monkeypatch, folder, query):
    """Names of the tables that a query writes on its way, in their order."""
    from tidemark.operators import policy
    from tidemark.plans import study_plans as sp

    made, real = [], sp.written
    for module in (sp, policy):
        monkeypatch.setattr(module, "written", lambda df, name: made.append(name) or real(df, name))
    monkeypatch.setattr(sp, "ROWS", sp.ROWS[::160])
    rows = sp.QUERIES[query](spark, folder).collect()
    return made, rows


def test_oversampling_makes_no_lone_episodes(spark, tmp_path, monkeypatch):
    made, rows = _made(spark, monkeypatch, _event_table(spark, tmp_path), "oversampling")
    assert made.count("episodes") == 1 and "tiers" not in made and "decisions" in made


def test_gate_counts_makes_no_errors_of_reconstruction(spark, tmp_path, monkeypatch):
    monkeypatch.delattr(ep, "reconstruction")
    made, rows = _made(spark, monkeypatch, _event_table(spark, tmp_path), "gate_counts")
    assert len(rows) == 9 and {r.n for r in rows} == {3} and made == ["segments", "timeline", "episodes", "episodes", "steered", "decisions"]


def test_fixed_baselines_make_no_errors_of_reconstruction(spark, tmp_path, monkeypatch):
    monkeypatch.delattr(ep, "reconstruction")
    made, rows = _made(spark, monkeypatch, _event_table(spark, tmp_path), "fixed_baselines")
    assert {r.variant for r in rows} == set(po.FIXED) and made == ["segments", "timeline", "episodes", "episodes", "decisions"]


@pytest.mark.parametrize("query", ["context_mask", "episodes_ab"])
def test_strong_episodes_need_no_lone_ones(spark, tmp_path, monkeypatch, query):
    monkeypatch.delattr(ep, "lone_episodes")
    assert _made(spark, monkeypatch, _event_table(spark, tmp_path), query)[0] == ["segments", "timeline", "episodes"]


@pytest.mark.parametrize("query", ["calibration_quantiles", "tier_masks"])
def test_a_timeline_read_once_is_not_written(spark, tmp_path, monkeypatch, query):
    made, rows = _made(spark, monkeypatch, _event_table(spark, tmp_path), query)
    assert made == ["segments"] and rows


def test_lone_episodes_come_of_ticks_written_once(spark, tmp_path, monkeypatch):
    made, _ = _made(spark, monkeypatch, _event_table(spark, tmp_path), "episodes_c_antijoin")
    assert made == ["segments", "timeline", "episodes", "episodes"]


@pytest.mark.parametrize("query, rows", [("policy_leaderboard", 1), ("reconstruction_mae", 3)])
def test_policies_of_a_query_are_solved_together(spark, tmp_path, monkeypatch, query, rows):
    """Two recurrences, heat and snapshots, whatever the number of policies, over events read once."""
    from tidemark.operators import chunks

    solved, real = [], chunks.solve
    monkeypatch.setattr(chunks, "solve", lambda df, *a: solved.append(df) or real(df, *a))
    made, found = _made(spark, monkeypatch, _event_table(spark, tmp_path), query)
    assert len(solved) == 2 and made.count("segments") == 1 and len(found) == rows


def test_segments_are_summed_up_by_hash(spark):
    """Of a segment's events nothing is held that must be aggregated in sorted order, one interpreted row at a time."""
    events = spark.createDataFrame([(0, 1, 2.0, 3.0, 1.0, True), (5, 2, None, 3.0, 1.0, True), (5, 0, 7.0, 1.0, 1.0, True)], "ts_ms long, event_id long, price double, quote double, churn double, is_primary boolean")
    found = ti.segments(events, 1000)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {r["__at"]: (r["__first"], r["__last"].price, r["__known"], r["__way"], r["__n"]) for r in found.collect()}
    assert rows == {0: (2.0, 2.0, 2.0, None, 1), 1: (7.0, None, 7.0, None, 1)}


def test_sizes_cut_out_of_plain_props_are_those_of_the_parser(spark, tmp_path):
    from tidemark.plans.domain import trades

    props = ['{"k": 24}', '{"k": -3}', '{"k": 0}', '{"k": 7} ', '{"k":8}', '{"k": 9, "j": 1}', '{"j": 1, "k": 2}', '{"k": "5"}', '{"k": 1.5}', '{"k": 1e3}', '{"k": 007}', '{"k": null}', '{"k": 123456789012345678}', '{"k": 4}\n', '{"k": }', "", None]
    rows = [(n, p) for n, p in enumerate(props)]
    table = spark.createDataFrame(rows, "event_id long, props string").selectExpr("event_id", "timestamp_ntz'2024-01-01' AS ts", "1L AS user_id", "'view' AS event_type", "1.0D AS value", "props")
    table.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.size for r in trades(spark, str(tmp_path)).select("event_id", F.col("size").alias("size")).collect()}
    want = {r.event_id: r.s for r in table.select("event_id", F.get_json_object("props", "$.k").cast("double").alias("s")).collect()}
    assert got == want and got[0] == 24.0 and got[1] == -3.0 and got[13] == 4.0


def test_policies_meet_the_ticks_in_frames_only(spark, monkeypatch):
    """What is solved for many policies are ticks, copied for each part of them; no row of a policy and a tick is shuffled for its heat."""
    from tidemark.operators import chunks

    rows = po.variant_rows()[:20]
    calibration = spark.createDataFrame([(*BASE.values(), *EVENT.values())], ", ".join(f"{k} double" for k in (*(f"base_{s}" for s in BASE), *(f"event_{s}" for s in EVENT))))
    ticks = _ticks(spark, 60, price_range_bp={4: 1.2, 31: 0.7}, tick_travel_bp={4: 1.2}, book_churn_s=dict.fromkeys(range(10, 30), 160))
    frames, real = [], chunks.solve
    monkeypatch.setattr(chunks, "solve", lambda df, *a: frames.append(df) or real(df, *a))
    got = po.decide(ticks, rows, calibration, 250, 4000)
    assert frames[0].count() == 60 * -(-len(rows) // po.PART) and "variant" not in frames[1].columns
    want = po.simulate(po.energised(ticks, po.variants(spark, rows), calibration, 250), chunk_ms=4000).select(*got.columns)
    assert sorted(got.collect()) == sorted(want.collect())


def test_errors_of_held_values_against_a_plain_loop(spark):
    """Values are held over chunks of time, also over some without a sample; unknown ones and prices of 0 are no errors."""
    import random

    rng = random.Random(3)
    ticks = [(250 * i, rng.choice([None, 0.0, 100.0, 101.5, 99.0]), rng.choice([None, -0.5, 0.25])) for i in range(80)]
    decisions = [(v, t, int(rng.random() < rate)) for v, rate in (("a", 0.5), ("b", 0.04), ("c", 0.0)) for t, *_ in ticks]
    d = spark.createDataFrame([*decisions, ("d", 7, 1)], "variant string, ts_ms long, snapshot int")
    found = ep.reconstruction(spark.createDataFrame(ticks, "ts_ms long, mid double, imbalance double"), d, ["variant"], 2000)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInPandas")[-1]  # frames hold the series
    want, mean = {}, lambda x: pytest.approx(sum(x) / len(x)) if x else None
    for v in "abc":
        mids, flows, held = [], [], [None, None]
        for (_, mid, flow), (_, _, taken) in zip(ticks, [x for x in decisions if x[0] == v], strict=True):
            held = [new if taken and new is not None else old for new, old in zip((mid, flow), held, strict=True)]
            mids += [abs(held[0] - mid) / mid * 1e4] if mid and held[0] is not None else []
            flows += [abs(held[1] - flow)] if flow is not None and held[1] is not None else []
        want[v] = (mean(mids), mean(flows))
    assert {r.variant: (r.mid_mae_bp, r.imbalance_mae) for r in found.collect()} == want
