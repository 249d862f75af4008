"""Whole protocols on synthetic data, and paging."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import episodes as ep
from tidemark.operators import policy as po
from tidemark.operators.labels import Target
from tidemark.operators.patterns import Profile
from tidemark.plans import presets, research, study
from tidemark.sources import rest
from tidemark.sources.tables import synthetic_ticks

MIN = 60_000


def test_study_reads_the_holdout_only_after_a_pass(spark):
    rows = po.variant_rows((1400,), (0.8,), ("sqrt_excess",), {"balanced": po.WEIGHTS["balanced"]}, {"balanced": po.RESPONSES["balanced"], "fidelity": po.RESPONSES["fidelity"]})
    a, b = synthetic_ticks(spark, 1700, 7), synthetic_ticks(spark, 900, 19)
    none = {g: (1e9 if g in ("reaction_p95_ms", "oversampling_p95_ms", "false_fast_time") else -1e9) for g in ep.GATES}
    s = study.run_study(a, b, rows, ep.Rules(), gates=none)
    assert s.passed and s.holdout.count() == 1 and s.winner in {r["variant"] for r in rows} and s.leaderboard.count() == 2
    s = study.run_study(a, b, rows, ep.Rules(), gates=ep.GATES | {"snapshot_reduction": 2.0})
    assert not s.passed and s.holdout is None and {r.gate: r.n_passed for r in s.gates.collect()}["snapshot_reduction"] == 0


def test_research_on_sinusoids(spark):
    n = 3000
    price = lambda i: 100 + 1.2 * math.sin(i * 2 * math.pi / 180) + 0.5 * math.sin(i * 2 * math.pi / 47) + i * 1e-5
    noise = (F.pmod(F.xxhash64("i"), F.lit(1009)) / 1009.0 - 0.5) * 0.05
    base = spark.createDataFrame([(i, i * MIN, price(i)) for i in range(n)], "i long, t long, p double").withColumn("close", F.col("p") + noise)
    grid = base.select(F.lit("s").alias("k"), "t", F.col("close").alias("open"), (F.col("close") + 0.05).alias("high"), (F.col("close") - 0.05).alias("low"), "close", F.lit(1.0).alias("volume"), (F.pmod("i", F.lit(3)) - 1.0).alias("delta"))
    path = grid.select("k", "t", "high", "low", "close", F.lit(0).alias("price_missing"))
    target = Target(25, 20, 60)
    table, names = research.candidate_table(grid, path, ["k"], "t", MIN, [Profile("one", 2, 5, 240, 80, 15)], (1, 5, 15), [target], 15 * MIN)
    assert table.count() > 40 and {r[0] for r in table.select(target.name).distinct().collect()} >= {0, 1}
    p = presets.Preset((), (), (target,), 3, 0.2, 0.4, presets.MODELS[:1], 1, 5)
    found = research.research(table, ["ret_5", "dist_high_15", "dist_low_15", "rebound_bps", "direction_long"], [target], p, 60 * MIN)
    r = found.reports.first()
    assert r.n > 5 and 0 <= r.brier <= 1 and found.champion == target.name and found.bundle is not None
    assert all(0 <= x.prob <= 1 for x in found.out_of_sample.collect())
    assert research.replay(found, grid.select("t"), "t").where("p_long is not null or p_short is not null").count() > 0


def test_presets():
    assert [presets.depth_of(x) for x in (1, 14, 15, 29, 30)] == [10, 10, 20, 20, 40]
    p = presets.preset(geometry=10, features=40, outcomes=40, model_search=40)
    assert (len(p.profiles), len(p.lookbacks), len(p.targets), len(p.models), p.folds) == (2, 11, 16, 16, 5)
    assert p.targets[0].name == "tp25_sl20_h30"


def test_paging_backwards_makes_progress():
    calls = []

    def fetch(q):
        calls.append(q)
        return {"list": [[t] for t in range(5000, 0, -1000) if q["start"] <= t <= q["end"]][: q["limit"]]}

    assert rest.backwards(fetch, {}, 1000, 5000, lambda r: r[0], 2) == [[1000], [2000], [3000], [4000], [5000]] and len(calls) >= 3
    assert rest.backwards(lambda q: {"list": []}, {}, 0, 9, lambda r: r[0]) == []


def test_cursor_loops_end():
    pages = {"": ([3, 2], "a"), "a": ([2, 1], "a")}
    assert rest.by_cursor(lambda q: dict(zip(("list", "nextPageCursor"), pages[q.get("cursor", "")], strict=True)), {}, lambda r: r) == [1, 2, 3]


def test_retries():
    waits, answers = [], [{"retCode": 10, "retMsg": "slow"}, OSError("down"), {"retCode": 0, "result": {"list": [1]}}]

    def fetch(_):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert rest.with_retries(fetch, sleep=waits.append)({}) == {"list": [1]} and waits == [0.75, 1.5, 0.0]
    with pytest.raises(OSError):
        rest.with_retries(lambda _: {"retCode": 1}, attempts=2, sleep=waits.append)({})
    assert rest.run_jobs({"a": lambda: 1, "b": lambda: 1 / 0})[1].keys() == {"b"}


def test_klines(spark):
    [r] = rest.klines(spark, [["1000", "1", "2", "0.5", "1.5", "", None]], "spot", "X").collect()
    assert (r.startMs, r.high, r.volume, r.turnover) == (1000, 2.0, None, None)
