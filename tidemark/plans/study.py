"""The sampling study: calibrate, try all policies on one part, and let only a winner that passes meet the other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import episodes as ep
from ..operators import policy as po
from ..operators.store import written


@dataclass
class Study:
    leaderboard: DataFrame
    gates: DataFrame
    winner: str
    passed: bool
    holdout: DataFrame | None
    baselines: DataFrame | None = None


def thresholds_of(calibration: DataFrame) -> dict[str, float]:
    row = calibration.first()  # one row
    return {s: row[f"event_{s}"] for s in po.ALL}


def judge(ticks: DataFrame, rows: list[dict], calibration: DataFrame, rules: ep.Rules, gates: dict[str, float] = ep.GATES) -> DataFrame:
    """Metrics of each policy on a timeline; the ground truth is made once for all of them."""
    spark = ticks.sparkSession
    marked = written(ep.tiers(ticks, thresholds_of(calibration)), "tiers")
    strong = written(ep.episodes(marked, rules), "episodes")
    lone = written(ep.lone_episodes(marked, strong, rules), "episodes")
    decisions = written(po.simulate(po.energised(ticks, po.variants(spark, rows), calibration, rules.tick), chunk_ms=rules.tick * po.CHUNK_TICKS), "decisions")
    return written(ep.evaluate(ticks, decisions, strong, lone, rules, ["variant"], gates), "metrics")


def judge_fixed(ticks: DataFrame, calibration: DataFrame, rules: ep.Rules, intervals: dict[str, int] = po.FIXED, gates: dict[str, float] = ep.GATES) -> DataFrame:
    """Metrics of sampling at fixed intervals."""
    marked = written(ep.tiers(ticks, thresholds_of(calibration)), "tiers")
    strong = written(ep.episodes(marked, rules), "episodes")
    lone = written(ep.lone_episodes(marked, strong, rules), "episodes")
    decisions = written(po.fixed(ticks, intervals, chunk_ms=rules.tick * po.CHUNK_TICKS), "decisions")
    return written(ep.evaluate(ticks, decisions, strong, lone, rules, ["variant"], gates), "metrics")


def run_study(calibration_ticks: DataFrame, holdout_ticks: DataFrame, rows: list[dict], rules: ep.Rules, floors: dict[str, float] | None = None, seed: int = 20260828, most: int | None = None, gates: dict[str, float] = ep.GATES) -> Study:
    """The holdout is not read unless the winner passed every gate on the calibration part."""
    tried = po.shuffled(rows, seed, most)
    calibration = written(po.calibrate(calibration_ticks, floors=floors), "calibration")
    plain = [{k: v for k, v in r.items() if k != "ordinal"} for r in tried]
    metrics = judge(calibration_ticks, plain, calibration, rules, gates)
    order = metrics.sparkSession.createDataFrame([(r["variant"], r["ordinal"]) for r in tried], "variant string, ordinal int")
    ranked = metrics.join(F.broadcast(order), "variant")
    best = po.winner(ranked).first()
    holdout = judge(holdout_ticks, [r for r in plain if r["variant"] == best.variant], calibration, rules, gates) if best["pass"] else None
    top = ranked.orderBy(F.desc("pass"), F.desc("tier_a_snapshot_recall"), F.desc("tier_b_snapshot_recall"), F.desc("ab_weighted_recall"), F.asc("oversampling_p95_ms"), F.asc("ordinal")).limit(20)
    return Study(top, ep.gate_report(metrics), best.variant, best["pass"], holdout, judge_fixed(calibration_ticks, calibration, rules, gates=gates))
