"""The research protocol: candidates to a calibrated model, without looking ahead."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import metrics, models, patterns, validation
from ..operators.labels import Target, excursions, triple_barrier
from ..operators.patterns import Profile
from ..operators.store import written
from .presets import Preset


@dataclass
class Findings:
    """Reports by target, the champion's bundle, and its reports on the holdout."""

    reports: DataFrame
    thresholds: dict[str, DataFrame] = field(default_factory=dict)
    bins: dict[str, DataFrame] = field(default_factory=dict)
    champion: str | None = None
    bundle: models.Bundle | None = None
    holdout: DataFrame | None = None
    ablation: DataFrame | None = None
    importance: DataFrame | None = None
    out_of_sample: DataFrame | None = None


def candidate_table(grid: DataFrame, path: DataFrame, keys: Sequence[str], at: str, step: int, profiles: Sequence[Profile], lookbacks: Sequence[int], targets: Sequence[Target], gap: int) -> tuple[DataFrame, list[str]]:
    """Candidates with the features of their signal bar, episodes, and a label for each target; and the features' names."""
    bars = patterns.indexed(grid, keys, at)
    found = written(patterns.signal_episodes(patterns.candidates(bars, keys, at, step, profiles), keys, gap), "candidates")
    names: list[str] = []

    def make(r: fe.Rolling):
        out = fe.returns(r, lookbacks) | fe.volatility(r, lookbacks) | fe.ranges(r, lookbacks) | fe.distances(r, lookbacks) | fe.z_scores(r, "volume", lookbacks) | fe.delta_sums(r, lookbacks)
        names.extend(out)
        return out

    rows = fe.rolling(grid, keys, at, step, max(lookbacks), make, fe.one_step).withColumns(fe.calendar(at))
    names += ["ret_1", "range_bps", "tod_sin", "tod_cos", "dow_sin", "dow_cos"]
    names = list(dict.fromkeys(names))
    rows = fe.tidy(rows, names).select(*keys, F.col(at).alias("signal_ms"), *names)
    out = found.join(rows, [*keys, "signal_ms"], "left").withColumns({"direction_long": (F.col("direction") == 1).cast("int"), "formation_triple": (F.col("formation") == "triple").cast("int")})
    geometry = ["direction_long", "formation_triple", "profile_code", "dev_bps", "rebound_bps", "quality"]
    ids = [*keys, "signal_ms", "direction"]
    for t in targets:
        label = triple_barrier(found, path, keys, at, step, t).select(*ids, F.col("label").alias(t.name), F.col("outcome").alias(f"outcome_{t.name}"))
        out = written(out.join(label, ids, "left"), "labelled")
    if targets:
        reach = excursions(found, path, keys, at, step, max(t.horizon for t in targets)).select(*ids, "mfe_bps", "mae_bps", "mfe_complete")
        out = written(out.join(reach, ids, "left"), "labelled")
    return out, names + geometry


def research(table: DataFrame, features: Sequence[str], targets: Sequence[Target], preset: Preset, embargo: int, tie: str = "formation") -> Findings:
    """Selection by walk-forward folds on the first members of episodes; the holdout is read once, by the champion alone."""
    spark, at = table.sparkSession, "signal_ms"
    reports, found = [], {}
    parts = written(validation.embargo_split(table.where("is_first = 1"), at, tie, preset.holdout, embargo), "split")
    selection, held = parts.where("part = 'selection'").drop("part"), parts.where("part = 'holdout'").drop("part")
    out = Findings(spark.createDataFrame([], "target string, n long, brier double, log_loss double, roc_auc double, average_precision double"))
    for t in targets:
        own = selection.where(F.col(t.name).isNotNull()).withColumn("label", F.col(t.name))
        if own.select("label").distinct().count() < 2:
            continue
        params = models.select_params(own, features, at, tie, preset.models)
        scored = models.walk_forward(own, features, params, at, tie, preset.folds, preset.first_train, embargo)
        if scored.isEmpty():
            continue
        m = models.score_report(scored, ()).first()
        reports.append((t.name, m.n, m.brier, m.log_loss, m.roc_auc, m.average_precision))
        out.thresholds[t.name] = metrics.threshold_table(scored, t.tp, t.sl, [0.5 + 0.05 * k for k in range(9)])
        out.bins[t.name] = metrics.probability_bins(scored, preset.bins)
        found[t.name] = (t, params, scored)
    if not reports:
        return out
    out.reports = spark.createDataFrame(reports, out.reports.schema)
    out.champion = metrics.champion(out.reports, "target").first().target
    t, params, out.out_of_sample = found[out.champion]
    own = selection.where(F.col(t.name).isNotNull()).withColumn("label", F.col(t.name))
    out.bundle = models.fit(own, features, params, at, tie)
    unseen = held.where(F.col(t.name).isNotNull()).withColumn("label", F.col(t.name))
    if not unseen.isEmpty():
        out.holdout = models.score_report(out.bundle.predict(unseen), ())
        out.importance = models.permutation_importance(out.bundle, unseen, at, tie, preset.permutations)
        past = models.historical(features)
        if 5 <= len(past) < len(features):
            out.ablation = models.score_report(models.fit(own, past, params, at, tie).predict(unseen), ())
    return out


def replay(findings: Findings, grid: DataFrame, at: str) -> DataFrame:
    """The grid with the champion's out-of-sample probabilities of long and short signals."""
    from ..operators.relational import replay_pivot

    return replay_pivot(grid, findings.out_of_sample.select("signal_ms", "direction", "prob"), at)
