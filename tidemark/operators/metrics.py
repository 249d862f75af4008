"""Metrics of binary classifiers in columns, for any number of groups at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-15


def binary_metrics(scored: DataFrame, keys: Sequence[str] = (), label: str = "label", prob: str = "prob") -> DataFrame:
    """n, positive_rate, brier, log_loss, accuracy, precision, recall at one half."""
    y, p = F.col(label), F.col(prob)
    q = F.least(F.greatest(p, F.lit(TINY)), F.lit(1 - TINY))
    hit = p >= 0.5
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(y.cast("double")).alias("positive_rate"),
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"),
        F.avg((hit.cast("int") == y).cast("int")).alias("accuracy"),
        (F.count_if(hit & (y == 1)) / F.nullif(F.count_if(hit), F.lit(0))).alias("precision"),
        (F.count_if(hit & (y == 1)) / F.nullif(F.count_if(y == 1), F.lit(0))).alias("recall"),
    )


def _levels(scored: DataFrame, keys: Sequence[str], label: str, prob: str) -> DataFrame:
    """Positive and negative rows of each score, with those of higher scores.

    Rows are counted by score first; running counts go by a thousandth of the score range, then within it, so that a
    group of any size is spread.
    """
    at = [*keys, prob]
    per = scored.groupBy(*at).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")).withColumn("__cell", F.floor(F.col(prob) * 1000))
    cell = per.groupBy(*keys, "__cell").agg(F.sum("pos").alias("cp"), F.sum("neg").alias("cn"))
    above = Window.partitionBy(*keys).orderBy(F.desc("__cell")).rowsBetween(Window.unboundedPreceding, -1)
    cell = cell.withColumns({"__p": F.coalesce(F.sum("cp").over(above), F.lit(0)), "__n": F.coalesce(F.sum("cn").over(above), F.lit(0))}).drop("cp", "cn")
    own = Window.partitionBy(*keys, "__cell").orderBy(F.desc(prob)).rowsBetween(Window.unboundedPreceding, -1)
    joined = per.join(cell, [*keys, "__cell"])
    return joined.withColumns({"pos_above": F.col("__p") + F.coalesce(F.sum("pos").over(own), F.lit(0)), "neg_above": F.col("__n") + F.coalesce(F.sum("neg").over(own), F.lit(0))}).drop("__p", "__n", "__cell")


def roc_auc(scored: DataFrame, keys: Sequence[str] = (), label: str = "label", prob: str = "prob") -> DataFrame:
    """Area under the ROC curve, ties counting a half; null with one class only."""
    v = _levels(scored, keys, label, prob)
    wins = F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2.0))
    return v.groupBy(*keys).agg((wins / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("roc_auc"))


def average_precision(scored: DataFrame, keys: Sequence[str] = (), label: str = "label", prob: str = "prob") -> DataFrame:
    """Sum over distinct scores of precision there times the recall gained."""
    v = _levels(scored, keys, label, prob)
    got = F.col("pos_above") + F.col("pos")
    precision = got / (got + F.col("neg_above") + F.col("neg"))
    return v.groupBy(*keys).agg((F.sum(precision * F.col("pos")) / F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"))


def threshold_table(scored: DataFrame, tp: float, sl: float, thresholds: Sequence[float], keys: Sequence[str] = (), label: str = "label", prob: str = "prob") -> DataFrame:
    """For each threshold: signals at or above it, win rate, and expectancy in units of tp and sl."""
    spark = scored.sparkSession
    t = spark.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    groups = scored.select(*keys).distinct() if keys else spark.range(1).select()
    hits = scored.join(F.broadcast(t), F.col(prob) >= F.col("threshold")).groupBy(*keys, "threshold").agg(F.count(F.lit(1)).alias("signals"), F.avg(F.col(label).cast("double")).alias("win_rate"))
    out = groups.crossJoin(F.broadcast(t)).join(hits, [*keys, "threshold"], "left").withColumn("signals", F.coalesce("signals", F.lit(0)))
    return out.withColumn("expectancy", F.col("win_rate") * tp - (1 - F.col("win_rate")) * sl)


def probability_bins(scored: DataFrame, bins: int, keys: Sequence[str] = (), label: str = "label", prob: str = "prob") -> DataFrame:
    """Observed bins (right-closed, of equal width on 0 to 1, the first one with 0): rows, mean score, positive rate."""
    b = F.greatest(F.lit(1), F.ceil(F.col(prob) * bins)).cast("int").alias("bin")
    return scored.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_prob"), F.avg(F.col(label).cast("double")).alias("positive_rate"))


def champion(metrics: DataFrame, name: str, brier: str = "brier", ap: str = "average_precision") -> DataFrame:
    """The target with the highest -brier + 0.15 * average precision, of those with a finite Brier score."""
    ok = metrics.where(F.col(brier).isNotNull() & ~F.isnan(brier))
    score = -F.col(brier) + 0.15 * F.coalesce(F.col(ap), F.lit(0.0))
    return ok.agg(F.max_by(F.struct(name, score.alias("score")), F.struct(score.alias("s"), name)).alias("c")).select("c.*")


def usable_features(rows: DataFrame, names: Sequence[str]) -> list[str]:
    """Features with at least two distinct finite values in these rows, by one pass over them."""
    value = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))
    spread: list[Column] = [(F.min(value(c)) < F.max(value(c))).alias(c) for c in names]
    row = rows.agg(*spread).first()
    return [c for c in names if row[c]]
