"""Queries on splits, classifier metrics and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import features as fe
from ..operators import labels, metrics, models, validation
from ..operators.store import written
from .domain import BARS, HOUR, hourly, hourly_grid, r6, table
from .market import price_path

DAY = 86_400_000


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir).select("channel", "bar_ms", "n", "close")


def embargo_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.embargo_split(_rows(spark, sf_dir), "bar_ms", "channel", 0.2, 6 * HOUR)


def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validation.walk_forward_folds(_rows(spark, sf_dir), "bar_ms", "channel", 5, 0.4, 6 * HOUR)
    return out.select("fold", "part", "channel", "bar_ms")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a made-up score that knows a little of them."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    both = table(spark, sf_dir, "labels").join(d, "doc_id")
    noise = F.pmod(F.col("doc_id") * 7919 + F.col("n_chars"), F.lit(1009)) / 1009.0
    prob = F.floor((0.7 * noise + 0.25 * F.col("quality") + 0.01) * 200) / 200.0 + 0.0025
    return both.select("doc_id", F.pmod(F.col("doc_id"), F.lit(3)).alias("target"), F.col("quality").alias("label"), prob.alias("prob"))


def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.binary_metrics(_scored(spark, sf_dir), ["target"])
    return out.select("target", "n", *(rounded(c).alias(c) for c in ("positive_rate", "brier", "log_loss", "accuracy", "precision", "recall")))


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(_scored(spark, sf_dir), ["target"]).withColumn("roc_auc", rounded("roc_auc"))


def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(_scored(spark, sf_dir), ["target"]).withColumn("average_precision", rounded("average_precision"))


def threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.threshold_table(_scored(spark, sf_dir), 50.0, 25.0, [0.5, 0.6, 0.7, 0.8, 0.9], ["target"])
    return out.select("target", "threshold", "signals", rounded("win_rate").alias("win_rate"), rounded("expectancy").alias("expectancy"))


def probability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.probability_bins(_scored(spark, sf_dir), 10, ["target"])
    return out.select("target", "bin", "n", rounded("mean_prob").alias("mean_prob"), rounded("positive_rate").alias("positive_rate"))


def champion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    both = metrics.binary_metrics(s, ["target"]).join(metrics.average_precision(s, ["target"]), "target")
    return metrics.champion(both, "target").select("target", rounded("score").alias("score"))


def usable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("constant", F.lit(1.0)).withColumn("missing", F.lit(None).cast("double"))
    return spark.createDataFrame([(c,) for c in metrics.usable_features(rows, ["n", "close", "constant", "missing"])], "feature string")


FEATURES = ["ret_1", "range_bps", "ret_3", "ret_6", "rv_6", "range_mean_6", "dist_high_6", "dist_low_6", "volume_z_6", "delta_sum_6", "tod_sin", "tod_cos"]


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot bars with features and the outcome of a long signal at each."""
    grid = hourly_grid(spark, sf_dir).where("channel = 'spot'")
    spans = (3, 6)
    make = lambda r: fe.returns(r, spans) | fe.volatility(r, (6,)) | fe.ranges(r, (6,)) | fe.distances(r, (6,)) | fe.z_scores(r, "volume", (6,)) | fe.delta_sums(r, (6,))
    rows = fe.rolling(grid, ["channel"], "bar_ms", HOUR, 6, make, fe.one_step).withColumns(fe.calendar("bar_ms"))
    rows = fe.tidy(rows, FEATURES)
    signals = grid.select("channel", F.col("bar_ms").alias("signal_ms"), F.lit(1).alias("direction"))
    outcome = labels.triple_barrier(signals, price_path(spark, sf_dir), ["channel"], "bar_ms", HOUR, labels.Target(4000.0, 2500.0, 6))
    out = rows.join(outcome.select("channel", F.col("signal_ms").alias("bar_ms"), "label"), ["channel", "bar_ms"]).where("label is not null")
    return written(out.select("channel", "bar_ms", "label", *FEATURES), "training")


def gbt_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-sample probabilities of each fold with the parameters that did best on the first part."""
    rows = training_rows(spark, sf_dir)
    params = models.select_params(rows, FEATURES, "bar_ms", "channel")
    out = models.walk_forward(rows, FEATURES, params, "bar_ms", "channel", 3, 0.4, 6 * HOUR)
    return out.select("fold", "bar_ms", "label", "prob")


def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of every feature on the held-out last part, for a model of the rows before with their best parameters."""
    parts = written(validation.embargo_split(training_rows(spark, sf_dir), "bar_ms", "channel", 0.2, 6 * HOUR), "parts")
    before, held = (parts.where(F.col("part") == p).drop("part") for p in ("selection", "holdout"))
    params = models.select_params(before, FEATURES, "bar_ms", "channel")
    bundle = models.fit(before, FEATURES, params, "bar_ms", "channel")
    return models.permutation_importance(bundle, held, "bar_ms", "channel")


_PROB = "floor((0.7 * ((doc_id * 7919 + n_chars) % 1009 / 1009.0::DOUBLE) + 0.25 * quality + 0.01) * 200) / 200.0::DOUBLE + 0.0025"
_SCORED = f"sc AS (SELECT doc_id, doc_id % 3 AS target, quality AS label, CAST({_PROB} AS DOUBLE) AS prob FROM labels JOIN documents USING (doc_id))"
_AP = """lv AS (SELECT target, prob, count(*) FILTER (label = 1) AS pos, count(*) AS n FROM sc GROUP BY ALL), cu AS (SELECT *, sum(pos) OVER (PARTITION BY target ORDER BY prob DESC) AS tp, sum(n) OVER (PARTITION BY target ORDER BY prob DESC) AS k FROM lv),
    ap AS (SELECT target, sum(tp / k * pos) / sum(pos) AS average_precision FROM cu GROUP BY target)"""
_SPLIT = f"""{BARS}, o AS (SELECT channel, bar_ms, n, close, row_number() OVER (ORDER BY bar_ms, channel) - 1 AS rn, count(*) OVER () AS total FROM bars)"""
ORACLE = {
    "embargo_split": f"""WITH {_SPLIT}, c AS (SELECT *, CAST(trunc(total * 0.8) AS BIGINT) AS cut FROM o), s AS (SELECT c.*, (SELECT min(bar_ms) FROM c x WHERE x.rn = x.cut) AS start FROM c)
        SELECT channel, bar_ms, n, close, CASE WHEN rn >= cut THEN 'holdout' WHEN bar_ms < start - 21600000 THEN 'selection' ELSE 'embargo' END AS part FROM s""",
    "walk_forward_folds": f"""WITH {_SPLIT}, p AS (SELECT any_value(total) AS n, greatest(10, CAST(trunc(any_value(total) * 0.4) AS BIGINT)) AS f FROM o), q AS (SELECT n, f, greatest(2, least(5, greatest(2, (n - f) // 10))) AS k FROM p),
        e AS (SELECT CAST(i AS INTEGER) AS fold, CAST(trunc(f + i * (n - f) / k) AS BIGINT) AS a, CAST(trunc(f + (i + 1) * (n - f) / k) AS BIGINT) AS b FROM (SELECT *, unnest(range(0, k)) AS i FROM q)),
        s AS (SELECT e.*, bar_ms AS start FROM e JOIN o ON rn = a), m AS (SELECT fold, CASE WHEN rn >= a THEN 'test' WHEN bar_ms < start - 21600000 THEN 'train' END AS part, channel, bar_ms FROM o JOIN s ON rn < b)
        SELECT * FROM m WHERE part IS NOT NULL""",
    "binary_metrics": f"""WITH {_SCORED}, q AS (SELECT *, least(greatest(prob, 1e-15), 1 - 1e-15) AS c, prob >= 0.5 AS hit FROM sc)
        SELECT target, count(*) AS n, {r6("avg(label)")} AS positive_rate, {r6("avg((prob - label) * (prob - label))")} AS brier, {r6("avg(-(label * ln(c) + (1 - label) * ln(1 - c)))")} AS log_loss, {r6("avg(CASE WHEN hit = (label = 1) THEN 1 ELSE 0 END)")} AS accuracy,
            {r6("count(*) FILTER (hit AND label = 1) / nullif(count(*) FILTER (hit), 0)")} AS precision, {r6("count(*) FILTER (hit AND label = 1) / nullif(count(*) FILTER (label = 1), 0)")} AS recall FROM q GROUP BY target""",
    "roc_auc": f"""WITH {_SCORED}, n AS (SELECT target, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM sc GROUP BY target),
        w AS (SELECT x.target, sum(CASE WHEN x.prob > y.prob THEN 1.0 WHEN x.prob = y.prob THEN 0.5 ELSE 0 END) AS w FROM sc x JOIN sc y ON x.target = y.target AND x.label = 1 AND y.label = 0 GROUP BY x.target)
        SELECT target, {r6("w / (p * q)")} AS roc_auc FROM n JOIN w USING (target)""",
    "average_precision": f"WITH {_SCORED}, {_AP} SELECT target, {r6('average_precision')} AS average_precision FROM ap",
    "threshold_table": f"""WITH {_SCORED}, t AS (SELECT CAST(unnest([0.5, 0.6, 0.7, 0.8, 0.9]) AS DOUBLE) AS threshold), h AS (SELECT target, threshold, count(*) AS signals, avg(label) AS w FROM sc JOIN t ON prob >= threshold GROUP BY ALL)
        SELECT g.target, t.threshold, coalesce(signals, 0) AS signals, {r6("w")} AS win_rate, {r6("w * 50.0 - (1 - w) * 25.0")} AS expectancy FROM (SELECT DISTINCT target FROM sc) g CROSS JOIN t LEFT JOIN h ON h.target = g.target AND h.threshold = t.threshold""",
    "probability_bins": f"WITH {_SCORED} SELECT target, CAST(greatest(1, ceil(prob * 10)) AS INTEGER) AS bin, count(*) AS n, {r6('avg(prob)')} AS mean_prob, {r6('avg(label)')} AS positive_rate FROM sc GROUP BY ALL",
    "champion": f"WITH {_SCORED}, {_AP}, b AS (SELECT target, avg((prob - label) * (prob - label)) AS brier FROM sc GROUP BY target) SELECT target, {r6('-brier + 0.15 * average_precision')} AS score FROM b JOIN ap USING (target) ORDER BY -brier + 0.15 * average_precision DESC LIMIT 1",
    "usable_features": f"WITH {BARS} SELECT unnest(CASE WHEN min(n) < max(n) THEN ['n'] ELSE [] END || CASE WHEN min(close) < max(close) THEN ['close'] ELSE [] END) AS feature FROM bars",
}
QUERIES = {name: globals()[name] for name in (*ORACLE, "gbt_walk_forward", "feature_importance")}
