"""Calibrated gradient boosting with leakage-aware protocol, on pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import numbered
from .metrics import average_precision, binary_metrics, champion, roc_auc, usable_features
from .store import written
from .validation import walk_forward_folds

DAY = 86_400_000


@dataclass(frozen=True)
class Params:
    """Boosting parameters that are chosen between."""

    depth: int = 3
    rounds: int = 20
    rate: float = 0.1
    least_rows: int = 5


GRID = (Params(3, 15, 0.1), Params(2, 25, 0.08), Params(4, 12, 0.1, 10))


@dataclass
class Bundle:
    """A fitted classifier, its calibration if there was enough to fit one, and the features it reads."""

    model: PipelineModel
    calibration: LogisticRegressionModel | None
    features: list[str]

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with prob."""
        out = self.model.transform(_numbers(rows, self.features)).withColumn("__raw", vector_to_array("probability")[1])
        keep = [*rows.columns, "__raw"]
        if self.calibration is None:
            return out.select(*keep).withColumnRenamed("__raw", "prob")
        a, b = float(self.calibration.coefficients[0]), float(self.calibration.intercept)
        return out.select(*keep).withColumn("prob", 1 / (1 + F.exp(-(F.col("__raw") * a + b)))).drop("__raw")


def _numbers(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return rows.withColumns({f"__f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features} | {f"__m_{c}": F.col(c).isNull().cast("double") for c in features})


def _stages(features: Sequence[str], last) -> Pipeline:
    """Missing values become medians, with a mark beside them: the trees can't take them as they are."""
    filled = Imputer(strategy="median", inputCols=[f"__f_{c}" for c in features], outputCols=[f"__i_{c}" for c in features])
    together = VectorAssembler(inputCols=[x for c in features for x in (f"__i_{c}", f"__m_{c}")], outputCol="features")
    return Pipeline(stages=[filled, together, last])


def _ranked(rows: DataFrame, at: str, tie: str) -> DataFrame:
    return numbered(rows, [], [at, tie], F.floor(F.col(at) / (7 * DAY)), "__rn")


def _balanced(label: str, rows: DataFrame) -> Column:
    n = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    total = sum(n.values())
    return F.when(F.col(label) == 1, total / (2.0 * n.get(1, 1))).otherwise(total / (2.0 * n.get(0, 1)))


def fit(rows: DataFrame, features: Sequence[str], params: Params, at: str, tie: str, label: str = "label", share: float = 0.85, embargo: int = 0) -> Bundle:
    """Fits on the first `share` of the rows and calibrates on the rest, if that has 20 rows of both classes."""
    ranked = written(_ranked(rows.where(F.col(label).isNotNull()), at, tie), "fit")
    n = ranked.count()
    cut = int(n * share)
    calibration = ranked.where(F.col("__rn") > cut)
    begin = calibration.agg(F.min(at)).first()[0]
    first = ranked.where(F.col("__rn") <= cut)
    if embargo and begin is not None:
        first = first.where(F.col(at) < begin - embargo)
    usable = usable_features(first, features)
    if not usable:
        raise ValueError("no feature has two distinct values in the fitted rows")
    boost = GBTClassifier(labelCol=label, maxDepth=params.depth, maxIter=params.rounds, stepSize=params.rate, minInstancesPerNode=params.least_rows, weightCol="__w", validationIndicatorCol="__v", seed=42)
    held = F.col("__rn") > int(cut * 0.88)
    fitted = _stages(usable, boost).fit(_numbers(first, usable).withColumn("__w", _balanced(label, first)).withColumn("__v", held))
    plain = Bundle(fitted, None, usable)
    classes = {r[0]: r[1] for r in calibration.groupBy(label).count().collect()}
    if sum(classes.values()) < 20 or len(classes) < 2:
        return plain
    scored = VectorAssembler(inputCols=["prob"], outputCol="__p").transform(plain.predict(calibration))
    platt = LogisticRegression(featuresCol="__p", labelCol=label, regParam=1.0 / sum(classes.values()), standardization=False).fit(scored)
    return Bundle(fitted, platt, usable)


def select_params(rows: DataFrame, features: Sequence[str], at: str, tie: str, grid: Sequence[Params] = GRID, label: str = "label") -> Params:
    """The parameters with the best Brier score, then log-loss, on the last quarter; the first ones for under 40 rows."""
    ranked = written(_ranked(rows, at, tie), "select")
    n = ranked.count()
    if n < 40:
        return grid[0]
    cut = int(n * 0.75)
    train, test = ranked.where(F.col("__rn") <= cut).drop("__rn"), ranked.where(F.col("__rn") > cut).drop("__rn")
    if train.select(label).distinct().count() < 2:
        return grid[0]
    found = []
    for k, p in enumerate(grid):
        m = binary_metrics(fit(train, features, p, at, tie, label).predict(test), label=label).first()
        found.append((m.brier, m.log_loss, k))
    return grid[min(found)[2]]


def walk_forward(rows: DataFrame, features: Sequence[str], params: Params, at: str, tie: str, folds: int, share: float, embargo: int, label: str = "label") -> DataFrame:
    """Out-of-sample predictions of each fold (fold, prob, and the rows' columns); folds that train on one class are skipped."""
    parts = written(walk_forward_folds(rows, at, tie, folds, share, embargo), "folds")
    out = None
    for fold in sorted(r.fold for r in parts.select("fold").distinct().collect()):
        own = parts.where(F.col("fold") == fold)
        train, test = own.where("part = 'train'"), own.where("part = 'test'")
        if train.select(label).distinct().count() < 2:
            continue
        scored = written(fit(train, features, params, at, tie, label).predict(test), "scored")
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        return parts.limit(0).withColumn("prob", F.lit(None).cast("double"))
    return out


def score_report(scored: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """All binary metrics of each group."""
    out = binary_metrics(scored, keys, label)
    for part in (roc_auc(scored, keys, label), average_precision(scored, keys, label)):
        out = out.join(part, list(keys)) if keys else out.crossJoin(part)
    return out


def best_target(reports: DataFrame, name: str) -> DataFrame:
    return champion(reports, name)


def permutation_importance(bundle: Bundle, rows: DataFrame, at: str, tie: str, repeats: int = 3, label: str = "label", seed: int = 7) -> DataFrame:
    """feature, and the mean rise of the log-loss when its values are dealt out anew; empty for under 20 rows.

    Values are exchanged between rows whose ranks under two orders agree, chunk by chunk in time.
    """
    base = written(rows, "importance")
    spark = rows.sparkSession
    if base.count() < 20:
        return spark.createDataFrame([], "feature string, importance double")
    before = binary_metrics(bundle.predict(base), label=label).first().log_loss
    found = []
    for c in bundle.features:
        rises = []
        for k in range(repeats):
            mixed = F.xxhash64(at, tie, F.lit(seed + k))
            cell = F.pmod(F.xxhash64(tie, F.lit(seed)), F.lit(64))
            left = numbered(base.withColumn("__cell", cell), ["__cell"], [at, tie], F.lit(0), "__i")
            right = numbered(base.select(c, at, tie).withColumn("__cell", cell).withColumn("__h", mixed), ["__cell"], ["__h"], F.lit(0), "__i").select("__cell", "__i", F.col(c).alias("__new"))
            dealt = left.join(right, ["__cell", "__i"]).withColumn(c, F.col("__new")).drop("__cell", "__i", "__new")
            rises.append(binary_metrics(bundle.predict(dealt), label=label).first().log_loss - before)
        found.append((c, float(sum(rises) / repeats)))
    return spark.createDataFrame(found, "feature string, importance double")


def historical(features: Sequence[str], live: Sequence[str] = ("spot_ob", "perp_ob", "spot_trade", "perp_trade", "liquidation")) -> list[str]:
    """Features that can be had without live collection: the ablation's set."""
    return [c for c in features if not c.startswith(tuple(live))]


def excursion_model(rows: DataFrame, features: Sequence[str], target: str) -> tuple[PipelineModel | None, list[str]]:
    """A regressor of mfe or mae by absolute error; None for under 30 rows."""
    good = rows.where(F.col(target).isNotNull())
    if good.count() < 30:
        return None, []
    usable = usable_features(good, features)
    boost = GBTRegressor(labelCol=target, lossType="absolute", maxDepth=3, maxIter=15, stepSize=0.1, seed=42)
    return _stages(usable, boost).fit(_numbers(good, usable)), usable


def excursion_error(model: PipelineModel, features: Sequence[str], rows: DataFrame, target: str) -> float:
    """Mean absolute error."""
    return model.transform(_numbers(rows, features)).agg(F.avg(F.abs(F.col("prediction") - F.col(target)))).first()[0]
