"""Chronological splits with embargo, and walk-forward folds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import numbered

DAY = 86_400_000


def _ranked(rows: DataFrame, at: str, tie: str) -> tuple[DataFrame, int]:
    """rows with rn from 0 in time order, and how many there are."""
    out = numbered(rows, [], [at, tie], F.floor(F.col(at) / (7 * DAY)), "rn").withColumn("rn", F.col("rn") - 1)
    return out, rows.count()


def embargo_split(rows: DataFrame, at: str, tie: str, share: float, embargo: int, least: int = 20) -> DataFrame:
    """Adds part: selection, holdout or embargo. The last `share` of the rows is held out, and rows less than `embargo`
    before it belong to neither. A holdout or selection of fewer than `least` rows makes everything selection."""
    ranked, n = _ranked(rows, at, tie)
    cut = int(n * (1 - share))
    start = ranked.where(F.col("rn") == cut).agg(F.min(at).alias("__start"))
    marked = ranked.crossJoin(F.broadcast(start))  # one row
    part = F.when(F.col("rn") >= cut, "holdout").when(F.col(at) < F.col("__start") - embargo, "selection").otherwise("embargo")
    sizes = marked.agg(F.count_if(part == "holdout").alias("__h"), F.count_if(part == "selection").alias("__s"))
    out = marked.crossJoin(F.broadcast(sizes))
    return out.withColumn("part", F.when((F.col("__h") < least) | (F.col("__s") < least), "selection").otherwise(part)).drop("rn", "__start", "__h", "__s")


def fold_edges(n: int, folds: int, share: float) -> list[int]:
    """Row numbers at which test parts begin, and the end: from a first training part, evenly cut. None for few rows."""
    if n < 30:
        return []
    first = max(10, int(n * share))
    parts = max(2, min(folds, max(2, (n - first) // 10)))
    return [int(first + k * (n - first) / parts) for k in range(parts + 1)]


def walk_forward_folds(rows: DataFrame, at: str, tie: str, folds: int, share: float, embargo: int, least_train: int = 20, least_test: int = 5) -> DataFrame:
    """rows of each fold with fold and part (train or test); a row is in several folds.

    Training rows lie more than `embargo` before the fold's first test row. Folds with too few rows are left out.
    """
    ranked, n = _ranked(rows, at, tie)
    edges = fold_edges(n, folds, share)
    spark = rows.sparkSession
    table = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "fold int, __a long, __b long")
    starts = ranked.join(F.broadcast(table.select("fold", "__a")), F.col("rn") == F.col("__a")).groupBy("fold").agg(F.min(at).alias("__start"))
    table = table.join(starts, "fold")
    both = ranked.join(F.broadcast(table), F.col("rn") < F.col("__b"))  # a handful of folds
    part = F.when(F.col("rn") >= F.col("__a"), "test").when(F.col(at) < F.col("__start") - embargo, "train")
    marked = both.withColumn("part", part).where("part is not null")
    good = marked.groupBy("fold").agg(F.count_if(F.col("part") == "train").alias("__tr"), F.count_if(F.col("part") == "test").alias("__te")).where((F.col("__tr") >= least_train) & (F.col("__te") >= least_test))
    return marked.join(F.broadcast(good.select("fold")), "fold").drop("rn", "__a", "__b", "__start")


def archive_split(n: int, train: float = 0.70, gap: float = 0.05) -> tuple[int, int]:
    """Of n archives in order: how many are for calibration, and from which one on the holdout is."""
    first = math.ceil(n * train)
    second = max(first + 1, math.ceil(n * (train + gap)))
    return first, min(second, n)
