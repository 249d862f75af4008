"""De-duplication, gap checks, validation, ordered unions and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import previous


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key; an aggregate, so hot keys are reduced before the shuffle."""
    row = F.struct(*(c for c in df.columns if c not in keys))
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("__row")).select(*keys, "__row.*")


def keep_best(df: DataFrame, keys: Sequence[str], rank: Sequence[Column]) -> DataFrame:
    """The row of each key that ranks lowest. Descending numbers are given negated."""
    row = F.struct(*(c for c in df.columns if c not in keys))
    return df.groupBy(*keys).agg(F.min_by(row, F.struct(*rank)).alias("__row")).select(*keys, "__row.*")


def sequence_gaps(batches: DataFrame, tolerance: int = 5000) -> DataFrame:
    """Batches by start and end with gap_ms to the one before, and whether that is a gap or an overlap."""
    # One row for each batch file: a catalogue, not data.
    w = Window.orderBy("start_ms", "end_ms", "batch_id")
    out = batches.withColumn("gap_ms", F.col("start_ms") - F.lag("end_ms").over(w))
    kind = F.when(F.col("gap_ms") > tolerance, "gap").when(F.col("gap_ms") < -tolerance, "overlap").otherwise("ok")
    return out.withColumn("kind", kind)


def validate_stream(df: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], chunk: Column, bad: dict[str, Column]) -> DataFrame:
    """Per key: rows, least and greatest time, rows whose time lies before that of the row ahead, and rows that are bad."""
    seen = previous(df, keys, order, chunk, "__before", at)
    return seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(at).alias("min_ms"),
        F.max(at).alias("max_ms"),
        F.count_if(F.col(at) < F.col("__before")).alias("n_backwards"),
        *(F.count_if(F.coalesce(c, F.lit(True))).alias(name) for name, c in bad.items()),
    )


def ordered_union(parts: DataFrame, batch: str, order: Sequence[str]) -> DataFrame:
    """Rows of all batches with batch_rank (by the batch's start and end) and pos within it: the order to write them in."""
    spans = parts.groupBy(batch).agg(F.min("ts_ms").alias("__s"), F.max("ts_ms").alias("__e"))
    ranks = spans.select(batch, F.row_number().over(Window.orderBy("__s", "__e", batch)).cast("long").alias("batch_rank"))  # a catalogue
    pos = F.row_number().over(Window.partitionBy(batch).orderBy(*order)).cast("long")
    return parts.withColumn("pos", pos).join(ranks, batch)


def detect_symbols(rows: DataFrame, channel: str, symbol: str, order: Sequence[str], most: int = 20_000) -> DataFrame:
    """The last symbol seen for each channel among the first rows (a bounded look, by intent)."""
    some = rows.orderBy(*order).limit(most)
    return some.groupBy(channel).agg(F.max_by(symbol, F.struct(*order)).alias(symbol))


def dataset_id(files: DataFrame) -> DataFrame:
    """A short id of a set of files: sha1 over name:size:start:end in order, 12 hex digits."""
    line = F.concat_ws(":", "name", "size", "start_ms", "end_ms")
    parts = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "name", line.alias("line"))))
    return files.agg(F.substring(F.sha1(F.concat_ws("|", F.transform(parts, lambda x: x["line"]))), 1, 12).alias("dataset_id"))


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def leaderboard(df: DataFrame, order: Sequence[Column], n: int = 20) -> DataFrame:
    """The first n rows by several keys."""
    return df.orderBy(*order).limit(n)


def replay_pivot(grid: DataFrame, signals: DataFrame, at: str = "bar_ms") -> DataFrame:
    """The grid with the highest probability of long and short signals at each time, as two columns."""
    side = lambda d: F.max(F.when(F.col("direction") == d, F.col("prob")))
    wide = signals.groupBy("signal_ms").agg(side(1).alias("p_long"), side(-1).alias("p_short")).withColumnRenamed("signal_ms", at)
    return grid.join(wide, at, "left")
