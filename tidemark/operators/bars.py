"""Tumbling aggregates of trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import floor_to, ratio, rounded
from .chunks import greedy


def ohlcv(trades: DataFrame, step: int, keys: Sequence[str] = ("channel",), out: str = "bar_ms") -> DataFrame:
    """open, high, low, close, n, volume, delta, turnover for each key and bar; ties in time go by event id."""
    place = F.struct("ts_ms", "event_id")
    signed = F.when(F.col("side") == "Buy", F.col("size")).otherwise(-F.col("size"))
    return trades.groupBy(*keys, floor_to("ts_ms", step).alias(out)).agg(
        F.min_by("price", place).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", place).alias("close"),
        F.count(F.lit(1)).alias("n"),
        F.sum("size").alias("volume"),
        F.sum(signed).alias("delta"),
        F.sum(F.col("price") * F.col("size")).alias("turnover"),
    )


def flow(bars: DataFrame) -> DataFrame:
    """Adds delta_ratio and vwap, null without volume."""
    return bars.withColumn("delta_ratio", rounded(ratio("delta", "volume"))).withColumn("vwap", rounded(ratio("turnover", "volume")))


def minute_micro(trades: DataFrame, step: int = 60_000) -> DataFrame:
    """One wide row for each minute: counts, volumes, turnover and sides of the spot and perp trades and liquidations.

    The columns are fixed; a channel without trades in a minute has nulls there.
    """
    out: list[Column] = []
    for channel in ("spot", "perp", "liquidation"):
        own = lambda c, ch=channel: F.when(F.col("channel") == ch, c)
        name = f"{channel}_trade" if channel != "liquidation" else "liquidation"
        out.append(F.nullif(F.count(own(F.lit(1))), F.lit(0)).alias(f"{name}_count"))
        out.append(rounded(F.sum(own(F.col("size")))).alias(f"{name}_volume"))
        if channel != "liquidation":
            out.append(rounded(F.sum(own(F.col("price") * F.col("size")))).alias(f"{name}_turnover"))
        for side in ("Buy", "Sell"):
            out.append(rounded(F.sum(own(F.when(F.col("side") == side, F.col("size")).otherwise(0.0)))).alias(f"{name}_{side.lower()}_volume"))
    return trades.groupBy(floor_to("ts_ms", step).alias("minute_ms")).agg(*out)


def fixed_cadence(rows: DataFrame, step: int, keys: Sequence[str]) -> DataFrame:
    """The last row of each interval that has any: what a sampler at a fixed cadence keeps of a changing state."""
    value = F.struct(*(c for c in rows.columns if c not in keys))
    return rows.groupBy(*keys, floor_to("ts_ms", step).alias("sample_ms")).agg(F.max_by(value, F.struct("ts_ms", "event_id")).alias("__row")).select(*keys, "sample_ms", "__row.*")


def greedy_cadence(ticks: DataFrame, interval: int, at: str = "ts_ms", chunk: int = 86_400_000) -> DataFrame:
    """Ticks with snapshot 1 where `interval` has passed since the last snapshot, the first tick being one.

    Ticks may lie at any distance; several at one time count as one, and a null time is no snapshot.
    """
    times = ticks.where(F.col(at).isNotNull()).select(F.col(at).cast("long").alias("__at")).distinct().withColumn("__due", F.col("__at") - interval)
    marked = greedy(times, [], "__at", F.floor(F.col("__at") / chunk), "__due", "snapshot").drop("__due")
    return ticks.join(marked, ticks[at] == marked["__at"], "left").drop("__at").withColumn("snapshot", F.coalesce("snapshot", F.lit(0)))
