"""Triple-barrier outcomes of signals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import range_join


@dataclass(frozen=True)
class Target:
    """Take profit and stop loss in bps, horizon in bars."""

    tp: float
    sl: float
    horizon: int

    @property
    def name(self) -> str:
        return f"tp{self.tp:g}_sl{self.sl:g}_h{self.horizon}"


def triple_barrier(signals: DataFrame, path: DataFrame, keys: Sequence[str], at: str, step: int, target: Target) -> DataFrame:
    """signals (signal_ms, direction) with entry, outcome, hit_bars and label.

    Bars after the signal up to the horizon are read. The first bar that reaches the stop or the profit decides, the
    stop where one bar reaches both: label 1 for tp, 0 for sl and timeout. Without an entry price or with a horizon
    beyond the data the outcome is censored, with a missing bar inside censored_gap: label null. path has a row for
    every bar, with price_missing.
    """
    ids = [*keys, "signal_ms", "direction"]
    ends = path.groupBy(*keys).agg(F.max(at).alias("__end"))
    entry = path.select(*keys, F.col(at).alias("signal_ms"), F.col("close").alias("entry"))
    s = signals.select(*ids).distinct().join(entry, [*keys, "signal_ms"], "left").join(F.broadcast(ends), list(keys), "left")  # a row for each instrument
    span = s.withColumns({"__low": F.col("signal_ms") + step, "__high": F.col("signal_ms") + target.horizon * step})
    bars = path.select(*keys, at, "high", "low", "price_missing")
    inner = range_join(bars, span, at, "__low", "__high", max(step * target.horizon, step), keys=keys)
    long = F.col("direction") == 1
    up, down = F.col("entry") * (1 + F.lit(target.tp) / 1e4), F.col("entry") * (1 - F.lit(target.sl) / 1e4)
    up_s, down_s = F.col("entry") * (1 + F.lit(target.sl) / 1e4), F.col("entry") * (1 - F.lit(target.tp) / 1e4)
    stop = F.when(long, F.col("low") <= down).otherwise(F.col("high") >= up_s)
    profit = F.when(long, F.col("high") >= up).otherwise(F.col("low") <= down_s)
    hits = inner.groupBy(*ids).agg(F.min(F.when(stop, F.col(at))).alias("__sl"), F.min(F.when(profit, F.col(at))).alias("__tp"), F.sum("price_missing").alias("__gaps"))
    out = s.join(hits, ids, "left")
    first = F.when(F.col("__sl").isNotNull() & (F.col("__tp").isNull() | (F.col("__sl") <= F.col("__tp"))), "sl").when(F.col("__tp").isNotNull(), "tp").otherwise("timeout")
    outcome = F.when(F.col("entry").isNull() | (F.col("signal_ms") + target.horizon * step > F.col("__end")), "censored").when(F.col("__gaps") > 0, "censored_gap").otherwise(first)
    hit = F.when(outcome == "sl", F.col("__sl")).when(outcome == "tp", F.col("__tp"))
    label = F.when(outcome == "tp", 1).when(outcome.isin("sl", "timeout"), 0)
    return out.select(*ids, "entry", outcome.alias("outcome"), ((hit - F.col("signal_ms")) / step).cast("long").alias("hit_bars"), label.alias("label"))


def excursions(signals: DataFrame, path: DataFrame, keys: Sequence[str], at: str, step: int, horizon: int) -> DataFrame:
    """mfe_bps and mae_bps over the horizon, from what bars there are, and whether all of them are (mfe_complete)."""
    ids = [*keys, "signal_ms", "direction"]
    entry = path.select(*keys, F.col(at).alias("signal_ms"), F.col("close").alias("entry"))
    s = signals.select(*ids).distinct().join(entry, [*keys, "signal_ms"], "left").withColumns({"__low": F.col("signal_ms") + step, "__high": F.col("signal_ms") + horizon * step})
    inner = range_join(path.select(*keys, at, "high", "low"), s, at, "__low", "__high", step * horizon, keys=keys)
    seen = inner.groupBy(*ids).agg(F.max("high").alias("__max"), F.min("low").alias("__min"), F.count("high").alias("__n"))
    out = s.join(seen, ids, "left")
    up, down = (F.col("__max") / F.col("entry") - 1) * 1e4, (1 - F.col("__min") / F.col("entry")) * 1e4
    long = F.col("direction") == 1
    return out.select(*ids, "entry", F.when(long, up).otherwise(down).alias("mfe_bps"), F.when(long, down).otherwise(up).alias("mae_bps"), (F.coalesce("__n", F.lit(0)) == horizon).alias("mfe_complete"))


def index_barrier(signals: DataFrame, bars: DataFrame, keys: Sequence[str], target: Target) -> DataFrame:
    """The version on bar numbers: signals (idx, direction); horizons past the last bar give a null label."""
    path = bars.select(*keys, "idx", "high", "low", "close", F.lit(0).alias("price_missing"))
    s = signals.select(*keys, F.col("idx").alias("signal_ms"), "direction")
    out = triple_barrier(s, path, keys, "idx", 1, target)
    return out.withColumnRenamed("signal_ms", "idx")
