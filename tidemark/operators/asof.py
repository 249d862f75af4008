"""Grids, forward filling and as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from .chunks import carry

DAY = 86_400_000


def time_grid(df: DataFrame, at: str, step: int, keys: Sequence[str] = ()) -> DataFrame:
    """Every step from the least to the greatest time of all rows, for each key.

    Days are exploded first and then their steps, so no single row makes the whole grid.
    """
    low, high = (F.floor(f(at) / step) * step for f in (F.min, F.max))
    bounds = df.agg(low.alias("__low"), high.alias("__high")).where("__low is not null")
    days = bounds.select("__low", "__high", F.explode(F.sequence(F.floor(F.col("__low") / DAY), F.floor(F.col("__high") / DAY))).alias("__day"))
    # One row for each day is dealt out before the steps are made.
    days = days.repartition("__day")
    first = F.greatest(F.col("__low"), F.ceil(F.col("__day") * DAY / step) * step)
    last = F.least(F.col("__high"), F.floor(((F.col("__day") + 1) * DAY - 1) / step) * step)
    steps = F.when(first <= last, F.sequence(first, last, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    grid = days.select(F.explode(steps).alias(at))
    if not keys:
        return grid
    return grid.crossJoin(F.broadcast(df.select(*keys).distinct()))  # few instruments


def fill_bars(bars: DataFrame, at: str, step: int, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Bars on a full grid: a missing bar has the last close as its prices, no volume, and missing = 1."""
    grid = time_grid(bars, at, step, keys)
    full = grid.join(bars, [*keys, at], "left").withColumn("missing", F.when(F.col("close").isNull(), 1).otherwise(0))
    full = carry(full, keys, [at], F.floor(F.col(at) / DAY), {"__close": F.col("close")})
    prices = {c: F.coalesce(F.col(c), F.col("__close")) for c in ("open", "high", "low", "close")}
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast(bars.schema[c].dataType)) for c in ("n", "volume", "delta", "turnover")}
    return full.withColumns(prices | zero).drop("__close")


def asof_join(left: DataFrame, right: DataFrame, at: str, right_at: str, values: Sequence[str], prefix: str, keys: Sequence[str] = (), chunk: int = DAY) -> DataFrame:
    """left with the values of the last right row at or before its time (equal times included, any distance back).

    Both sides are dealt out by chunk of time; a chunk's last row is carried to later ones. Of right rows with one time
    the one that is given last by `keep_last` should be left beforehand.
    """
    l = left.select(*left.columns, F.lit(None).cast(right.select(F.struct(right_at, *values).alias("s")).schema["s"].dataType).alias("__right"), F.lit(1).alias("__side"), F.col(at).alias("__at"))
    none = [F.lit(None).cast(left.schema[c].dataType).alias(c) if c not in keys else F.col(c) for c in left.columns]
    r = right.select(*none, F.struct(right_at, *values).alias("__right"), F.lit(0).alias("__side"), F.col(right_at).alias("__at"))
    both = l.unionByName(r)
    filled = carry(both, keys, ["__at", "__side"], F.floor(F.col("__at") / chunk), {"__found": F.col("__right")})
    kept = filled.where("__side = 1")
    return kept.select(*left.columns, *(F.col("__found")[c].alias(f"{prefix}{c}") for c in (right_at, *values)))


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, bucket: int, how: str = "inner", keys: Sequence[str] = ()) -> DataFrame:
    """Points with low <= at <= high, by buckets of time: ranges are copied to each bucket they touch."""
    p = points.withColumn("__bucket", F.floor(F.col(at) / bucket))
    r = ranges.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket))))
    r = r.withColumnsRenamed({k: f"__r_{k}" for k in (*keys, "__bucket")})
    on = (F.col("__bucket") == F.col("__r___bucket")) & F.col(at).between(F.col(low), F.col(high))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__r_{k}"))
    return p.join(r, on, how).drop("__bucket", "__r___bucket", *(f"__r_{k}" for k in keys))


def basis(left: Column, right: Column) -> Column:
    """(left / right - 1) in basis points."""
    return (left / F.nullif(right, F.lit(0.0)) - 1) * 1e4


def asof_joins(left: DataFrame, at: str, series: dict[str, tuple[DataFrame, str, Sequence[str]]], chunk: int = DAY) -> DataFrame:
    """left with <prefix>_<value> of the last row of each series at or before its time, any distance back.

    series: by prefix the rows, their time and values; one row for a time. All series and left go through one shuffle.
    """
    held = {p: rows.select(F.struct(*values).alias("s")).schema["s"].dataType for p, (rows, _, values) in series.items()}

    def side(rows: DataFrame, number: int, own: DataFrame | None, time: str, prefix: str | None = None, values: Sequence[str] = ()) -> DataFrame:
        first = F.struct(*left.columns) if own is None else F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType)
        return rows.select(first.alias("__row"), F.col(time).cast("long").alias("__at"), F.lit(number).alias("__side"), *((F.struct(*values) if p == prefix else F.lit(None).cast(t)).alias(f"__s_{p}") for p, t in held.items()))

    both = side(left, 1, None, at)
    for p, (rows, time, values) in series.items():
        both = both.unionByName(side(rows, 0, rows, time, p, values))
    filled = carry(both, [], ["__at", "__side"], F.floor(F.col("__at") / chunk), {f"__f_{p}": F.col(f"__s_{p}") for p in series}).where("__side = 1")
    return filled.select("__row.*", *(F.col(f"__f_{p}")[v].alias(f"{p}_{v}") for p, (_, _, values) in series.items() for v in values))


def zero_filled(df: DataFrame) -> DataFrame:
    """Nulls become 0 in counts, volumes and turnovers, by their names, but for open interest and the spot candles."""
    named = [c for c in df.columns if any(x in c for x in ("_count", "_volume", "_turnover")) and not c.startswith(("oi_", "spot_kline"))]
    return df.fillna(0, subset=named) if named else df


def derived(df: DataFrame, step: int = 60_000, at: str = "minute_ms") -> DataFrame:
    """Columns that follow from an enriched minute: deltas, trade prices, bases, long/short net, and when it is known."""
    out = {}
    for p in ("spot", "perp"):
        buy, sell = F.coalesce(f"{p}_buy_volume", F.lit(0.0)), F.coalesce(f"{p}_sell_volume", F.lit(0.0))
        out |= {f"{p}_delta": buy - sell, f"{p}_delta_ratio": ratio(buy - sell, buy + sell), f"{p}_trade_vwap": ratio(f"{p}_turnover", f"{p}_volume")}
    out |= {"perp_spot_basis_bps": basis(F.col("perp_close"), F.col("close")), "mark_index_basis_bps": basis(F.col("mark_close"), F.col("index_close"))}
    return df.withColumns(out | {"long_short_net": F.col("ls_buyRatio") - F.col("ls_sellRatio"), "available_ms": F.col(at) + step})
