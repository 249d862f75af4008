"""Order-book levels as arrays of struct<price, qty>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col


def levels(pairs: Column | str) -> Column:
    """array<array<string or double>> to array<struct<price, qty>>; unreadable levels are left out."""
    made = F.transform(col(pairs), lambda x: F.struct(F.get(x, F.lit(0)).try_cast("double").alias("price"), F.get(x, F.lit(1)).try_cast("double").alias("qty")))
    return F.filter(made, lambda x: x["price"].isNotNull() & x["qty"].isNotNull())


def sorted_levels(side: Column | str, descending: bool, depth: int) -> Column:
    """The best `depth` levels with quantity, best first."""
    ordered = F.sort_array(F.filter(col(side), lambda x: x["qty"] > 0), asc=not descending)
    return F.slice(ordered, 1, depth)


def quantity(side: Column | str) -> Column:
    return F.aggregate(col(side), F.lit(0.0), lambda acc, x: acc + x["qty"])


def within(side: Column | str, mid: Column, band_bps: float) -> Column:
    """Quantity within a band around the mid price."""
    near = F.filter(col(side), lambda x: F.abs(x["price"] - mid) <= mid * (band_bps / 1e4))
    return quantity(near)


def imbalance(bid: Column, ask: Column) -> Column:
    """(bid - ask) / (bid + ask), 0 where there is neither."""
    total = bid + ask
    return F.when(total == 0, F.lit(0.0)).otherwise((bid - ask) / F.nullif(total, F.lit(0.0)))
