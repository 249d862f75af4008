"""Order books: metrics of a snapshot, and books rebuilt from snapshots and deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import imbalance, quantity, sorted_levels, within
from ..functions.numeric import finite, floor_to, ratio
from .chunks import carry

DAY = 86_400_000
BANDS = (5, 10, 25, 50)


def snapshot_record(bids: Column, asks: Column, depth: int = 50) -> dict[str, Column]:
    """Sorted levels with best prices, mid and spread; prices are null when a side is empty."""
    b, a = sorted_levels(bids, True, depth), sorted_levels(asks, False, depth)
    best_bid, best_ask = F.get(b, F.lit(0))["price"], F.get(a, F.lit(0))["price"]
    mid = (best_bid + best_ask) / 2
    return {"bids": b, "asks": a, "best_bid": best_bid, "best_ask": best_ask, "mid": mid, "spread": best_ask - best_bid, "spread_bps": (best_ask - best_bid) / mid * 1e4}


def book_metrics(bids: Column, asks: Column, depth: int = 10) -> dict[str, Column]:
    """book_valid, mid, spread_bp, bid_depth, ask_depth, imbalance of the best levels; null but for book_valid when a side
    is empty or the sides cross."""
    r = snapshot_record(bids, asks, depth)
    valid = F.coalesce(r["best_bid"] < r["best_ask"], F.lit(False))
    bid, ask = quantity(r["bids"]), quantity(r["asks"])
    out = {"mid": r["mid"], "spread_bp": r["spread_bps"], "bid_depth": bid, "ask_depth": ask, "imbalance": imbalance(bid, ask)}
    return {"book_valid": F.when(valid, 1).otherwise(0)} | {k: F.when(valid, v) for k, v in out.items()}


def microprice_bps(bids: Column, asks: Column) -> Column:
    """How far the quantity-weighted best price lies from the mid, in bps."""
    b, a = F.get(sorted_levels(bids, True, 1), F.lit(0)), F.get(sorted_levels(asks, False, 1), F.lit(0))
    total = F.nullif(b["qty"] + a["qty"], F.lit(0.0))
    mid = (b["price"] + a["price"]) / 2
    return ((a["price"] * b["qty"] + b["price"] * a["qty"]) / total / mid - 1) * 1e4


def band_liquidity(bids: Column, asks: Column, bands: Sequence[int] = BANDS, depth: int = 50) -> dict[str, Column]:
    """Quantities and imbalance within bands around the mid."""
    r = snapshot_record(bids, asks, depth)
    out = {}
    for w in bands:
        b, a = within(r["bids"], r["mid"], w), within(r["asks"], r["mid"], w)
        out |= {f"bid_qty_{w}bps": b, f"ask_qty_{w}bps": a, f"imbalance_{w}bps": imbalance(b, a)}
    return out


def churn(bids: Column, asks: Column) -> Column:
    """Level updates of a message, deletions included."""
    return F.coalesce(F.size(bids), F.lit(0)) + F.coalesce(F.size(asks), F.lit(0))


def with_epoch(updates: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, strict: bool = True) -> DataFrame:
    """Adds epoch: the place of the last snapshot at or before each update, null before the first one.

    strict: updates before the first snapshot don't count (null epoch); else they begin a book of their own, and an
    update with update_id 1 restarts it.
    """
    starts = F.col("is_snapshot") if strict else F.col("is_snapshot") | (F.col("update_id") == 1)
    place = F.struct(*order)
    out = carry(updates, keys, order, F.floor(F.col(at) / DAY), {"epoch": F.when(starts, place)})
    return out


def book_as_of(updates: DataFrame, keys: Sequence[str], order: Sequence[str], strict: bool = True) -> DataFrame:
    """Levels of each key's book after all updates: keys, side, price, qty.

    updates: one row for each changed level, with side, price, qty (0 deletes) and epoch. The last update of a level in
    the last epoch stands; nothing is folded in sequence, so levels are rebuilt in parallel with partial aggregation.
    """
    newest = updates.groupBy(*keys).agg(F.max("epoch").alias("__epoch"))
    own = updates.join(F.broadcast(newest), list(keys))  # a row for each book
    kept = own.where(F.col("epoch") == F.col("__epoch")) if strict else own.where(F.col("epoch").eqNullSafe(F.col("__epoch")))
    last = kept.groupBy(*keys, "side", "price").agg(F.max_by("qty", F.struct(*order)).alias("qty"))
    return last.where("qty > 0")


def top_levels(book: DataFrame, keys: Sequence[str], depth: int) -> DataFrame:
    """The best levels of each side with their rank."""
    key = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy(*keys, "side").orderBy(key)
    return book.withColumn("level", F.row_number().over(w)).where(F.col("level") <= depth)


#: Statistics of a sampled book that minutes are made of.
STATS = ("spread_bps", "bid_qty_l50", "ask_qty_l50", "imbalance_l50", "micro_dev_bps", *(f"{n}_{w}bps" for w in BANDS for n in ("bid_qty", "ask_qty", "imbalance")))


def sample_stats(bids: Column, asks: Column, depth: int = 50) -> dict[str, Column]:
    """STATS of one snapshot; what needs a mid is null when a side is empty, an imbalance where there is no quantity."""
    r = snapshot_record(bids, asks, depth)
    bid, ask = quantity(r["bids"]), quantity(r["asks"])
    out = {"spread_bps": r["spread_bps"], "bid_qty_l50": bid, "ask_qty_l50": ask, "imbalance_l50": ratio(bid - ask, bid + ask), "micro_dev_bps": microprice_bps(bids, asks)}
    for w in BANDS:
        b, a = within(r["bids"], r["mid"], w), within(r["asks"], r["mid"], w)
        out |= {f"bid_qty_{w}bps": b, f"ask_qty_{w}bps": a, f"imbalance_{w}bps": ratio(b - a, b + a)}
    return {n: finite(c) for n, c in out.items()}


def book_minutes(samples: DataFrame, prefixes: dict[str, str], step: int = 60_000) -> DataFrame:
    """One wide row for each minute: for each market <prefix>_samples, and _sum, _last, _min, _max, _mean of each of STATS.

    samples: market, ts_ms, event_id and STATS. Null values are left out, in the mean as well; a market without samples
    in a minute has nulls. prefixes: name of each market's columns.
    """
    place = F.struct("ts_ms", "event_id")
    made = {"samples": F.count(F.lit(1))}
    for s in STATS:
        made |= {f"{s}_sum": F.sum(s), f"{s}_last": F.max_by(s, F.when(F.col(s).isNotNull(), place)), f"{s}_min": F.min(s), f"{s}_max": F.max(s), f"{s}_mean": F.avg(s)}
    per = samples.where(F.col("market").isin(*prefixes)).groupBy("market", floor_to("ts_ms", step).alias("minute_ms")).agg(*(c.alias(n) for n, c in made.items()))
    wide = per.groupBy("minute_ms").agg(*(F.any_value(F.when(F.col("market") == m, F.struct(*made)), ignoreNulls=True).alias(p) for m, p in prefixes.items()))
    return wide.select("minute_ms", *(F.col(p)[n].alias(f"{p}_{n}") for p in prefixes.values() for n in made))
