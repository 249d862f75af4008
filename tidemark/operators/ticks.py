"""A regular tick timeline with sliding-window sensors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import time_grid
from .chunks import CHUNK, OWN, carry, in_chunks

DAY = 86_400_000


def tick_grid(events: DataFrame, tick: int, tail: int) -> DataFrame:
    """Ticks from the first event's tick to `tail` after the last event. events: or their segments."""
    first, last = ("__from", "__to") if "__from" in events.columns else ("ts_ms", "ts_ms")
    span = events.agg(F.min(first).alias("a"), (F.max(last) + tail).alias("b"))
    ends = span.select(F.explode(F.array("a", "b")).alias("ts_ms"))
    return time_grid(ends, "ts_ms", tick)


def _position(at: str, cell: int) -> Column:
    """Number of the segment of a time: even at a multiple of `cell`, odd in the open span up to the next one."""
    return F.floor(F.col(at) / cell).cast("long") * 2 + (F.pmod(F.col(at), F.lit(cell)) != 0).cast("long")


def segments(events: DataFrame, cell: int, order: Sequence[str] = ("ts_ms", "event_id"), sums: Sequence[str] = ()) -> DataFrame:
    """One row for each segment and kind of event: what a window that holds all of the segment needs of it.

    cell: a span in ms that the ticks and the width of every window are multiples of. __way is the way of prices inside the
    segment, __last the price of its last event, __known the last price there, __from and __to the first and last time. sums: further
    columns to add up. Written once, it serves all that the events were read for.
    """
    e = events.where(F.col(order[0]).isNotNull()).select(*order, "price", "quote", "churn", F.coalesce("is_primary", F.lit(False)).alias("__primary"), _position(order[0], cell).alias("__at"), *sums)
    along = Window.partitionBy("__at", "__primary").orderBy(*order)
    e = e.withColumns({"__step": F.abs(F.col("price") - F.lag("price").over(along)), "__rank": F.row_number().over(along)})
    totals = [F.count("price").alias("__n"), F.sum("quote").alias("__q"), F.sum("churn").alias("__c"), F.max("price").alias("__hi"), F.min("price").alias("__lo"), F.sum("__step").alias("__way")]
    totals += [F.min(order[0]).alias("__from"), F.max(order[0]).alias("__to"), *(F.sum(c).alias(c) for c in sums)]
    # Ranks, not structs of the order: all that is held for a segment is of fixed width, so it is summed up by hash.
    known = F.max_by("price", F.when(F.col("price").isNotNull(), F.col("__rank"))).alias("__known")
    found = e.groupBy("__at", "__primary").agg(*totals, F.min_by("price", "__rank").alias("__first"), F.max_by("price", "__rank").alias("__last"), known)
    return found.withColumn("__last", F.struct(F.col("__last").alias("price")))


def window_sensors(events: DataFrame, ticks: DataFrame, width: int, prefix: str, order: Sequence[str] = ("ts_ms", "event_id"), chunk: int = DAY, step: int = 1) -> DataFrame:
    """ts_ms and the sensors of the events in (tick - width, tick): both ends open, so an event at the tick comes later.

    events: ts_ms, price, quote, churn, is_primary (its price counts). price_range_bp is the range of primary prices over the first
    one, tick_travel_bp the way they went; rates are per second. Empty windows give 0. step: a span in ms that all ticks are
    multiples of. Events are summed up once by segments between such times, so frames grow with width / step, not with the events.
    """
    cell = math.gcd(step, width)
    return segment_sensors(segments(events, cell, order), ticks, width, prefix, cell, chunk)


def segment_sensors(found: DataFrame, ticks: DataFrame, width: int, prefix: str, cell: int, chunk: int = DAY) -> DataFrame:
    """window_sensors of events that are summed up by segments of `cell` already."""
    found = found.select("__at", "__primary", "__n", "__q", "__c", "__hi", "__lo", "__way", "__first", "__last")
    # __into: the step into a segment from the price before it, whatever its distance.
    found = carry(found, [], ["__at", "__primary"], F.floor(F.col("__at") / max(1, 2 * DAY // cell)), {"__before": F.when(F.col("__primary"), F.col("__last"))}, inclusive=False)
    found = found.withColumn("__into", F.abs(F.col("__first") - F.col("__before.price"))).drop("__last", "__before")
    kinds = {c.name: c.dataType for c in found.schema}
    empty = [F.lit(None).cast(t).alias(c) for c, t in kinds.items() if c != "__at"]
    times = ticks.select(_position("ts_ms", cell).alias("__at"), *empty, "ts_ms")
    both = found.withColumn("ts_ms", F.lit(None).cast("long")).unionByName(times)
    reach = 2 * width // cell
    cut = in_chunks(both, "__at", max(1, 2 * chunk // cell), back=reach)
    w = Window.partitionBy(CHUNK).orderBy("__at").rangeBetween(-(reach - 1), -1)
    own = F.col("__primary")
    place = F.when(own, F.col("__at"))
    # The price before, whatever its distance, makes a step; a window leaves out the step into its first price.
    way = F.sum(F.when(own, F.coalesce("__way", F.lit(0.0)) + F.coalesce("__into", F.lit(0.0)))).over(w)
    seconds = width / 1000.0
    out = cut.withColumns(
        {
            "__f": F.min_by("__first", place).over(w),
            "__h": F.max(F.when(own, F.col("__hi"))).over(w),
            "__l": F.min(F.when(own, F.col("__lo"))).over(w),
            "__w": F.coalesce(way, F.lit(0.0)) - F.coalesce(F.min_by("__into", place).over(w), F.lit(0.0)),
            "__count": F.coalesce(F.sum("__n").over(w), F.lit(0)),
            "__quote": F.sum("__q").over(w),
            "__churn": F.sum("__c").over(w),
        }
    ).where(F.col("ts_ms").isNotNull() & F.col(OWN))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        "ts_ms",
        zero((F.col("__h") - F.col("__l")) / F.col("__f") * 1e4).alias(f"{prefix}price_range_bp"),
        zero(F.greatest(F.col("__w"), F.lit(0.0)) / F.col("__f") * 1e4).alias(f"{prefix}tick_travel_bp"),
        (F.col("__count") / seconds).alias(f"{prefix}trade_rate_s"),
        zero(F.col("__quote") / seconds).alias(f"{prefix}quote_volume_s"),
        zero(F.col("__churn") / seconds).alias(f"{prefix}book_churn_s"),
    )


def last_price(events: DataFrame, ticks: DataFrame, step: int = 1) -> DataFrame:
    """ts_ms and the last primary price before each tick. step: a span in ms that all ticks are multiples of."""
    own = events.where("is_primary and ts_ms is not null").groupBy(_position("ts_ms", step).alias("__at"))
    last = own.agg(F.max_by("price", F.when(F.col("price").isNotNull(), F.struct("ts_ms", "event_id"))).alias("price"))
    return _carried_price(last, ticks, step)


def segment_price(found: DataFrame, ticks: DataFrame, cell: int) -> DataFrame:
    """last_price of events that are summed up by segments of `cell` already."""
    return _carried_price(found.where("__primary").select("__at", F.col("__known").alias("price")), ticks, cell)


def _carried_price(last: DataFrame, ticks: DataFrame, step: int) -> DataFrame:
    last = last.withColumns({"ts_ms": F.lit(None).cast("long"), "__tick": F.lit(0)})
    t = ticks.select(_position("ts_ms", step).alias("__at"), F.lit(None).cast("double").alias("price"), "ts_ms", F.lit(-1).alias("__tick"))
    both = carry(last.unionByName(t), [], ["__at", "__tick"], F.floor(F.col("__at") / max(1, 2 * DAY // step)), {"__p": F.col("price")})
    return both.where("__tick = -1").select("ts_ms", F.col("__p").alias("price"))


def imbalance_delta(ticks: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Adds |imbalance - the last known one before|, which starts at 0; ticks without a book give 0 and leave it as it is.

    The same value holds for every window, as the last known one moves after all sensors are read.
    """
    out = carry(ticks, [], ["ts_ms"], F.floor(F.col("ts_ms") / DAY), {"__prev": F.col("imbalance")}, inclusive=False)
    value = F.coalesce(F.abs(F.col("imbalance") - F.coalesce("__prev", F.lit(0.0))), F.lit(0.0))
    return out.withColumns({f"{p}imbalance_delta": value for p in prefixes}).drop("__prev")


def emitted(ticks: DataFrame, emit_from: int) -> DataFrame:
    """What is kept when earlier data only warm the windows up."""
    return ticks.where(F.col("ts_ms") >= emit_from)
