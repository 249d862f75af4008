"""Confirmed pivots, double and triple formations, candidates and signal episodes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import distance_bps
from .asof import range_join
from .chunks import CHUNK, carry, in_chunks, numbered, own_rows, previous
from .store import written

DAY = 86_400_000


@dataclass(frozen=True)
class Profile:
    """How a formation is looked for: bars that confirm a pivot, gap between pivots in bars, tolerance and rebound in bps."""

    name: str
    confirm: int
    min_gap: int
    max_gap: int
    tolerance_bps: float
    rebound_bps: float


def indexed(grid: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Adds idx, the row's place in its series from 0, and n_bars, the series' length."""
    out = numbered(grid, keys, [at], F.floor(F.col(at) / (7 * DAY)), "idx").withColumn("idx", F.col("idx") - 1)
    sizes = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bars"))
    out = out.join(F.broadcast(sizes), list(keys))  # one row for each instrument
    return written(out, "bars")  # all formations read it


def confirmed_pivots(bars: DataFrame, keys: Sequence[str], at: str, step: int, confirm: int) -> DataFrame:
    """keys, kind (low or high), idx, price, confirm_idx and signal_ms of each pivot.

    Bar i is a low pivot when no low from max(confirm, 2) bars before to `confirm` bars after is below its own; bars
    without all of these neighbours are none. It is known, and dated, `confirm` bars later. bars: indexed and gap-free.
    """
    left = max(confirm, 2)
    cut = in_chunks(bars, at, 7 * DAY, back=left * step, ahead=confirm * step)
    around = Window.partitionBy(*keys, CHUNK).orderBy(at).rowsBetween(-left, confirm)
    marked = own_rows(cut.withColumns({"__low": F.min("low").over(around), "__high": F.max("high").over(around)}))
    inside = marked.where((F.col("idx") >= left) & (F.col("idx") + confirm < F.col("n_bars")))
    kinds = F.array(
        F.struct(F.lit("low").alias("kind"), F.when(F.col("low") <= F.col("__low"), F.col("low")).alias("price")),
        F.struct(F.lit("high").alias("kind"), F.when(F.col("high") >= F.col("__high"), F.col("high")).alias("price")),
    )
    rows = inside.withColumn("p", F.explode(kinds)).where("p.price is not null")
    return rows.select(*keys, F.col("p.kind").alias("kind"), "idx", F.col("p.price").alias("price"), (F.col("idx") + confirm).alias("confirm_idx"), (F.col(at) + confirm * step).alias("signal_ms"))


def _rebounds(pairs: DataFrame, bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """pairs (idx1 < idx2) with the extreme between their pivots inclusive: null where they are neighbours."""
    own = pairs.select(*keys, "kind", "idx1", "idx2").distinct()
    inner = range_join(bars.select(*keys, "idx", "high", "low"), own, "idx", "idx1", "idx2", 64, keys=keys)
    extreme = F.when(F.col("kind") == "low", F.max("high")).otherwise(F.min("low"))
    found = inner.groupBy(*keys, "kind", "idx1", "idx2").agg(extreme.alias("extreme"))
    return pairs.join(found, [*keys, "kind", "idx1", "idx2"], "left").withColumn("extreme", F.when(F.col("idx2") > F.col("idx1") + 1, F.col("extreme")))


def rebound_bps(kind: Column, extreme: Column, a: Column, b: Column) -> Column:
    """How far the price went between two pivots, in bps of their mean; 0 without bars between."""
    base = (a + b) / 2
    return F.coalesce(F.when(kind == "low", extreme - base).otherwise(base - extreme) / base * 1e4, F.lit(0.0))


def _with_before(pivots: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Adds the n pivots before, of the same kind: p1 (the one before), p2."""
    out = pivots.withColumn("p0", F.struct("idx", "price"))
    for k in range(1, n + 1):
        out = previous(out, [*keys, "kind"], ["idx"], F.floor(F.col("idx") / 4096), f"p{k}", f"p{k - 1}")
    return written(out, "pivots")


def doubles(pivots: DataFrame, bars: DataFrame, keys: Sequence[str], profile: Profile) -> DataFrame:
    """Formations of two consecutive pivots of a kind."""
    p = _with_before(pivots, keys, 1).where("p1 is not null").withColumn("idx2", F.col("idx")).withColumn("idx1", F.col("p1.idx"))
    gap = F.col("idx2") - F.col("idx1")
    p = p.where(gap.between(profile.min_gap, profile.max_gap)).withColumn("dev_bps", distance_bps(F.col("p1.price"), F.col("price"))).where(F.col("dev_bps") <= profile.tolerance_bps)
    p = _rebounds(p, bars, keys).withColumn("rebound_bps", rebound_bps(F.col("kind"), F.col("extreme"), F.col("p1.price"), F.col("price")))
    kept = p.where(F.col("rebound_bps") >= profile.rebound_bps)
    return _formation(kept, keys, "double", profile, F.col("idx1"), F.col("extreme"))


def triples(pivots: DataFrame, bars: DataFrame, keys: Sequence[str], profile: Profile) -> DataFrame:
    """Formations of three consecutive pivots of a kind: largest deviation of the three pairs, smaller of the rebounds."""
    p = _with_before(pivots, keys, 2).where("p2 is not null").withColumn("i0", F.col("p2.idx")).withColumn("i1", F.col("p1.idx"))
    ok = lambda g: g.between(profile.min_gap, profile.max_gap)
    p = p.where(ok(F.col("i1") - F.col("i0")) & ok(F.col("idx") - F.col("i1")))
    a, b, c = F.col("p2.price"), F.col("p1.price"), F.col("price")
    p = p.withColumn("dev_bps", F.greatest(distance_bps(a, b), distance_bps(b, c), distance_bps(a, c))).where(F.col("dev_bps") <= profile.tolerance_bps)
    p = _rebounds(p.withColumn("idx1", F.col("i0")).withColumn("idx2", F.col("i1")), bars, keys).withColumnRenamed("extreme", "x1").drop("idx1", "idx2")
    p = _rebounds(p.withColumn("idx1", F.col("i1")).withColumn("idx2", F.col("idx")), bars, keys).withColumnRenamed("extreme", "x2")
    p = p.withColumn("rebound_bps", F.least(rebound_bps(F.col("kind"), F.col("x1"), a, b), rebound_bps(F.col("kind"), F.col("x2"), b, c)))
    neck = F.when(F.col("kind") == "low", F.greatest("x1", "x2")).otherwise(F.least("x1", "x2"))
    return _formation(p.where(F.col("rebound_bps") >= profile.rebound_bps), keys, "triple", profile, F.col("i0"), neck)


def _formation(p: DataFrame, keys: Sequence[str], name: str, profile: Profile, first: Column, neckline: Column) -> DataFrame:
    direction = F.when(F.col("kind") == "low", 1).otherwise(-1)
    quality = F.col("rebound_bps") / (1 + F.col("dev_bps"))
    return p.select(
        *keys, "signal_ms", direction.alias("direction"), F.lit(name).alias("formation"), F.lit(profile.name).alias("profile"),
        first.alias("first_idx"), F.col("idx").alias("last_idx"), "price", neckline.alias("neckline"), "dev_bps", "rebound_bps", quality.alias("quality"),
    )


def candidates(bars: DataFrame, keys: Sequence[str], at: str, step: int, profiles: Sequence[Profile]) -> DataFrame:
    """Formations of all profiles; of equal signal, direction and formation the best quality stays (then the first profile)."""
    found = None  # a union of written parts
    for n, profile in enumerate(profiles):
        pivots = written(confirmed_pivots(bars, keys, at, step, profile.confirm), "pivots")
        for make in (doubles, triples):
            some = written(make(pivots, bars, keys, profile).withColumn("profile_code", F.lit(n)), "formations")
            found = some if found is None else found.unionByName(some)
    own = [*keys, "signal_ms", "direction", "formation"]
    row = F.struct(*(c for c in found.columns if c not in own))
    best = F.struct(F.col("quality").alias("q"), (-F.col("profile_code")).alias("p"))
    return found.groupBy(*own).agg(F.max_by(row, best).alias("__row")).select(*own, "__row.*")


def signal_episodes(signals: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """Adds episode_id (L or S and a number for each direction) and is_first.

    A signal more than `gap` after the one before it begins an episode. Numbers run over the whole series: an
    episode's number counts the first signals so far, chunk by chunk.
    """
    chunk = F.floor(F.col("signal_ms") / (7 * DAY))
    order = ["signal_ms", "formation"]
    by = [*keys, "direction"]
    seen = previous(signals, by, order, chunk, "__before", "signal_ms")
    seen = seen.withColumn("is_first", F.when(F.col("__before").isNull() | (F.col("signal_ms") - F.col("__before") > gap), 1).otherwise(0)).drop("__before")
    ranked = numbered(seen, [*by, "is_first"], order, chunk, "__nth")
    marked = ranked.withColumn("__number", F.when(F.col("is_first") == 1, F.col("__nth")))
    marked = carry(marked, by, order, chunk, {"__episode": F.col("__number")})
    letter = F.when(F.col("direction") == 1, "L").otherwise("S")
    return marked.withColumn("episode_id", F.format_string("%s%07d", letter, F.col("__episode"))).drop("__nth", "__number", "__episode")
