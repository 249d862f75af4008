"""Ground-truth episodes, and how well a policy's decisions cover them.

Decisions and metrics carry the columns of `keys` (a policy's name, say); the ground truth is shared by all of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chunks
from .asof import range_join
from .chunks import carry, previous
from .policy import CHUNK_TICKS, SENSORS

DAY = 86_400_000


@dataclass(frozen=True)
class Rules:
    """Times in ms; required intervals by tier."""

    tick: int = 250
    gap: int = 1500
    context: int = 1000
    required: dict[str, int] = field(default_factory=lambda: {"A": 800, "B": 1500, "C": 2500})
    grace: int = 750
    slow: int = 2500
    stable: int = 1000
    horizon: int = 30_000
    prearm: int = 1000
    weights: tuple[float, float] = (2.0, 1.0)
    base: int = 1000


#: Acceptance gates. Fixed values.
GATES = {"tier_a_recall": 0.98, "tier_b_recall": 0.90, "ab_weighted_recall": 0.95, "tier_a_snapshot_recall": 0.98, "tier_b_snapshot_recall": 0.90, "reaction_p95_ms": 750.0, "oversampling_p95_ms": 6000.0, "false_fast_time": 0.20, "snapshot_reduction": 0.40}
_AT_MOST = ("reaction_p95_ms", "oversampling_p95_ms", "false_fast_time")


def tiers(ticks: DataFrame, thresholds: dict[str, float], prefix: str = "fast_") -> DataFrame:
    """Adds tier_a, tier_b, tier_c and absorption to the ticks."""
    hit = {f: F.lit(False) for f in SENSORS}
    for family, names in SENSORS.items():
        for s in names:
            hit[family] = hit[family] | (F.coalesce(F.col(prefix + s), F.lit(0.0)) >= thresholds[s])
    a = hit["price"]
    b = ~a & hit["flow"] & hit["book"]
    c = ~a & ~b & (hit["flow"] | hit["book"])
    still = F.coalesce(F.col(f"{prefix}price_range_bp"), F.lit(0.0)) < 0.6 * thresholds["price_range_bp"]
    return ticks.withColumns({"tier_a": a, "tier_b": b, "tier_c": c, "absorption": b & still})


def islands(rows: DataFrame, gap: int, extra: dict[str, Column] | None = None, at: str = "ts_ms") -> DataFrame:
    """start_ms, end_ms and points of the runs whose neighbours are at most `gap` apart."""
    seen = previous(rows, [], [at], F.floor(F.col(at) / DAY), "__before", at)
    begins = F.when(F.col("__before").isNull() | (F.col(at) - F.col("__before") > gap), F.col(at))
    marked = carry(seen, [], [at], F.floor(F.col(at) / DAY), {"start_ms": begins})
    return marked.groupBy("start_ms").agg(F.max(at).alias("end_ms"), F.count(F.lit(1)).alias("points"), *(c.alias(n) for n, c in (extra or {}).items()))


def episodes(marked: DataFrame, rules: Rules) -> DataFrame:
    """Episodes of tiers A and B: islands of both, A where any tick is."""
    some = marked.where("tier_a or tier_b").select("ts_ms", "tier_a")
    return islands(some, rules.gap, {"tier": F.when(F.max("tier_a"), "A").otherwise("B")})


def lone_episodes(marked: DataFrame, strong: DataFrame, rules: Rules) -> DataFrame:
    """Episodes of tier C that meet no A or B episode, ends included."""
    c = islands(marked.where("tier_c").select("ts_ms"), rules.gap).withColumn("tier", F.lit("C"))
    bucket = max(rules.horizon, rules.gap)
    spread = lambda df, p: df.select(F.col("start_ms").alias(f"{p}s"), F.col("end_ms").alias(f"{p}e"), F.explode(F.sequence(F.floor(F.col("start_ms") / bucket), F.floor(F.col("end_ms") / bucket))).alias(f"{p}b"))
    x, y = spread(c, "c"), spread(strong, "x")
    met = x.join(y, (x.cb == y.xb) & (x.ce >= y.xs) & (x.cs <= y.xe)).select(F.col("cs").alias("start_ms")).distinct()
    return c.join(met, "start_ms", "left_anti")


def context_mask(ticks: DataFrame, strong: DataFrame, rules: Rules) -> DataFrame:
    """ts_ms of the ticks within the context of an episode."""
    near = strong.select((F.col("start_ms") - rules.context).alias("__low"), (F.col("end_ms") + rules.context).alias("__high"))
    return range_join(ticks.select("ts_ms"), near, "ts_ms", "__low", "__high", rules.horizon).select("ts_ms").distinct()


def capture(found: DataFrame, decisions: DataFrame, rules: Rules, keys: Sequence[str]) -> DataFrame:
    """For each policy and episode: covered, reaction_ms, prearmed, snap_covered, snap_reaction_ms."""
    required = F.lit(rules.required["C"])
    for tier in ("A", "B"):
        required = F.when(F.col("tier") == tier, rules.required[tier]).otherwise(required)
    span = found.withColumns({"__low": F.col("start_ms") - rules.prearm, "__high": F.col("end_ms") + rules.grace})
    d = decisions.select(*keys, "ts_ms", "interval_ms", "snapshot")
    near = range_join(d, span, "ts_ms", "__low", "__high", rules.horizon).withColumn("__ok", F.col("interval_ms") <= required)
    t = F.col("ts_ms")
    inside = F.col("__ok") & t.between(F.col("start_ms"), F.col("end_ms"))
    snapped = F.col("__ok") & (F.col("snapshot") > 0) & (t >= F.col("start_ms"))
    before = F.col("__ok") & (t < F.col("start_ms"))
    hits = near.groupBy(*keys, "start_ms", "tier").agg(F.min(F.when(inside, t)).alias("__hit"), F.max(before).alias("prearmed"), F.min(F.when(snapped, t)).alias("__snap"))
    every = found.select("start_ms", "end_ms", "tier").crossJoin(F.broadcast(decisions.select(*keys).distinct()))  # policies are few
    out = every.join(hits, [*keys, "start_ms", "tier"], "left")
    return out.select(
        *keys, "start_ms", "end_ms", "tier", F.col("__hit").isNotNull().alias("covered"), (F.col("__hit") - F.col("start_ms")).alias("reaction_ms"),
        F.coalesce("prearmed", F.lit(False)).alias("prearmed"), F.col("__snap").isNotNull().alias("snap_covered"), (F.col("__snap") - F.col("start_ms")).alias("snap_reaction_ms"),
    )


def oversampling(strong: DataFrame, decisions: DataFrame, rules: Rules, keys: Sequence[str]) -> DataFrame:
    """For each policy and episode: how long sampling stayed fast after its end, and how that ended.

    released: a stable run of slow ticks began; next: another episode did; horizon: neither did in time; censored: the
    data ended (no value).
    """
    keys = list(keys)
    back = strong.withColumn("__back", -F.col("start_ms"))
    nxt = previous(back, [], ["__back"], F.floor(F.col("__back") / DAY), "next_ms", "start_ms").drop("__back")
    end = decisions.groupBy(*keys).agg(F.max("ts_ms").alias("__end"))
    natural = F.col("end_ms") + rules.horizon + rules.tick
    e = nxt.crossJoin(F.broadcast(end)).withColumn("__stop", F.least(natural, F.col("next_ms"), F.col("__end") + rules.tick))
    span = e.withColumns({"__low": F.col("end_ms") + 1, "__high": F.greatest(F.col("__stop") - 1, F.col("end_ms") + 1)})
    slow = decisions.where(F.col("interval_ms") >= rules.slow).select(*keys, "ts_ms")
    near = range_join(slow, span.select(*keys, "start_ms", "end_ms", "__stop", "__low", "__high"), "ts_ms", "__low", "__high", rules.horizon, keys=keys).where("ts_ms < __stop")
    own = Window.partitionBy(*keys, "start_ms").orderBy("ts_ms")  # at most a horizon of ticks
    broken = F.when(F.col("ts_ms") - F.lag("ts_ms").over(own) <= rules.tick * 1.5, 0).otherwise(1)
    runs = near.withColumn("__broken", broken).withColumn("__run", F.sum("__broken").over(own)).groupBy(*keys, "start_ms", "__run").agg(F.min("ts_ms").alias("__from"), F.count(F.lit(1)).alias("__n"))
    need = max(1, math.ceil(rules.stable / max(rules.tick, 1)))
    released = runs.where(F.col("__n") >= need).groupBy(*keys, "start_ms").agg(F.min("__from").alias("__released"))
    out = e.join(released, [*keys, "start_ms"], "left")
    is_next = F.col("next_ms").isNotNull() & (F.col("next_ms") < natural) & (F.col("next_ms") <= F.col("__end"))
    how = F.when(F.col("__released").isNotNull(), "released").when(is_next, "next").when(F.col("__end") >= F.col("end_ms") + rules.horizon, "horizon").otherwise("censored")
    value = F.when(how == "released", F.col("__released") - F.col("end_ms")).when(how == "next", F.col("next_ms") - F.col("end_ms")).when(how == "horizon", F.lit(rules.horizon).cast("long"))
    return out.select(*keys, "start_ms", "end_ms", "tier", how.alias("how"), value.alias("oversampling_ms"))


def reconstruction(ticks: DataFrame, decisions: DataFrame, keys: Sequence[str], chunk: int = DAY) -> DataFrame:
    """mid_mae_bp and imbalance_mae of holding the last sampled values.

    Ticks meet the decisions in frames that hold a chunk of time of several policies. Ticks before a chunk's first sampled
    value are brought along as lists, till the value held from the chunks before is known.
    """
    keys, values = list(keys), {"mid": "mid_mae_bp", "imbalance": "imbalance_mae"}
    at = F.floor(F.col("ts_ms") / chunk).alias(chunks.CHUNK)
    d = decisions.select(*keys, "ts_ms", (F.col("snapshot") > 0).alias("__taken"), at, F.pmod(F.xxhash64(*keys), F.lit(chunks.SLICES)).alias(chunks.SLICE))
    # A name of its own: ticks and decisions that come of one table would share the column, and the frames lose it.
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks.SLICES - 1).cast("long"))).alias(chunks.SLICE)
    t = ticks.select((F.col("ts_ms") + 0).alias("__tick"), *(F.col(v).cast("double") for v in values), *(F.col(v).isNotNull().alias(f"__known_{v}") for v in values), at, copies)

    def summed(d: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({n: [] for n in names}, dtype=object)
        if d.empty or t.empty:  # a slice without policies, or a chunk without ticks: such a side has no columns either
            return none
        t = t.sort_values("__tick", ignore_index=True)
        place = np.searchsorted(t["__tick"].to_numpy(), d["ts_ms"].to_numpy())
        met = (place < len(t)) & (t["__tick"].to_numpy()[np.minimum(place, len(t) - 1)] == d["ts_ms"].to_numpy())
        if not met.any():
            return none
        d, first = chunks.along(d.assign(__place=place)[met], keys, "ts_ms")
        out = d.iloc[first][[*keys, chunks.CHUNK]].reset_index(drop=True)
        place, taken, sizes = d["__place"].to_numpy(), d["__taken"].to_numpy(bool), chunks.lengths(first, len(d))
        begin, last = np.repeat(first, sizes), first + sizes - 1
        for v in values:
            x, known = t[v].to_numpy()[place], t[f"__known_{v}"].to_numpy(bool)[place]
            held = np.maximum.accumulate(np.where(taken & known, np.arange(len(d)), -1))
            has, counts = held >= begin, known & (x != 0) if v == "mid" else known
            off = np.abs(x[held] - x)
            off = np.divide(off, x, out=np.zeros(len(x)), where=counts) * 10_000 if v == "mid" else off
            out[f"__sum_{v}"] = np.add.reduceat(np.where(has & counts, off, 0.0), first)
            out[f"__n_{v}"] = np.add.reduceat((has & counts).astype(np.int64), first)
            out[f"__has_{v}"], out[f"__last_{v}"] = has[last], x[held[last]]
            out[f"__lead_{v}"] = [x[i:j][~has[i:j] & counts[i:j]] for i, j in zip(first.tolist(), (last + 1).tolist(), strict=True)]
        return out

    key_fields = [f"{f.name} {f.dataType.simpleString()}" for f in d.select(*keys, chunks.CHUNK).schema]
    schema = ", ".join([*key_fields, *(f"__sum_{v} double, __n_{v} long, __has_{v} boolean, __last_{v} double, __lead_{v} array<double>" for v in values)])
    names = [f.split()[0] for f in schema.split(", ")]
    by = (chunks.SLICE, chunks.CHUNK)
    found = d.groupBy(*by).cogroup(t.groupBy(*by)).applyInPandas(summed, schema)
    number = lambda c: F.coalesce(c, F.lit(float("nan")))  # noqa: E731  frames give null for what is not a number
    earlier = Window.partitionBy(*keys).orderBy(chunks.CHUNK).rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
    found = found.withColumns({f"__before_{v}": F.last(F.when(F.col(f"__has_{v}"), number(F.col(f"__last_{v}"))), ignorenulls=True).over(earlier) for v in values})
    out = []
    for v, name in values.items():
        before, lead = F.col(f"__before_{v}"), F.col(f"__lead_{v}")
        miss = lambda x: F.abs(before - number(x))  # noqa: B023, E731
        off = (lambda x: miss(x) / number(x) * 10_000) if v == "mid" else miss  # noqa: B023
        late = F.aggregate(F.transform(lead, lambda x: off(x)), F.lit(0.0), lambda total, x: total + x)  # noqa: B023
        sums = F.sum(number(F.col(f"__sum_{v}")) + F.when(before.isNotNull(), late).otherwise(0.0))
        n = F.sum(F.col(f"__n_{v}") + F.when(before.isNotNull(), F.size(lead)).otherwise(0))
        out.append(F.when(n > 0, sums / n).alias(name))
    return found.groupBy(*keys).agg(*out)


def align(ticks: DataFrame, decisions: DataFrame, keys: Sequence[str], interval: int = 5000) -> DataFrame:
    """A decision for every tick: missing ones are slow and without a snapshot."""
    every = ticks.select("ts_ms").crossJoin(F.broadcast(decisions.select(*keys).distinct()))
    joined = every.join(decisions, [*keys, "ts_ms"], "left")
    return joined.withColumns({"interval_ms": F.coalesce("interval_ms", F.lit(interval)), "snapshot": F.coalesce("snapshot", F.lit(0))})


def evaluate(ticks: DataFrame, decisions: DataFrame, strong: DataFrame, lone: DataFrame, rules: Rules, keys: Sequence[str], gates: dict[str, float] = GATES, errors: bool = True) -> DataFrame:
    """One row for each policy: recalls, reactions, oversampling, false-fast time, reduction, errors (if asked for) and gates."""
    keys = list(keys)
    both = strong.select("start_ms", "end_ms", "tier").unionByName(lone.select("start_ms", "end_ms", "tier"))
    seen = capture(both, decisions, rules, keys)
    of = lambda t, c: F.coalesce(F.avg(F.when(F.col("tier") == t, F.col(c).cast("int"))), F.lit(1.0))
    p = lambda c, q: F.coalesce(F.percentile(c, F.lit(q)), F.lit(0.0))
    tier = lambda t, c: F.when(F.col("tier") == t, F.col(c))
    recalls = seen.groupBy(*keys).agg(
        *(F.count_if(F.col("tier") == t).alias(f"tier_{t.lower()}_event_count") for t in "ABC"),
        *(of(t, "covered").alias(f"tier_{t.lower()}_recall") for t in "ABC"),
        *(of(t, "snap_covered").alias(f"tier_{t.lower()}_snapshot_recall") for t in "ABC"),
        *(of(t, "prearmed").alias(f"tier_{t.lower()}_prearmed_recall") for t in "AB"),
        p("reaction_ms", 0.5).alias("reaction_median_ms"),
        p("reaction_ms", 0.95).alias("reaction_p95_ms"),  # over all tiers
        *(p(tier(t, "reaction_ms"), 0.95).alias(f"tier_{t.lower()}_reaction_p95_ms") for t in "AB"),
    )
    over = oversampling(strong, decisions, rules, keys).groupBy(*keys).agg(p("oversampling_ms", 0.5).alias("oversampling_median_ms"), p("oversampling_ms", 0.95).alias("oversampling_p95_ms"), *(F.count_if(F.col("how") == h).alias(f"oversampling_{h}") for h in ("released", "next", "horizon", "censored")))
    mask = context_mask(ticks, strong, rules).withColumn("__in", F.lit(True))
    placed = decisions.select(*keys, "ts_ms", "interval_ms", "snapshot").join(mask, "ts_ms", "left")
    fast, outside = F.col("interval_ms") <= rules.required["B"], F.col("__in").isNull()
    baseline = F.floor((F.max("ts_ms") - F.min("ts_ms")) / rules.base) + 1
    usage = placed.groupBy(*keys).agg(
        (F.count_if(fast & outside) / F.greatest(F.count_if(outside), F.lit(1))).alias("false_fast_time"), F.avg(fast.cast("int")).alias("fast_time_fraction"), F.count_if(F.col("snapshot") > 0).alias("snapshot_count"), baseline.alias("base_snapshot_count"),
    )
    out = decisions.select(*keys).distinct()
    for part in (recalls, over, usage, *([reconstruction(ticks, decisions, keys, rules.tick * CHUNK_TICKS)] if errors else [])):
        out = out.join(part, keys, "left")
    a, b = (F.coalesce(f"tier_{t}_event_count", F.lit(0)) for t in "ab")
    wa, wb = rules.weights
    total = F.nullif(wa * a + wb * b, F.lit(0.0))
    empty = {c: F.coalesce(c, F.lit(1.0)) for t in "abc" for c in (f"tier_{t}_recall", f"tier_{t}_snapshot_recall")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("reaction_p95_ms", "oversampling_p95_ms")}
    out = out.withColumns(empty).withColumn("ab_weighted_recall", F.coalesce((wa * F.col("tier_a_recall") * a + wb * F.col("tier_b_recall") * b) / total, F.lit(1.0)))
    out = out.withColumn("snapshot_reduction", 1 - F.col("snapshot_count") / F.greatest(F.col("base_snapshot_count"), F.lit(1)))
    return gated(out, gates)


def gated(metrics: DataFrame, gates: dict[str, float] = GATES) -> DataFrame:
    """Adds checks (map from gate to whether it holds), gates_passed and pass."""
    ok = {g: F.col(g) <= limit if g in _AT_MOST else F.col(g) >= limit for g, limit in gates.items()}
    passed = sum((c.cast("int") for c in ok.values()), F.lit(0))
    return metrics.withColumn("checks", F.create_map(*(x for g, c in ok.items() for x in (F.lit(g), c)))).withColumn("gates_passed", passed).withColumn("pass", F.col("gates_passed") == len(gates))


def gate_report(metrics: DataFrame) -> DataFrame:
    """gate, and how many policies pass it."""
    return metrics.select(F.explode("checks").alias("gate", "ok")).groupBy("gate").agg(F.count_if("ok").alias("n_passed"), F.count(F.lit(1)).alias("n"))


def range_report(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """metric, least, most and n (policies that have a value) of each of the columns over all policies."""
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns)))
    return metrics.select(values.alias("v")).groupBy("v.metric").agg(F.min("v.value").alias("least"), F.max("v.value").alias("most"), F.count("v.value").alias("n"))
