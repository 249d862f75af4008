"""Windows over long series that one task need not hold.

A series of one instrument has no natural key to spread by, and `Window.partitionBy(symbol)` would send all of it to a
task. Series are therefore cut into chunks of time. Frames of bounded length get copies of the neighbouring rows they
reach (`in_chunks`); values that may come from any distance are carried from chunk to chunk by one small row for each
(`carry`); recurrences are solved in two passes, for all chunks at once (`scan`; `solve` for many series at a time).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import col

CHUNK, OWN, SLICE = "__chunk", "__own", "__slice"

#: Among how many frames the series of one chunk of time are dealt out.
SLICES = 64


def in_chunks(df: DataFrame, at: str, chunk: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """Adds CHUNK, and OWN: false on copies that serve as context.

    A chunk sees the rows from `back` before its start to `ahead` after its end. Windows are to be partitioned by
    CHUNK as well, and rows without OWN dropped afterwards.
    """
    spread = F.sequence(F.floor((F.col(at) - ahead) / chunk), F.floor((F.col(at) + back) / chunk))
    out = df.withColumn(CHUNK, F.explode(spread))
    return out.withColumn(OWN, F.col(CHUNK) == F.floor(F.col(at) / chunk))


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(OWN).drop(CHUNK, OWN)


def carry(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, values: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """For each name the last non-null value up to the row (inclusive) or before it, over the whole series.

    chunk must not decrease along `order`. Within a chunk a window finds the value; across chunks it comes from a
    table with one row for each chunk.
    """
    base = df.withColumn(CHUNK, chunk)
    keys = list(keys)
    along = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    place = F.struct(*order)
    last = base.groupBy(*keys, CHUNK).agg(*(F.max_by(v, F.when(v.isNotNull(), place)).alias(f"__last_{n}") for n, v in values.items()))
    over = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    before = last.select(*keys, CHUNK, *(F.last(f"__last_{n}", ignorenulls=True).over(over).alias(f"__before_{n}") for n in values))
    named = {k: f"__key_{k}" for k in [*keys, CHUNK]}
    before = before.withColumnsRenamed(named)
    local = base.withColumns({f"__local_{n}": F.last(v, ignorenulls=True).over(along) for n, v in values.items()})
    on = F.lit(True)
    for k, other in named.items():
        on = on & local[k].eqNullSafe(F.col(other))
    joined = local.join(before, on, "left")
    done = joined.withColumns({n: F.coalesce(F.col(f"__local_{n}"), F.col(f"__before_{n}")) for n in values})
    return done.drop(CHUNK, *named.values(), *(f"__local_{n}" for n in values), *(f"__before_{n}" for n in values))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str) -> DataFrame:
    """Row numbers from 1 over the whole series: numbers within a chunk plus the rows of the chunks before."""
    keys = list(keys)
    base = df.withColumn(CHUNK, chunk)
    counts = base.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    named = {k: f"__key_{k}" for k in [*keys, CHUNK]}
    counts = counts.select(*keys, CHUNK, F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead")).withColumnsRenamed(named)
    local = base.withColumn(name, F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(*order)))
    on = F.lit(True)
    for k, other in named.items():
        on = on & local[k].eqNullSafe(F.col(other))
    return local.join(counts, on).withColumn(name, (F.col(name) + F.col("__ahead")).cast("long")).drop(CHUNK, "__ahead", *named.values())


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, summarise: Callable, resume: Callable, combine: Callable, start, schema: str) -> DataFrame:
    """Solves a recurrence whose step functions are closed under composition, chunk by chunk.

    summarise(chunk rows) gives the chunk's whole effect as a tuple of floats; combine(state, effect) applies it;
    resume(chunk rows, state) gives the result rows from the state before the chunk. Chunks of one key are held one at
    a time; only one effect for each chunk is brought together. schema: of the results, with the chunk's columns.
    """
    keys, base = list(keys), df.withColumn(CHUNK, chunk)
    order = list(order)
    arity = len(summarise(None))
    names = [f"__e{i}" for i in range(arity)]
    key_fields = [f"{f.name} {f.dataType.simpleString()}" for f in base.select(*keys, CHUNK).schema]

    def effect(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {k: [pdf[k].iloc[0]] for k in [*keys, CHUNK]}
        return pd.DataFrame(head | {n: [v] for n, v in zip(names, summarise(pdf.sort_values(order)), strict=True)})

    effects = base.groupBy(*keys, CHUNK).applyInPandas(effect, ", ".join([*key_fields, *(f"{n} double" for n in names)]))

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, out = pdf.sort_values(CHUNK), start, []
        for e in pdf[names].itertuples(index=False):
            out.append(state)
            state = combine(state, tuple(e))
        return pdf[[*keys, CHUNK]].assign(__state=out)

    begun = effects.groupBy(*keys).applyInPandas(states, ", ".join([*key_fields, "__state double"])) if keys else effects.groupBy(F.lit("")).applyInPandas(states, ", ".join([*key_fields, "__state double"]))
    joined = base.join(begun, [*keys, CHUNK])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return resume(pdf.sort_values(order), float(pdf["__state"].iloc[0]))

    return joined.groupBy(*keys, CHUNK).applyInPandas(run, schema)


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str, value: Column | str) -> DataFrame:
    """The value in the row before, null in the first row (lag over the whole series)."""
    held = F.struct(col(value).alias("v"))
    return carry(df, keys, order, chunk, {name: held}, inclusive=False).withColumn(name, F.col(name)["v"])


def solve(df: DataFrame, keys: Sequence[str], at: str, chunk: Column, summarise: Callable, effects: str, advance: Callable, start, resume: Callable, schema: str, needs: Sequence[str] | None = None) -> DataFrame:
    """`scan` for many series that are alike: a frame holds one chunk of several series, so that a frame's own cost is not
    paid for each series.

    Frames are ordered by series and time; first: the place of each series' first row. summarise(frame, first) gives the
    columns `effects`, one row for each series; advance(state, effect) the state after the chunk; resume(frame, first,
    states) the result rows. start: an int, a float or a vector of floats, the state before a series. needs: columns that summarise sees beside
    keys and at, where df is cheaper read again than shuffled whole; else one shuffle serves both passes.
    """
    keys = list(keys)
    base = df.withColumns({CHUNK: chunk, SLICE: F.pmod(F.xxhash64(*keys), F.lit(SLICES)) if keys else F.lit(0).cast("long")})
    if needs is None:  # a fixed number of tasks: frames may ask far more work than their bytes tell
        base = base.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), SLICE, CHUNK)
    place = [*keys, CHUNK, SLICE]
    head = [f"{f.name} {f.dataType.simpleString()}" for f in base.select(*place).schema]

    def effect(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, first = along(pdf, keys, at)
        return pd.concat([pdf[place].iloc[first].reset_index(drop=True), summarise(pdf, first)], axis=1)

    seen = base if needs is None else base.select(*place, at, *needs)
    found = seen.groupBy(SLICE, CHUNK).applyInPandas(effect, ", ".join([*head, effects]))
    names = [c.split()[0] for c in effects.split(", ")]

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, first = along(pdf, keys, CHUNK)
        first, state, out = set(first.tolist()), start, []
        for n, e in enumerate(pdf[names].itertuples(index=False)):
            state = start if n in first else state
            out.append(state)
            state = advance(state, tuple(e))
        return pdf[place].assign(__state=out)

    kind = "array<double>" if isinstance(start, np.ndarray) else "long" if isinstance(start, int) else "double"
    begun = found.groupBy(SLICE).applyInPandas(states, ", ".join([*head, f"__state {kind}"]))

    def run(pdf: pd.DataFrame, begun: pd.DataFrame) -> pd.DataFrame:
        begun = begun.sort_values(keys) if keys else begun
        return resume(*along(pdf, keys, at), begun["__state"].to_numpy())

    return base.groupBy(SLICE, CHUNK).cogroup(begun.groupBy(SLICE, CHUNK)).applyInPandas(run, schema)


def along(pdf: pd.DataFrame, keys: Sequence[str], at: str) -> tuple[pd.DataFrame, np.ndarray]:
    """The frame ordered by series and time, and the place of each series' first row. Keys are compared once for each series."""
    number = pdf.groupby(list(keys), dropna=False).ngroup().to_numpy() if keys else np.zeros(len(pdf), int)
    order = np.lexsort((pdf[at].to_numpy(), number))
    return pdf.take(order).reset_index(drop=True), np.flatnonzero(np.diff(number[order], prepend=-1))


def lengths(first: np.ndarray, n: int) -> np.ndarray:
    """Rows of each series of a frame of n rows."""
    return np.diff(first, append=n)


def _nexts(at: np.ndarray, due: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each row the row that is chosen after it: the first later one whose `due` isn't before it, or its series' end."""
    out, open_rows, ahead = end.copy(), np.arange(len(at)), 1
    open_rows = open_rows[open_rows + 1 < end]
    while len(open_rows):
        found = due[open_rows + ahead] >= at[open_rows]
        out[open_rows[found]] = open_rows[found] + ahead
        ahead += 1
        open_rows = open_rows[~found]
        open_rows = open_rows[open_rows + ahead < end[open_rows]]
    return out


def greedy(df: DataFrame, keys: Sequence[str], at: str, chunk: Column, due: str, name: str) -> DataFrame:
    """Adds `name`: 1 for rows that a greedy choice along `at` takes, else 0.

    A series' first row is taken, and each row whose `due` isn't before the last one taken. What a chunk does to the
    last row taken before it is a step function of that row's time, with as many steps as rows that can come first; so
    each chunk is solved by itself, and only these steps are brought together. Times differ within a series, and columns
    hold no nulls.
    """
    none = int(np.iinfo(np.int64).min)

    def steps(pdf: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        t, d, n = pdf[at].to_numpy(), pdf[due].to_numpy(), len(pdf)
        sizes = lengths(first, n)
        stop = np.repeat(first + sizes, sizes)
        last, after = list(range(n)), _nexts(t, d, stop)
        after = np.where(after < stop, after, np.arange(n)).tolist()
        for i in range(n - 1, -1, -1):  # the last row of the choice that begins with a row
            last[i] = last[after[i]]
        bounds, ends = [], []
        for begin, size in zip(first.tolist(), sizes.tolist(), strict=True):
            reach, low, high = None, [], []
            for i in range(begin, begin + size):  # ends where a row comes first whatever was taken before the chunk
                if reach is None or d[i] > reach:
                    reach = d[i]
                    low.append(int(reach))
                    high.append(int(t[last[i]]))
                    if reach >= t[begin]:
                        break
            bounds.append(low)
            ends.append(high)
        return pd.DataFrame({"__bounds": bounds, "__ends": ends})

    def advance(last: int, effect: tuple) -> int:
        bounds, ends = effect
        at_step = int(np.searchsorted(bounds, last))
        return int(ends[at_step]) if at_step < len(ends) else last

    def run(pdf: pd.DataFrame, first: np.ndarray, states: np.ndarray) -> pd.DataFrame:
        t, d, n = pdf[at].to_numpy(), pdf[due].to_numpy(), len(pdf)
        sizes = lengths(first, n)
        stop = first + sizes
        nexts, marks, taken = _nexts(t, d, np.repeat(stop, sizes)).tolist(), np.zeros(n, np.int32), []
        free = np.flatnonzero(d >= np.repeat(states, sizes))
        at_free = np.searchsorted(free, first)
        for place, end in zip(at_free.tolist(), stop.tolist(), strict=True):
            i = int(free[place]) if place < len(free) else end
            while i < end:
                taken.append(i)
                i = nexts[i]
        marks[taken] = 1
        return pdf.drop(columns=[CHUNK, SLICE]).assign(**{name: marks})

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), f"{name} int"])
    return solve(df, keys, at, chunk, steps, "__bounds array<long>, __ends array<long>", advance, none, run, schema, [due])
