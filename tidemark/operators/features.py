"""Rolling and calendar features on a gap-free grid.

Look-backs count rows of the grid. All windows of a set share one shuffle: the grid is cut into chunks that hold the
longest look-back of rows before them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.numeric import change_bps, finite, ratio
from .chunks import CHUNK, in_chunks, own_rows, scan


class Rolling:
    """Window expressions over the last w rows of the grid."""

    def __init__(self, keys: Sequence[str], at: str):
        self.by = Window.partitionBy(*keys, CHUNK).orderBy(at)

    def last(self, w: int) -> WindowSpec:
        return self.by.rowsBetween(-(w - 1), 0)

    def lag(self, c: str, n: int) -> Column:
        return F.lag(c, n).over(self.by)

    def enough(self, value: Column, c: str, w: int, least: int) -> Column:
        """value where at least so many rows of the window hold c."""
        return F.when(F.count(c).over(self.last(w)) >= least, value)


def rolling(grid: DataFrame, keys: Sequence[str], at: str, step: int, longest: int, make: Callable[[Rolling], dict[str, Column]], prepare: Callable[[Rolling], dict[str, Column]] | None = None, chunk: int = 7 * 86_400_000) -> DataFrame:
    """grid with the features make() gives; prepare() may add columns, one row back at most, that these build on."""
    cut = in_chunks(grid, at, chunk, back=(longest + 1) * step)
    r = Rolling(keys, at)
    if prepare:
        cut = cut.withColumns(prepare(r))
    return own_rows(cut.withColumns(make(r)))


def one_step(r: Rolling) -> dict[str, Column]:
    """ret_1 and range_bps, which others build on."""
    return {"ret_1": change_bps("close", r.lag("close", 1)), "range_bps": ratio(F.col("high") - F.col("low"), "close") * 1e4}


def returns(r: Rolling, spans: Sequence[int]) -> dict[str, Column]:
    return {f"ret_{w}": change_bps("close", r.lag("close", w)) for w in spans}


def volatility(r: Rolling, spans: Sequence[int]) -> dict[str, Column]:
    """Sample deviation of one-step returns, scaled to the span; needs 1 value for a span of 1, else 2 or 3."""
    out = {}
    for w in spans:
        least = 1 if w == 1 else max(2, min(w, 3))
        out[f"rv_{w}"] = r.enough(F.stddev_samp("ret_1").over(r.last(w)), "ret_1", w, least) * math.sqrt(w)
    return out


def ranges(r: Rolling, spans: Sequence[int]) -> dict[str, Column]:
    return {f"range_mean_{w}": F.avg("range_bps").over(r.last(w)) for w in spans}


def distances(r: Rolling, spans: Sequence[int]) -> dict[str, Column]:
    out = {}
    for w in spans:
        out[f"dist_high_{w}"] = change_bps("close", F.max("high").over(r.last(w)))
        out[f"dist_low_{w}"] = change_bps("close", F.min("low").over(r.last(w)))
    return out


def z_scores(r: Rolling, c: str, spans: Sequence[int]) -> dict[str, Column]:
    out = {}
    for w in spans:
        deviation = r.enough(F.stddev_samp(c).over(r.last(w)), c, w, 1 if w == 1 else 2)
        out[f"{c}_z_{w}"] = ratio(F.col(c) - F.avg(c).over(r.last(w)), deviation)
    return out


def delta_sums(r: Rolling, spans: Sequence[int]) -> dict[str, Column]:
    out = {}
    for w in spans:
        out[f"delta_sum_{w}"] = F.sum("delta").over(r.last(w))
        out[f"delta_ratio_mean_{w}"] = F.avg(ratio("delta", "volume")).over(r.last(w))
    return out


def means(r: Rolling, names: Sequence[str], spans: Sequence[int]) -> dict[str, Column]:
    return {f"{c}_mean_roll{w}": F.avg(c).over(r.last(w)) for c in names for w in spans}


def changes(r: Rolling, c: str, spans: Sequence[int], longest: int) -> dict[str, Column]:
    """Relative changes over spans that the longest look-back holds."""
    return {f"{c}_change_{w}": change_bps(c, r.lag(c, w)) for w in spans if w <= longest}


def calendar(at: str) -> dict[str, Column]:
    """Time of day and day of week (Monday first) as points on a circle."""
    day = F.pmod(F.col(at), F.lit(86_400_000)) / 86_400_000.0
    weekday = F.pmod(F.floor(F.col(at) / 86_400_000) + 3, F.lit(7))  # the epoch began on a Thursday
    turn = 2 * math.pi
    return {"tod_sin": F.sin(day * turn), "tod_cos": F.cos(day * turn), "dow_sin": F.sin(weekday / 7.0 * turn), "dow_cos": F.cos(weekday / 7.0 * turn)}


def tidy(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Infinities and NaN of the features become null."""
    return df.withColumns({c: finite(c) for c in dict.fromkeys(names)})


def ema(grid: DataFrame, keys: Sequence[str], at: str, c: str, span: int, name: str, chunk: int = 7 * 86_400_000) -> DataFrame:
    """Exponential mean y = y + a * (x - y) with a = 2 / (max(2, span) + 1), begun at the first value; null x repeat y.

    A chunk maps y to A * y + B, so chunks are summed up independently and joined by their (A, B).
    """
    a = 2.0 / (max(2, span) + 1)

    def summarise(pdf: pd.DataFrame | None) -> tuple[float, float]:
        if pdf is None:
            return 1.0, 0.0
        x = pdf[c].to_numpy(float)
        x = x[~np.isnan(x)]
        if not len(x):
            return 1.0, 0.0
        back = np.arange(len(x) - 1, -1, -1)
        return float((1 - a) ** len(x)), float((a * (1 - a) ** back * x).sum()) if len(x) < 5000 else _fold(x)

    def _fold(x: np.ndarray) -> float:
        y = 0.0
        for v in x.tolist():
            y += a * (v - y)
        return y

    def first_state(state: float, effect: tuple[float, ...]) -> float:
        # An unset state (NaN) is begun by the chunk's first value, which resume() does; its end is found the same way.
        return effect[2] if math.isnan(state) else effect[0] * state + effect[1]

    def with_own(pdf: pd.DataFrame | None) -> tuple[float, float, float]:
        if pdf is None:
            return 1.0, 0.0, math.nan
        y = math.nan
        for v in pdf[c].tolist():
            if v is not None and v == v:
                y = v if y != y else y + a * (v - y)
        return *summarise(pdf), y

    def resume(pdf: pd.DataFrame, y: float) -> pd.DataFrame:
        out = []
        for v in pdf[c].tolist():
            if v is not None and v == v:
                y = v if y != y else y + a * (v - y)
            out.append(y if y == y else None)
        return pdf[[*keys, at]].assign(**{name: out})

    types = {f.name: f.dataType.simpleString() for f in grid.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in (*keys, at)) + f", {name} double"
    done = scan(grid.select(*keys, at, c), keys, [at], F.floor(F.col(at) / chunk), with_own, resume, first_state, math.nan, schema)
    return grid.join(done, [*keys, at], "left")


#: Columns of enriched minutes that are features as they are. Fixed values.
DIRECT = (
    "spot_delta_ratio", "perp_delta_ratio", "spot_trade_count", "perp_trade_count", "spot_volume", "perp_volume", "perp_spot_basis_bps", "mark_index_basis_bps",
    "premium_close", "oi_openInterest", "long_short_net", "funding_fundingRate", "liq_count", "liq_volume", "liq_buy_volume", "liq_sell_volume",
)
DIRECT_BOOK = ("spread_bps_mean", "spread_bps_max", "imbalance_l50_mean", "imbalance_l50_last", "imbalance_5bps_mean", "imbalance_10bps_mean", "imbalance_25bps_mean", "imbalance_50bps_mean", "micro_dev_bps_mean", "bid_qty_l50_mean", "ask_qty_l50_mean")
BOOK_ROLLED = ("imbalance_l50_mean", "imbalance_10bps_mean", "imbalance_25bps_mean", "spread_bps_mean", "micro_dev_bps_mean")
BOOKS = ("spot_ob", "perp_ob")


def passed_through(df: DataFrame) -> list[str]:
    """The direct features that df has, in their order."""
    return [c for c in (*DIRECT, *(f"{p}_{c}" for p in BOOKS for c in DIRECT_BOOK)) if c in df.columns]


def book_means(r: Rolling, columns: Sequence[str], spans: Sequence[int]) -> dict[str, Column]:
    """Rolling means of the books' minute means, of those columns that there are."""
    return {f"{p}_{c}_roll{w}": F.avg(f"{p}_{c}").over(r.last(w)) for w in spans for p in BOOKS for c in BOOK_ROLLED if f"{p}_{c}" in columns}
