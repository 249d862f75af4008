"""Queries on rolling, calendar and exponential features of the hourly grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.numeric import rounded
from ..operators import features as f
from .domain import GRID, HOUR, hourly_grid, r6

KEYS, AT = ["channel"], "bar_ms"
SPANS = (1, 3, 6, 24)


def _shown(df: DataFrame, names) -> DataFrame:
    return df.select(*KEYS, AT, *(rounded(c).alias(c) for c in f.tidy(df, names).select(*names).columns))


def _query(make, longest: int = 24):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        names: list[str] = []

        def build(r: f.Rolling):
            out = make(r)
            names.extend(out)
            return out

        df = f.rolling(hourly_grid(spark, sf_dir), KEYS, AT, HOUR, longest, build, f.one_step)
        return _shown(f.tidy(df, names), names)

    return query


def calendar_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = f.calendar(AT)
    return hourly_grid(spark, sf_dir).where("channel = 'spot'").select(AT, *(rounded(c).alias(n) for n, c in parts.items()))


def ema_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = hourly_grid(spark, sf_dir)
    for w in (1, 12):
        grid = f.ema(grid, KEYS, AT, "close", w, f"ema_{w}")
    gap = lambda w: rounded((grid["close"] / grid[f"ema_{w}"] - 1) * 1e4, 4).alias(f"ema_gap_{w}")
    return grid.select(*KEYS, AT, gap(1), gap(12))


QUERIES = {
    "rolling_returns": _query(lambda r: f.returns(r, SPANS)),
    "rolling_vol": _query(lambda r: f.volatility(r, SPANS)),
    "rolling_range": _query(lambda r: f.ranges(r, SPANS)),
    "dist_high_low": _query(lambda r: f.distances(r, SPANS)),
    "volume_z": _query(lambda r: f.z_scores(r, "volume", SPANS)),
    "delta_rollups": _query(lambda r: f.delta_sums(r, SPANS)),
    "mean_rollups": _query(lambda r: f.means(r, ["turnover", "n", "range_bps"], SPANS)),
    "change_bps": _query(lambda r: f.changes(r, "open", (5, 15, 60, 240), 60), 60),
    "calendar_cyclic": calendar_cyclic,
    "ema_gap": ema_gap,
}


def _sql(columns: dict[str, str]) -> str:
    shown = ", ".join(f"{r6(c)} AS {c}" for c in columns)
    made = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    return f"""WITH {GRID}, base AS (SELECT *, (close / lag(close) OVER (PARTITION BY channel ORDER BY bar_ms) - 1) * 1e4 AS ret_1, (high - low) / close * 1e4 AS range_bps FROM grid),
        made AS (SELECT channel, bar_ms, {made} FROM base) SELECT channel, bar_ms, {shown} FROM made"""


def _over(e: str, w: int) -> str:
    return f"{e} OVER (PARTITION BY channel ORDER BY bar_ms ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def _back(c: str, w: int) -> str:
    return f"({c} / nullif(lag({c}, {w}) OVER (PARTITION BY channel ORDER BY bar_ms), 0) - 1) * 1e4"


def _volatility(w: int) -> str:
    least = 1 if w == 1 else max(2, min(w, 3))
    return f"CASE WHEN {_over('count(ret_1)', w)} >= {least} THEN {_over('stddev_samp(ret_1)', w)} END * sqrt({w})"


def _z(w: int) -> str:
    return f"(volume - {_over('avg(volume)', w)}) / nullif(CASE WHEN {_over('count(volume)', w)} >= {1 if w == 1 else 2} THEN {_over('stddev_samp(volume)', w)} END, 0)"


_EMA = ", ".join(f"CASE WHEN g.close IS NULL THEN e.e{w} WHEN e.e{w} IS NULL THEN g.close ELSE e.e{w} + {2 / (max(2, w) + 1)!r} * (g.close - e.e{w}) END" for w in (1, 12))
ORACLE = {
    "rolling_returns": _sql({f"ret_{w}": _back("close", w) for w in SPANS}).replace("SELECT channel, bar_ms, " + _back("close", 1) + " AS ret_1", "SELECT channel, bar_ms, ret_1"),
    "rolling_vol": _sql({f"rv_{w}": _volatility(w) for w in SPANS}),
    "rolling_range": _sql({f"range_mean_{w}": _over("avg(range_bps)", w) for w in SPANS}),
    "dist_high_low": _sql({n: e for w in SPANS for n, e in ((f"dist_high_{w}", f"(close / {_over('max(high)', w)} - 1) * 1e4"), (f"dist_low_{w}", f"(close / {_over('min(low)', w)} - 1) * 1e4"))}),
    "volume_z": _sql({f"volume_z_{w}": _z(w) for w in SPANS}),
    "delta_rollups": _sql({n: e for w in SPANS for n, e in ((f"delta_sum_{w}", _over("sum(delta)", w)), (f"delta_ratio_mean_{w}", _over("avg(delta / nullif(volume, 0))", w)))}),
    "mean_rollups": _sql({f"{c}_mean_roll{w}": _over(f"avg({c})", w) for c in ("turnover", "n", "range_bps") for w in SPANS}),
    "change_bps": _sql({f"open_change_{w}": _back("open", w) for w in (5, 15, 60)}),
    "calendar_cyclic": f"""WITH {GRID}, c AS (SELECT bar_ms, bar_ms % 86400000 / 86400000.0 * 2 * pi() AS d, isodow(make_timestamp(bar_ms * 1000)) - 1 AS w FROM grid WHERE channel = 'spot')
        SELECT bar_ms, {r6("sin(d)")} AS tod_sin, {r6("cos(d)")} AS tod_cos, {r6("sin(w / 7.0 * 2 * pi())")} AS dow_sin, {r6("cos(w / 7.0 * 2 * pi())")} AS dow_cos FROM c""",
    "ema_gap": f"""WITH RECURSIVE {GRID}, first AS (SELECT min(bar_ms) AS f FROM grid),
        e AS (SELECT channel, bar_ms, close, close AS e1, close AS e12 FROM grid, first WHERE bar_ms = f
              UNION ALL SELECT g.channel, g.bar_ms, g.close, {_EMA} FROM e JOIN grid g ON g.channel = e.channel AND g.bar_ms = e.bar_ms + 3600000)
        SELECT channel, bar_ms, floor((close / e1 - 1) * 1e4 * 10000 + 0.5) / 10000 AS ema_gap_1, floor((close / e12 - 1) * 1e4 * 10000 + 0.5) / 10000 AS ema_gap_12 FROM e""",
}
