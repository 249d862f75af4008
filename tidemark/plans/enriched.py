"""Queries on order-book minutes and on minutes enriched by every series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import asof, bars, book, features, relational
from .domain import TRADES, r6, trades
from .pattern_plans import _BOOK, _snapshots, _sum

MINUTE, HOUR = 60_000, 3_600_000
SPANS = (5, 15)
PREFIXES = {"spot": "spot_ob", "perp": "perp_ob"}
#: Time between two snapshots; markets take turns.
EVERY = 15_000
#: Series as parts of the trades: condition, and the value's name with its expression, for Spark and SQL alike.
SERIES = {
    "perp": ("channel = 'perp'", {"close": "price", "volume": "size", "turnover": "price * size"}),
    "mark": ("event_type = 'view'", {"close": "price"}),
    "index": ("event_type = 'click'", {"close": "price"}),
    "premium": ("event_type = 'signup'", {"close": "value / 100"}),
    "oi": ("event_type = 'purchase'", {"openInterest": "size * 10", "singleOpenInterest": "size"}),
    "ls": ("event_type = 'error'", {"buyRatio": "size / (size + 40.0)", "sellRatio": "40.0 / (size + 40.0)"}),
    "funding": ("user_id % 10 = 0", {"fundingRate": "value / 1000"}),
}


def _book_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _snapshots(spark, sf_dir)
    stats = book.sample_stats(F.col("bids"), F.col("asks"))
    market = F.when(F.col("vec_id") % 2 == 0, "spot").otherwise("perp")
    samples = s.select(market.alias("market"), (F.col("vec_id") * EVERY).cast("long").alias("ts_ms"), F.col("vec_id").alias("event_id"), *(c.alias(n) for n, c in stats.items()))
    return book.book_minutes(samples, PREFIXES)


def book_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _book_minutes(spark, sf_dir)
    return out.select("minute_ms", *(c if c.endswith("_samples") else rounded(c).alias(c) for c in out.columns[1:]))


def book_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = _book_minutes(spark, sf_dir)
    grid = asof.time_grid(minutes, "minute_ms", MINUTE).join(minutes, "minute_ms", "left").withColumn("book", F.lit(1))
    names: list[str] = []

    def build(r: features.Rolling):
        out = features.book_means(r, minutes.columns, SPANS)
        names.extend(out)
        return out

    out = features.rolling(grid, ["book"], "minute_ms", MINUTE, max(SPANS), build)
    return out.select("minute_ms", *(rounded(c).alias(c) for c in names))


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spot grid by hours, with the micro columns of each hour and all other series as of it."""
    t = trades(spark, sf_dir)
    spot = asof.fill_bars(bars.ohlcv(t.where("channel = 'spot'"), HOUR), "bar_ms", HOUR).select(F.col("bar_ms").alias("minute_ms"), "close")
    micro = bars.minute_micro(t, HOUR)
    short = {c: c.replace("liquidation_", "liq_") if c.endswith("_count") else c.replace("_trade_", "_").replace("liquidation_", "liq_") for c in micro.columns}
    base = spot.join(micro.withColumnsRenamed(short), "minute_ms", "left")
    series = {}
    for name, (own, values) in SERIES.items():
        rows = t.where(own).select("ts_ms", "event_id", *(F.expr(e).cast("double").alias(v) for v, e in values.items()))
        series[name] = relational.keep_last(rows, ["ts_ms"], ["event_id"]), "ts_ms", list(values)
    base = base.withColumnsRenamed({"perp_volume": "perp_volume_traded", "perp_turnover": "perp_turnover_traded"})
    out = asof.asof_joins(base, "minute_ms", series).withColumnsRenamed({"perp_volume": "perp_kline_volume", "perp_turnover": "perp_kline_turnover"})
    out = out.withColumnsRenamed({"perp_volume_traded": "perp_volume", "perp_turnover_traded": "perp_turnover"})
    return asof.derived(asof.zero_filled(out), HOUR)


def enriched_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _enriched(spark, sf_dir)
    return out.select(*(c if c.endswith(("_ms", "_count")) else rounded(c).alias(c) for c in out.columns))


def passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _enriched(spark, sf_dir)
    return out.select("minute_ms", *(c if c.endswith("_count") else rounded(c).alias(c) for c in features.passed_through(out)))


def book_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _book_minutes(spark, sf_dir)
    return out.select("minute_ms", *(rounded(c).alias(c) for c in features.passed_through(out)))


def _near(side: str, w: int) -> str:
    return _sum(side, f"abs(x.price - mid) <= mid * {w / 1e4!r}")


_IMB = "({0} - {1}) / nullif({0} + {1}, 0)"
_STATS = {"spread_bps": "(a[1].price - b[1].price) / mid * 1e4", "bid_qty_l50": _sum("b"), "ask_qty_l50": _sum("a"), "imbalance_l50": _IMB.format(_sum("b"), _sum("a"))}
_STATS["micro_dev_bps"] = "((a[1].price * b[1].qty + b[1].price * a[1].qty) / (b[1].qty + a[1].qty) / mid - 1) * 1e4"
for _w in book.BANDS:
    _STATS |= {f"bid_qty_{_w}bps": _near("b", _w), f"ask_qty_{_w}bps": _near("a", _w), f"imbalance_{_w}bps": _IMB.format(_near("b", _w), _near("a", _w))}
_AGG = {"sum": "sum({0}) FILTER ({1})", "last": "arg_max({0}, vec_id) FILTER ({1} AND {0} IS NOT NULL)", "min": "min({0}) FILTER ({1})", "max": "max({0}) FILTER ({1})", "mean": "avg({0}) FILTER ({1})"}


def _own(market: str) -> str:
    return f"vec_id % 2 = {0 if market == 'spot' else 1}"


_MINUTES = f"""{_BOOK}, st AS (SELECT vec_id, {", ".join(f"{e} AS {n}" for n, e in _STATS.items())} FROM tops),
    minutes AS (SELECT vec_id * {EVERY} // {MINUTE} * {MINUTE} AS minute_ms, {", ".join([*(f"nullif(count(*) FILTER ({_own(m)}), 0) AS {p}_samples" for m, p in PREFIXES.items()), *(f"{a.format(s, _own(m))} AS {p}_{s}_{k}" for m, p in PREFIXES.items() for s in _STATS for k, a in _AGG.items())])} FROM st GROUP BY 1)"""
_ROLLED = [f"{p}_{c}" for p in features.BOOKS for c in features.BOOK_ROLLED]


def _micro_sql() -> str:
    out = []
    for ch, p in (("spot", "spot"), ("perp", "perp"), ("liquidation", "liq")):
        own, trade = f"FILTER (channel = '{ch}')", "_trade" if p != "liq" else ""
        out += [f"coalesce(count(*) {own}, 0) AS {p}{trade}_count", f"coalesce({r6(f'sum(size) {own}')}, 0) AS {p}_volume"]
        if p != "liq":
            out.append(f"coalesce({r6(f'sum(price * size) {own}')}, 0) AS {p}_turnover")
        out += [f"coalesce({r6(f"sum(CASE side WHEN '{s}' THEN size ELSE 0 END) {own}")}, 0) AS {p}_{s.lower()}_volume" for s in ("Buy", "Sell")]
    return f"SELECT ts_ms // {HOUR} * {HOUR} AS minute_ms, {', '.join(out)} FROM trades GROUP BY 1"


def _series_sql(name: str) -> str:
    own, values = SERIES[name]
    return f"s_{name} AS (SELECT ts_ms, {', '.join(f'arg_max(CAST({e} AS DOUBLE), event_id) AS {name}_{v}' for v, e in values.items())} FROM trades WHERE {own} GROUP BY ts_ms)"


_MICRO = ["spot_trade_count", "spot_volume", "spot_turnover", "spot_buy_volume", "spot_sell_volume", "perp_trade_count", "perp_volume", "perp_turnover", "perp_buy_volume", "perp_sell_volume", "liq_count", "liq_volume", "liq_buy_volume", "liq_sell_volume"]
_VALUES = {"perp_close": "perp_close", "perp_kline_volume": "coalesce(perp_volume, 0)", "perp_kline_turnover": "coalesce(perp_turnover, 0)"} | {f"{n}_{v}": f"{n}_{v}" for n, (_, values) in SERIES.items() if n != "perp" for v in values}
_DERIVED = {f"{p}_delta": f"{p}_buy_volume - {p}_sell_volume" for p in ("spot", "perp")}
_DERIVED |= {f"{p}_delta_ratio": f"({p}_buy_volume - {p}_sell_volume) / nullif({p}_buy_volume + {p}_sell_volume, 0)" for p in ("spot", "perp")}
_DERIVED |= {f"{p}_trade_vwap": f"{p}_turnover / nullif({p}_volume, 0)" for p in ("spot", "perp")}
_DERIVED |= {"perp_spot_basis_bps": "(perp_close / nullif(close, 0) - 1) * 1e4", "mark_index_basis_bps": "(mark_close / nullif(index_close, 0) - 1) * 1e4", "long_short_net": "ls_buyRatio - ls_sellRatio"}
_FULL = f"""WITH {TRADES}, spot AS (SELECT ts_ms // {HOUR} * {HOUR} AS minute_ms, arg_max(price, (ts_ms, event_id)) AS c FROM trades WHERE channel = 'spot' GROUP BY 1),
    g AS (SELECT unnest(range(min(minute_ms), max(minute_ms) + 1, {HOUR})) AS minute_ms FROM spot),
    f AS (SELECT minute_ms, last_value(c IGNORE NULLS) OVER (ORDER BY minute_ms) AS close FROM g LEFT JOIN spot USING (minute_ms)),
    m AS ({_micro_sql()}), {", ".join(_series_sql(n) for n in SERIES)},
    j AS (SELECT f.minute_ms, close, {", ".join(f"coalesce(m.{c}, 0) AS {c}" for c in _MICRO)}, {", ".join(f"s_perp.{v} AS k_{v}" for v in ("perp_close", "perp_volume", "perp_turnover"))}, {", ".join(v for v in _VALUES if not v.startswith("perp_"))}
        FROM f LEFT JOIN m ON f.minute_ms = m.minute_ms {" ".join(f"ASOF LEFT JOIN s_{n} ON f.minute_ms >= s_{n}.ts_ms" for n in SERIES)}),
    e AS (SELECT * EXCLUDE (k_perp_close, k_perp_volume, k_perp_turnover), k_perp_close AS perp_close, coalesce(k_perp_volume, 0) AS perp_kline_volume, coalesce(k_perp_turnover, 0) AS perp_kline_turnover FROM j),
    d AS (SELECT *, {", ".join(f"{x} AS {n}" for n, x in _DERIVED.items())}, minute_ms + {HOUR} AS available_ms FROM e)"""
_ALL = ["close", *_MICRO, *_VALUES, *_DERIVED]
ORACLE = {
    "book_minutes": f"WITH {_MINUTES} SELECT minute_ms, {', '.join(f'{p}_samples' for p in PREFIXES.values())}, {', '.join(f'{r6(c)} AS {c}' for c in (f'{p}_{s}_{k}' for p in PREFIXES.values() for s in _STATS for k in _AGG))} FROM minutes",
    "book_rollups": f"""WITH {_MINUTES}, gr AS (SELECT unnest(range(min(minute_ms), max(minute_ms) + 1, {MINUTE})) AS minute_ms FROM minutes),
        ro AS (SELECT minute_ms, {", ".join(f"avg({c}) OVER (ORDER BY minute_ms ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS {c}_roll{w}" for w in SPANS for c in _ROLLED)} FROM gr LEFT JOIN minutes USING (minute_ms))
        SELECT minute_ms, {", ".join(f"{r6(f'{c}_roll{w}')} AS {c}_roll{w}" for w in SPANS for c in _ROLLED)} FROM ro""",
    "book_passthrough": f"WITH {_MINUTES} SELECT minute_ms, {', '.join(f'{r6(c)} AS {c}' for c in (f'{p}_{c}' for p in features.BOOKS for c in features.DIRECT_BOOK))} FROM minutes",
    "enriched_full": f"{_FULL} SELECT minute_ms, available_ms, {', '.join(c if c.endswith('_count') else f'{r6(c)} AS {c}' for c in _ALL)} FROM d",
    "passthrough": f"{_FULL} SELECT minute_ms, {', '.join(c if c.endswith('_count') else f'{r6(c)} AS {c}' for c in features.DIRECT)} FROM d",
}
QUERIES = {name: globals()[name] for name in ORACLE}
