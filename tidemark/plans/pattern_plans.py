"""Queries on formations, outcomes and books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import sorted_levels
from ..functions.numeric import rounded
from ..operators import book, labels, patterns
from ..operators.store import written
from .domain import GRID, HOUR, TRADES, hourly_grid, r6, table, trades
from .market import price_path

KEYS, AT = ["channel"], "bar_ms"
PROFILES = (patterns.Profile("tight", 2, 2, 48, 60.0, 100.0), patterns.Profile("wide", 2, 4, 96, 200.0, 50.0), patterns.Profile("slow", 4, 6, 120, 150.0, 50.0))
TARGET = labels.Target(300.0, 150.0, 12)


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.indexed(hourly_grid(spark, sf_dir), KEYS, AT)


def confirmed_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.confirmed_pivots(_bars(spark, sf_dir), KEYS, AT, HOUR, 2)


def _shown(found: DataFrame) -> DataFrame:
    return found.withColumns({c: rounded(c) for c in ("dev_bps", "rebound_bps", "quality")})


def double_formations(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bars(spark, sf_dir)
    return _shown(patterns.doubles(patterns.confirmed_pivots(b, KEYS, AT, HOUR, 2), b, KEYS, PROFILES[0]))


def triple_formations(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bars(spark, sf_dir)
    return _shown(patterns.triples(patterns.confirmed_pivots(b, KEYS, AT, HOUR, 2), b, KEYS, PROFILES[1]))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(patterns.candidates(_bars(spark, sf_dir), KEYS, AT, HOUR, PROFILES), "candidates")


def candidate_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_candidates(spark, sf_dir))


def candidate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the bar they are known at, and their geometry as numbers."""
    bars = hourly_grid(spark, sf_dir).select("channel", F.col("bar_ms").alias("signal_ms"), "close", "volume")
    joined = _candidates(spark, sf_dir).join(bars, ["channel", "signal_ms"])
    return joined.select("channel", "signal_ms", "formation", "profile_code", F.when(F.col("direction") == 1, 1).otherwise(0).alias("direction_long"), F.when(F.col("formation") == "triple", 1).otherwise(0).alias("formation_triple"), "close", "volume")


def signal_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _candidates(spark, sf_dir).select("channel", "signal_ms", "direction", "formation")
    return patterns.signal_episodes(found, KEYS, 6 * HOUR)


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("channel", "signal_ms", "direction").distinct()


def triple_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = price_path(spark, sf_dir)
    return labels.triple_barrier(_signals(spark, sf_dir), path, KEYS, AT, HOUR, TARGET)


def index_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bars(spark, sf_dir)
    signals = b.select("channel", "idx", F.when(F.col("idx") % 2 == 0, 1).otherwise(-1).alias("direction"))
    return labels.index_barrier(signals, b, KEYS, TARGET)


def mfe_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labels.excursions(_signals(spark, sf_dir), price_path(spark, sf_dir), KEYS, AT, HOUR, 24)
    return out.withColumns({c: rounded(c) for c in ("mfe_bps", "mae_bps")})


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as books: 32 bid and 32 ask levels a hundredth apart, quantities from the components."""
    e = table(spark, sf_dir, "embeddings")
    qty = lambda x: F.floor(F.abs(x.cast("double")) * 1e6 + 0.5) / 1e6
    level = lambda first, sign, start: F.transform(F.slice("embedding", first, 32), lambda x, i: F.struct((F.lit(start) + sign * i / 100.0).alias("price"), qty(x).alias("qty")))
    return e.select("vec_id", level(1, -1, 100.0).alias("bids"), level(33, 1, 100.01).alias("asks"))


def _round_all(columns: dict) -> list:
    return [(c if n == "book_valid" else rounded(c)).alias(n) for n, c in columns.items()]


def book_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshots(spark, sf_dir).select("vec_id", *_round_all(book.book_metrics(F.col("bids"), F.col("asks"))), book.churn(F.col("bids"), F.col("asks")).alias("churn"))


def band_liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshots(spark, sf_dir).select("vec_id", *_round_all(book.band_liquidity(F.col("bids"), F.col("asks"))))


def microprice(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _snapshots(spark, sf_dir)
    top = F.transform(sorted_levels("bids", True, 3), lambda x: x["price"])
    return s.select("vec_id", rounded(book.microprice_bps(F.col("bids"), F.col("asks"))).alias("microprice_bps"), F.array_join(top, ",").alias("top_bids"))


def book_rebuild_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    updates = t.select("channel", "ts_ms", "event_id", (F.col("event_id") % 400 == 0).alias("is_snapshot"), F.when(F.col("side") == "Buy", "bid").otherwise("ask").alias("side"), F.floor("value").cast("double").alias("price"), (F.col("size") % 50).alias("qty"))
    placed = book.with_epoch(updates, KEYS, ["ts_ms", "event_id"], "ts_ms")
    rebuilt = book.book_as_of(placed, KEYS, ["ts_ms", "event_id"])
    return book.top_levels(rebuilt, KEYS, 20)


_IDX = "idx AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY bar_ms) - 1 AS idx, count(*) OVER (PARTITION BY channel) AS n_bars FROM grid)"


def _pivots(confirm: int, name: str) -> str:
    left = max(confirm, 2)
    frame = f"OVER (PARTITION BY channel ORDER BY bar_ms ROWS BETWEEN {left} PRECEDING AND {confirm} FOLLOWING)"
    rows = [f"SELECT channel, '{k}' AS kind, idx, {k} AS price, idx + {confirm} AS confirm_idx, bar_ms + {confirm} * 3600000 AS signal_ms FROM {name}_w WHERE idx >= {left} AND idx + {confirm} < n_bars AND {k} {op} m{k}" for k, op in (("low", "<="), ("high", ">="))]
    return f"{name}_w AS (SELECT *, min(low) {frame} AS mlow, max(high) {frame} AS mhigh FROM idx), {name} AS ({' UNION ALL '.join(rows)})"


def _dev(a: str, b: str) -> str:
    return f"abs({a} - {b}) / ((abs({a}) + abs({b})) / 2) * 1e4"


def _reb(x: str, a: str, b: str) -> str:
    return f"coalesce(CASE kind WHEN 'low' THEN {x} - ({a} + {b}) / 2 ELSE ({a} + {b}) / 2 - {x} END / (({a} + {b}) / 2) * 1e4, 0)"


def _extreme(a: str, b: str) -> str:
    return f"(SELECT CASE WHEN {b} > {a} + 1 THEN CASE f.kind WHEN 'low' THEN max(i.high) ELSE min(i.low) END END FROM idx i WHERE i.channel = f.channel AND i.idx BETWEEN {a} AND {b})"


def _formations(p: patterns.Profile, code: int, pivots: str, name: str, kind: str) -> str:
    by = "OVER (PARTITION BY channel, kind ORDER BY idx)"
    if kind == "double":
        return f"""{name} AS (SELECT channel, signal_ms, CASE kind WHEN 'low' THEN 1 ELSE -1 END AS direction, 'double' AS formation, '{p.name}' AS profile, i1 AS first_idx, idx AS last_idx, price, x AS neckline, dev AS dev_bps, reb AS rebound_bps, reb / (1 + dev) AS quality, {code} AS profile_code
            FROM (SELECT *, {_reb("x", "p1", "price")} AS reb FROM (SELECT *, {_extreme("i1", "f.idx")} AS x FROM (SELECT *, {_dev("p1", "price")} AS dev FROM (SELECT *, lag(idx) {by} AS i1, lag(price) {by} AS p1 FROM {pivots}) WHERE idx - i1 BETWEEN {p.min_gap} AND {p.max_gap}) f WHERE dev <= {p.tolerance_bps})) WHERE reb >= {p.rebound_bps})"""
    return f"""{name} AS (SELECT channel, signal_ms, CASE kind WHEN 'low' THEN 1 ELSE -1 END AS direction, 'triple' AS formation, '{p.name}' AS profile, i2 AS first_idx, idx AS last_idx, price, CASE kind WHEN 'low' THEN greatest(x1, x2) ELSE least(x1, x2) END AS neckline, dev AS dev_bps, reb AS rebound_bps, reb / (1 + dev) AS quality, {code} AS profile_code
        FROM (SELECT *, least({_reb("x1", "p2", "p1")}, {_reb("x2", "p1", "price")}) AS reb FROM (SELECT *, {_extreme("i2", "i1")} AS x1, {_extreme("i1", "f.idx")} AS x2 FROM (SELECT *, greatest({_dev("p2", "p1")}, {_dev("p1", "price")}, {_dev("p2", "price")}) AS dev
            FROM (SELECT *, lag(idx) {by} AS i1, lag(price) {by} AS p1, lag(idx, 2) {by} AS i2, lag(price, 2) {by} AS p2 FROM {pivots}) WHERE idx - i1 BETWEEN {p.min_gap} AND {p.max_gap} AND i1 - i2 BETWEEN {p.min_gap} AND {p.max_gap}) f WHERE dev <= {p.tolerance_bps})) WHERE reb >= {p.rebound_bps})"""


_COLUMNS = f"channel, signal_ms, CAST(direction AS INTEGER) AS direction, formation, profile, first_idx, last_idx, price, neckline, {r6('dev_bps')} AS dev_bps, {r6('rebound_bps')} AS rebound_bps, {r6('quality')} AS quality"
_ALL = ", ".join(f"{_pivots(p.confirm, f'p{n}')}, {_formations(p, n, f'p{n}', f'd{n}', 'double')}, {_formations(p, n, f'p{n}', f't{n}', 'triple')}" for n, p in enumerate(PROFILES))
_CAND = f"""{GRID}, {_IDX}, {_ALL}, cand AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT * FROM {k}{n}" for n in range(len(PROFILES)) for k in "dt")})
    QUALIFY row_number() OVER (PARTITION BY channel, signal_ms, direction, formation ORDER BY quality DESC, profile_code) = 1)"""
_PATH = "path AS (SELECT channel, bar_ms, high, low, close, CASE WHEN close IS NULL THEN 1 ELSE 0 END AS price_missing FROM holes)"


def _barrier(signals: str, path: str, at: str, step: int) -> str:
    t = TARGET
    stop = f"CASE s.direction WHEN 1 THEN b.low <= entry * (1 - {t.sl} / 1e4) ELSE b.high >= entry * (1 + {t.sl} / 1e4) END"
    take = f"CASE s.direction WHEN 1 THEN b.high >= entry * (1 + {t.tp} / 1e4) ELSE b.low <= entry * (1 - {t.tp} / 1e4) END"
    return f"""sig AS (SELECT DISTINCT channel, signal_ms, direction FROM {signals}), ent AS (SELECT sig.*, p.close AS entry, (SELECT max({at}) FROM {path} e WHERE e.channel = sig.channel) AS last FROM sig LEFT JOIN {path} p ON p.channel = sig.channel AND p.{at} = signal_ms),
        hit AS (SELECT s.channel, s.signal_ms, s.direction, any_value(entry) AS entry, any_value(last) AS last, min(b.{at}) FILTER ({stop}) AS sl, min(b.{at}) FILTER ({take}) AS tp, sum(b.price_missing) AS gaps
            FROM ent s LEFT JOIN {path} b ON b.channel = s.channel AND b.{at} > s.signal_ms AND b.{at} <= s.signal_ms + {t.horizon * step} GROUP BY ALL),
        outc AS (SELECT *, CASE WHEN entry IS NULL OR signal_ms + {t.horizon * step} > last THEN 'censored' WHEN gaps > 0 THEN 'censored_gap' WHEN sl IS NOT NULL AND (tp IS NULL OR sl <= tp) THEN 'sl' WHEN tp IS NOT NULL THEN 'tp' ELSE 'timeout' END AS outcome FROM hit),
        res AS (SELECT channel, signal_ms, CAST(direction AS INTEGER) AS direction, entry, outcome, CASE outcome WHEN 'sl' THEN (sl - signal_ms) // {step} WHEN 'tp' THEN (tp - signal_ms) // {step} END AS hit_bars, CAST(CASE outcome WHEN 'tp' THEN 1 WHEN 'sl' THEN 0 WHEN 'timeout' THEN 0 END AS INTEGER) AS label FROM outc)"""


_QTY = "floor(abs(CAST(x AS DOUBLE)) * 1e6 + 0.5) / 1e6"
_BOOK = f"""bk AS (SELECT vec_id, list_sort([{{'price': 100.0 - CAST(i AS DOUBLE) / 100.0, 'qty': {_QTY.replace('x', 'embedding[i + 1]', 1)}}} FOR i IN range(32)], 'DESC') AS b0,
    list_sort([{{'price': CAST(100.01 AS DOUBLE) + CAST(i AS DOUBLE) / 100.0, 'qty': {_QTY.replace('x', 'embedding[i + 33]', 1)}}} FOR i IN range(32)]) AS a0 FROM embeddings),
    bo AS (SELECT vec_id, [x FOR x IN b0 IF x.qty > 0] AS b, [x FOR x IN a0 IF x.qty > 0] AS a FROM bk), tops AS (SELECT *, (b[1].price + a[1].price) / 2 AS mid FROM bo)"""


def _sum(side: str, cond: str = "") -> str:
    return f"coalesce(list_sum([x.qty FOR x IN {side}{' IF ' + cond if cond else ''}]), 0)"


def _imb(b: str, a: str) -> str:
    return f"CASE WHEN {b} + {a} = 0 THEN 0 ELSE ({b} - {a}) / ({b} + {a}) END"


_BANDS = ", ".join(f"{r6(_sum('b', c))} AS bid_qty_{w}bps, {r6(_sum('a', c))} AS ask_qty_{w}bps, {r6(_imb(_sum('b', c), _sum('a', c)))} AS imbalance_{w}bps" for w in book.BANDS for c in [f"abs(x.price - mid) <= mid * {w / 1e4!r}"])
ORACLE = {
    "confirmed_pivots": f"WITH {GRID}, {_IDX}, {_pivots(2, 'p')} SELECT * FROM p",
    "double_formations": f"WITH {GRID}, {_IDX}, {_pivots(2, 'p')}, {_formations(PROFILES[0], 0, 'p', 'd', 'double')} SELECT {_COLUMNS} FROM d",
    "triple_formations": f"WITH {GRID}, {_IDX}, {_pivots(2, 'p')}, {_formations(PROFILES[1], 0, 'p', 't', 'triple')} SELECT {_COLUMNS} FROM t",
    "candidate_dedup": f"WITH {_CAND} SELECT {_COLUMNS}, CAST(profile_code AS INTEGER) AS profile_code FROM cand",
    "candidate_features": f"WITH {_CAND} SELECT channel, signal_ms, formation, CAST(profile_code AS INTEGER) AS profile_code, CAST(direction = 1 AS INTEGER) AS direction_long, CAST(formation = 'triple' AS INTEGER) AS formation_triple, close, volume FROM cand JOIN grid USING (channel) WHERE bar_ms = signal_ms",
    "signal_episodes": f"""WITH {_CAND}, l AS (SELECT channel, signal_ms, direction, formation, lag(signal_ms) OVER (PARTITION BY channel, direction ORDER BY signal_ms, formation) AS b FROM cand),
        f AS (SELECT *, CASE WHEN b IS NULL OR signal_ms - b > 21600000 THEN 1 ELSE 0 END AS is_first FROM l)
        SELECT channel, signal_ms, CAST(direction AS INTEGER) AS direction, formation, CAST(is_first AS INTEGER) AS is_first, CASE direction WHEN 1 THEN 'L' ELSE 'S' END || lpad(CAST(sum(is_first) OVER (PARTITION BY channel, direction ORDER BY signal_ms, formation) AS VARCHAR), 7, '0') AS episode_id FROM f""",
    "triple_barrier": f"WITH {_CAND}, {_PATH}, {_barrier('cand', 'path', 'bar_ms', 3_600_000)} SELECT * FROM res",
    "index_barrier": f"""WITH {GRID}, {_IDX}, ipath AS (SELECT *, 0 AS price_missing FROM idx), isig AS (SELECT channel, idx AS signal_ms, CASE WHEN idx % 2 = 0 THEN 1 ELSE -1 END AS direction FROM idx),
        {_barrier('isig', 'ipath', 'idx', 1)} SELECT channel, signal_ms AS idx, direction, entry, outcome, hit_bars, label FROM res""",
    "mfe_mae": f"""WITH {_CAND}, {_PATH}, sig AS (SELECT DISTINCT channel, signal_ms, direction FROM cand), ent AS (SELECT sig.*, p.close AS entry FROM sig LEFT JOIN path p ON p.channel = sig.channel AND p.bar_ms = signal_ms),
        m AS (SELECT s.channel, s.signal_ms, s.direction, any_value(entry) AS entry, max(b.high) AS hi, min(b.low) AS lo, count(b.high) AS n FROM ent s LEFT JOIN path b ON b.channel = s.channel AND b.bar_ms > s.signal_ms AND b.bar_ms <= s.signal_ms + 24 * 3600000 GROUP BY ALL),
        u AS (SELECT *, (hi / entry - 1) * 1e4 AS up, (1 - lo / entry) * 1e4 AS down FROM m)
        SELECT channel, signal_ms, CAST(direction AS INTEGER) AS direction, entry, {r6("CASE direction WHEN 1 THEN up ELSE down END")} AS mfe_bps, {r6("CASE direction WHEN 1 THEN down ELSE up END")} AS mae_bps, n = 24 AS mfe_complete FROM u""",
    "book_metrics": f"""WITH {_BOOK} SELECT vec_id, 1 AS book_valid, {r6("mid")} AS mid, {r6("(a[1].price - b[1].price) / mid * 1e4")} AS spread_bp, {r6(_sum("b[1:10]"))} AS bid_depth, {r6(_sum("a[1:10]"))} AS ask_depth, {r6(_imb(_sum("b[1:10]"), _sum("a[1:10]")))} AS imbalance, 64 AS churn FROM tops""",
    "band_liquidity": f"WITH {_BOOK} SELECT vec_id, {_BANDS} FROM tops",
    "microprice": f"""WITH {_BOOK} SELECT vec_id, {r6("((a[1].price * b[1].qty + b[1].price * a[1].qty) / (b[1].qty + a[1].qty) / mid - 1) * 1e4")} AS microprice_bps, array_to_string([CAST(x.price AS VARCHAR) FOR x IN b[1:3]], ',') AS top_bids FROM tops""",
    "book_rebuild_asof": f"""WITH {TRADES}, u AS (SELECT channel, ts_ms, event_id, CASE side WHEN 'Buy' THEN 'bid' ELSE 'ask' END AS side, floor(value) AS price, size % 50 AS qty, sum(CASE WHEN event_id % 400 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY ts_ms, event_id) AS ep FROM trades),
        l AS (SELECT channel, side, price, arg_max(qty, (ts_ms, event_id)) AS qty FROM u JOIN (SELECT channel, max(ep) AS ep FROM u GROUP BY channel) USING (channel, ep) WHERE ep > 0 GROUP BY ALL)
        SELECT channel, side, price, qty, CAST(row_number() OVER (PARTITION BY channel, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) AS INTEGER) AS level FROM l WHERE qty > 0 QUALIFY level <= 20""",
}
QUERIES = {name: globals()[name] for name in ORACLE}
