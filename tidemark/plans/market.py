"""Queries on trades, bars, grids and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import epoch_ms, floor_to, ratio, rounded, utc_label
from ..operators import asof, bars, relational
from .domain import BARS, GRID, HOUR, TRADES, hourly, hourly_grid, r6, table, trades

DAY = 86_400_000


def ohlcv_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bars.flow(bars.ohlcv(trades(spark, sf_dir), HOUR))
    return out.withColumn("turnover", rounded("turnover")).drop("delta_ratio")


def minute_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.minute_micro(trades(spark, sf_dir))


def trade_flow_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bars.flow(bars.ohlcv(trades(spark, sf_dir), 60_000, out="minute_ms"))
    return out.select("channel", "minute_ms", "delta", "delta_ratio", "vwap", (F.col("minute_ms") + 60_000).alias("available_ms"))


def vwap_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars.flow(hourly(spark, sf_dir))
    pick = lambda ch: F.max(F.when(F.col("channel") == ch, F.struct("close", "vwap")))
    both = b.groupBy("bar_ms").agg(pick("spot").alias("s"), pick("perp").alias("p"))
    return both.select("bar_ms", rounded(asof.basis(F.col("p.close"), F.col("s.close"))).alias("close_basis_bps"), rounded(asof.basis(F.col("p.vwap"), F.col("s.vwap"))).alias("vwap_basis_bps"))


def minute_grid_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars.ohlcv(trades(spark, sf_dir).where("channel = 'spot'"), 60_000)
    out = asof.fill_bars(b, "bar_ms", 60_000)
    return out.select("channel", "bar_ms", "open", "high", "low", "close", "n", "volume", "missing")


def price_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = hourly(spark, sf_dir)
    grid = asof.time_grid(b, "bar_ms", HOUR, ["channel"])
    return grid.join(b, ["channel", "bar_ms"], "left").select("channel", "bar_ms", "high", "low", "close", F.when(F.col("close").isNull(), 1).otherwise(0).alias("price_missing"))


def asof_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    left = asof.time_grid(t, "ts_ms", HOUR).withColumnRenamed("ts_ms", "bar_ms")
    out = left
    for channel, prefix in (("perp", "perp_"), ("liquidation", "liq_")):
        series = relational.keep_last(t.where(F.col("channel") == channel).select("ts_ms", "price", "size", "event_id"), ["ts_ms"], ["event_id"])
        out = asof.asof_join(out, series, "bar_ms", "ts_ms", ["price", "size"], prefix)
    return out


def enriched_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spot grid with hourly micro columns by time and perp prices as of each hour."""
    spot = hourly_grid(spark, sf_dir).where("channel = 'spot'").select("bar_ms", "close", "missing")
    micro = bars.minute_micro(trades(spark, sf_dir), HOUR).withColumnRenamed("minute_ms", "bar_ms")
    perp = hourly(spark, sf_dir).where("channel = 'perp'").select("bar_ms", F.col("close").alias("price"))
    joined = spot.join(micro.select("bar_ms", "spot_trade_count", "perp_trade_volume", "liquidation_count"), "bar_ms", "left")
    out = asof.asof_join(joined, perp.withColumnRenamed("bar_ms", "at_ms"), "bar_ms", "at_ms", ["price"], "perp_")
    zero = {c: F.coalesce(c, F.lit(0).cast(out.schema[c].dataType)) for c in ("spot_trade_count", "perp_trade_volume", "liquidation_count")}
    return out.withColumns(zero).withColumn("basis_bps", rounded(asof.basis(F.col("perp_price"), F.col("close")))).withColumn("available_ms", F.col("bar_ms") + HOUR)


def seq_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).withColumn("batch_id", F.floor(F.col("event_id") / 100).cast("long"))
    batches = t.groupBy("batch_id").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count(F.lit(1)).alias("n_rows"))
    return relational.sequence_gaps(batches, 5000)


def stream_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    bad = {"n_bad_size": F.col("size").isNull() | (F.col("size") < 0), "n_bad_price": F.col("value") <= 0}
    return relational.validate_stream(t, ["channel"], "ts_ms", ["event_id"], F.floor(F.col("event_id") / 1_000_000), bad)


def keep_last_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).select("user_id", floor_to("ts_ms", HOUR).alias("bar_ms"), "ts_ms", "event_id", "price", "channel")
    return relational.keep_last(t, ["user_id", "bar_ms"], ["ts_ms", "event_id"])


def priority_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).select("user_id", floor_to("ts_ms", DAY).alias("day_ms"), "channel", "price", "event_id")
    priority = F.when(F.col("channel") == "perp", 3).when(F.col("channel") == "spot", 2).otherwise(1)
    return relational.keep_best(t, ["user_id", "day_ms"], [-priority, -F.col("price"), F.col("event_id")])


def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    parts = None
    for channel in ("spot", "perp", "liquidation"):
        own = t.where(F.col("channel") == channel).select(F.concat_ws("-", "channel", floor_to("ts_ms", DAY)).alias("batch_id"), "ts_ms", "event_id")
        parts = own if parts is None else parts.unionByName(own)
    return relational.ordered_union(parts, "batch_id", ["ts_ms", "event_id"])


def batch_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each day's batch: rows, range, its label, and rows of each channel."""
    per = trades(spark, sf_dir).groupBy(floor_to("ts_ms", DAY).alias("batch_ms"), "channel").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("s"), F.max("ts_ms").alias("e"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "n"))))
    out = per.groupBy("batch_ms").agg(F.sum("n").alias("n_rows"), F.min("s").alias("start_ms"), F.max("e").alias("end_ms"), counts.alias("c"))
    label = F.concat_ws("_to_", utc_label("start_ms"), utc_label("end_ms"))
    return out.select("batch_ms", "n_rows", "start_ms", "end_ms", label.alias("label"), F.to_json("c").alias("counts"))


def dataset_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    files = t.groupBy("channel").agg(F.count(F.lit(1)).alias("size"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"))
    return relational.dataset_id(files.withColumnRenamed("channel", "name"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    parsed = F.from_json("props", "k int, other string")
    return e.select("event_id", parsed["k"].alias("k"), parsed["other"].alias("other"), F.upper("event_type").alias("kind"), F.lpad((F.col("event_id") % 1000).cast("string"), 7, "0").alias("padded"), F.substring(F.sha1("props"), 1, 12).alias("props_sha"), F.pmod(epoch_ms("ts"), F.lit(60_000)).alias("ms_in_minute"))


def trade_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that carry many trades, written as JSON and read back as rows."""
    from ..sources.messages import trade_messages, trades_from_messages

    t = trades(spark, sf_dir).where("channel <> 'liquidation'")
    return trades_from_messages(trade_messages(t, 50))


def detect_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).withColumn("symbol", F.concat_ws("-", "event_type", F.col("user_id") % 7))
    return relational.detect_symbols(t, "channel", "symbol", ["event_id"])


def formation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.value_counts(trades(spark, sf_dir), "channel", "side")


def top_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = hourly(spark, sf_dir).withColumn("ratio", F.coalesce(rounded(ratio("delta", "volume")), F.lit(0.0)))
    out = relational.leaderboard(b, [F.desc("n"), F.asc("ratio"), F.desc("high"), F.asc("low"), F.asc("channel"), F.desc("bar_ms")], 20)
    return out.select("channel", "bar_ms", "n", "ratio", "high", "low")


def replay_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).where("channel = 'spot'")
    signals = t.select(floor_to("ts_ms", HOUR).alias("signal_ms"), F.when(F.col("side") == "Buy", 1).otherwise(-1).alias("direction"), (F.pmod("event_id", F.lit(997)) / 997.0).alias("prob"))
    return relational.replay_pivot(asof.time_grid(hourly(spark, sf_dir), "bar_ms", HOUR), signals)


def fixed_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).select("channel", "ts_ms", "event_id", "price", "size")
    return bars.fixed_cadence(t, 600_000, ["channel"])


def greedy_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the times of trades, which lie at any distance."""
    return bars.greedy_cadence(trades(spark, sf_dir).select("ts_ms").distinct(), 2_500_000)


_FLOW = f"CASE WHEN volume = 0 THEN NULL ELSE {r6('delta / volume')} END AS delta_ratio, CASE WHEN volume = 0 THEN NULL ELSE {r6('turnover / volume')} END AS vwap"
_ALL_BARS = BARS.replace(" WHERE channel <> 'liquidation'", "")


def _micro(step: int, name: str) -> str:
    out = []
    for ch in ("spot", "perp", "liquidation"):
        p, own = (f"{ch}_trade" if ch != "liquidation" else ch), f"FILTER (channel = '{ch}')"
        out.append(f"nullif(count(*) {own}, 0) AS {p}_count, {r6(f'sum(size) {own}')} AS {p}_volume")
        if ch != "liquidation":
            out.append(f"{r6(f'sum(price * size) {own}')} AS {p}_turnover")
        for side in ("Buy", "Sell"):
            term = f"sum(CASE side WHEN '{side}' THEN size ELSE 0 END) {own}"
            out.append(f"{r6(term)} AS {p}_{side.lower()}_volume")
    return f"SELECT ts_ms // {step} * {step} AS {name}, {', '.join(out)} FROM trades GROUP BY ALL"


_ASOF = "SELECT ts_ms, arg_max(price, event_id) AS price, arg_max(size, event_id) AS size FROM trades WHERE channel = '{}' GROUP BY ts_ms"

ORACLE = {
    "ohlcv_bars": f"WITH {_ALL_BARS} SELECT channel, bar_ms, open, high, low, close, n, volume, delta, {r6('turnover')} AS turnover, CASE WHEN volume = 0 THEN NULL ELSE {r6('turnover / volume')} END AS vwap FROM bars",
    "minute_micro": f"WITH {TRADES} {_micro(60_000, 'minute_ms')}",
    "trade_flow_delta": f"WITH {_ALL_BARS.replace('3600000', '60000')} SELECT channel, bar_ms AS minute_ms, delta, {_FLOW}, bar_ms + 60000 AS available_ms FROM bars",
    "vwap_basis": f"WITH {BARS}, v AS (SELECT *, {_FLOW} FROM bars), s AS (SELECT * FROM v WHERE channel = 'spot'), p AS (SELECT * FROM v WHERE channel = 'perp') SELECT bar_ms, {r6('(p.close / s.close - 1) * 1e4')} AS close_basis_bps, {r6('(p.vwap / s.vwap - 1) * 1e4')} AS vwap_basis_bps FROM s FULL JOIN p USING (bar_ms)",
    "minute_grid_ffill": f"WITH {GRID.replace('3600000', '60000').replace("channel <> 'liquidation'", "channel = 'spot'")} SELECT channel, bar_ms, open, high, low, close, n, volume, missing FROM grid",
    "price_path": f"WITH {GRID} SELECT channel, bar_ms, high, low, close, CAST(CASE WHEN close IS NULL THEN 1 ELSE 0 END AS INTEGER) AS price_missing FROM holes",
    "asof_enrich": f"""WITH {TRADES}, h AS (SELECT unnest(range(min(ts_ms) // 3600000 * 3600000, max(ts_ms) // 3600000 * 3600000 + 1, 3600000)) AS bar_ms FROM trades),
        p AS ({_ASOF.format("perp")}), l AS ({_ASOF.format("liquidation")})
        SELECT h.bar_ms, p.ts_ms AS perp_ts_ms, p.price AS perp_price, p.size AS perp_size, l.ts_ms AS liq_ts_ms, l.price AS liq_price, l.size AS liq_size
        FROM h ASOF LEFT JOIN p ON h.bar_ms >= p.ts_ms ASOF LEFT JOIN l ON h.bar_ms >= l.ts_ms""",
    "enriched_hours": f"""WITH {GRID}, m AS ({_micro(3_600_000, "bar_ms")}), p AS (SELECT bar_ms AS at_ms, close AS price FROM bars WHERE channel = 'perp')
        SELECT g.bar_ms, g.close, g.missing, coalesce(spot_trade_count, 0) AS spot_trade_count, coalesce(perp_trade_volume, 0) AS perp_trade_volume, coalesce(liquidation_count, 0) AS liquidation_count,
            p.at_ms AS perp_at_ms, p.price AS perp_price, {r6("(p.price / g.close - 1) * 1e4")} AS basis_bps, g.bar_ms + 3600000 AS available_ms
        FROM grid g LEFT JOIN m ON m.bar_ms = g.bar_ms ASOF LEFT JOIN p ON g.bar_ms >= p.at_ms WHERE g.channel = 'spot'""",
    "seq_gaps": f"""WITH {TRADES}, b AS (SELECT event_id // 100 AS batch_id, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS n_rows FROM trades GROUP BY ALL),
        g AS (SELECT *, start_ms - lag(end_ms) OVER (ORDER BY start_ms, end_ms, batch_id) AS gap_ms FROM b)
        SELECT *, CASE WHEN gap_ms > 5000 THEN 'gap' WHEN gap_ms < -5000 THEN 'overlap' ELSE 'ok' END AS kind FROM g""",
    "stream_validation": f"""WITH {TRADES}, s AS (SELECT *, lag(ts_ms) OVER (PARTITION BY channel ORDER BY event_id) AS before FROM trades)
        SELECT channel, count(*) AS n_rows, min(ts_ms) AS min_ms, max(ts_ms) AS max_ms, count(*) FILTER (ts_ms < before) AS n_backwards,
            count(*) FILTER (size IS NULL OR size < 0) AS n_bad_size, count(*) FILTER (value <= 0) AS n_bad_price FROM s GROUP BY channel""",
    "keep_last_dedup": f"""WITH {TRADES} SELECT user_id, ts_ms // 3600000 * 3600000 AS bar_ms, ts_ms, event_id, price, channel FROM trades
        QUALIFY row_number() OVER (PARTITION BY user_id, ts_ms // 3600000 ORDER BY ts_ms DESC, event_id DESC) = 1""",
    "priority_dedup": f"""WITH {TRADES} SELECT user_id, ts_ms // 86400000 * 86400000 AS day_ms, channel, price, event_id FROM trades
        QUALIFY row_number() OVER (PARTITION BY user_id, ts_ms // 86400000 ORDER BY CASE channel WHEN 'perp' THEN 3 WHEN 'spot' THEN 2 ELSE 1 END DESC, price DESC, event_id) = 1""",
    "ordered_union": f"""WITH {TRADES}, p AS (SELECT channel || '-' || (ts_ms // 86400000 * 86400000) AS batch_id, ts_ms, event_id FROM trades),
        b AS (SELECT batch_id, min(ts_ms) AS s, max(ts_ms) AS e FROM p GROUP BY batch_id), r AS (SELECT batch_id, row_number() OVER (ORDER BY s, e, batch_id) AS batch_rank FROM b)
        SELECT batch_id, ts_ms, event_id, row_number() OVER (PARTITION BY batch_id ORDER BY ts_ms, event_id) AS pos, batch_rank FROM p JOIN r USING (batch_id)""",
    "batch_manifest": f"""WITH {TRADES}, p AS (SELECT ts_ms // 86400000 * 86400000 AS batch_ms, channel, count(*) AS n, min(ts_ms) AS s, max(ts_ms) AS e FROM trades GROUP BY ALL)
        SELECT batch_ms, CAST(sum(n) AS BIGINT) AS n_rows, min(s) AS start_ms, max(e) AS end_ms,
            strftime(make_timestamp(min(s) * 1000), '%d.%m.%Y_%H-%M') || '_to_' || strftime(make_timestamp(max(e) * 1000), '%d.%m.%Y_%H-%M') AS label,
            '{{' || string_agg('"' || channel || '":' || n, ',' ORDER BY channel) || '}}' AS counts FROM p GROUP BY batch_ms""",
    "dataset_id": f"""WITH {TRADES}, f AS (SELECT channel AS name, count(*) AS size, min(ts_ms) AS s, max(ts_ms) AS e FROM trades GROUP BY channel)
        SELECT sha1(string_agg(name || ':' || size || ':' || s || ':' || e, '|' ORDER BY s, e, name))[1:12] AS dataset_id FROM f""",
    "json_props": """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.other') AS other, upper(event_type) AS kind,
        lpad(CAST(event_id % 1000 AS VARCHAR), 7, '0') AS padded, sha1(props)[1:12] AS props_sha, epoch_us(ts) // 1000 % 60000 AS ms_in_minute FROM events""",
    "trade_explode": f"WITH {TRADES} SELECT channel AS market, event_id AS trade_id, ts_ms, side, price, size FROM trades WHERE channel <> 'liquidation'",
    "detect_symbols": f"WITH {TRADES}, f AS (SELECT * FROM trades ORDER BY event_id LIMIT 20000) SELECT channel, arg_max(event_type || '-' || (user_id % 7), event_id) AS symbol FROM f GROUP BY channel",
    "formation_counts": f"WITH {TRADES} SELECT channel, side, count(*) AS n FROM trades GROUP BY ALL",
    "top_hours": f"""WITH {BARS} SELECT channel, bar_ms, n, coalesce(CASE WHEN volume = 0 THEN NULL ELSE {r6("delta / volume")} END, 0) AS ratio, high, low FROM bars
        ORDER BY n DESC, ratio, high DESC, low, channel, bar_ms DESC LIMIT 20""",
    "replay_pivot": f"""WITH {BARS}, t AS (SELECT unnest(range(min(bar_ms), max(bar_ms) + 1, 3600000)) AS bar_ms FROM bars),
        s AS (SELECT ts_ms // 3600000 * 3600000 AS bar_ms, side, event_id % 997 / 997.0 AS prob FROM trades WHERE channel = 'spot')
        SELECT bar_ms, max(prob) FILTER (side = 'Buy') AS p_long, max(prob) FILTER (side = 'Sell') AS p_short FROM t LEFT JOIN s USING (bar_ms) GROUP BY bar_ms""",
    "fixed_cadence": f"""WITH {TRADES} SELECT channel, ts_ms // 600000 * 600000 AS sample_ms, ts_ms, event_id, price, size FROM trades
        QUALIFY row_number() OVER (PARTITION BY channel, ts_ms // 600000 ORDER BY ts_ms DESC, event_id DESC) = 1""",
    "greedy_cadence": f"""WITH RECURSIVE {TRADES}, t AS (SELECT DISTINCT ts_ms FROM trades),
        s AS (SELECT min(ts_ms) AS ts_ms FROM t UNION ALL SELECT n FROM (SELECT (SELECT min(t.ts_ms) FROM t WHERE t.ts_ms >= s.ts_ms + 2500000) AS n FROM s) WHERE n IS NOT NULL)
        SELECT t.ts_ms, CAST(s.ts_ms IS NOT NULL AS INTEGER) AS snapshot FROM t LEFT JOIN s ON s.ts_ms = t.ts_ms""",
}
QUERIES = {name: globals()[name] for name in ORACLE}
