"""Exchange messages as rows: trades, liquidations, books, dense records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import levels

#: Items of trade and liquidation messages have names that differ by case alone (s, S), so they are read as maps.
ITEMS = "topic string, ts bigint, data array<map<string,string>>"
ITEM = "topic string, ts bigint, data map<string,string>"
BOOK_DATA = "topic string, type string, ts bigint, cts bigint, data struct<s:string,u:bigint,seq:bigint,b:array<array<string>>,a:array<array<string>>>"


def _number(c: Column) -> Column:
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _whole(item: str, key: str) -> Column:
    return F.col(item)[key].try_cast("bigint")


def parse_trades(messages: DataFrame, raw: str = "value") -> DataFrame:
    """One row for each trade of each message; trades without a finite time, price or size are left out."""
    m = messages.withColumn("__m", F.from_json(raw, ITEMS)).where(F.col("__m.topic").startswith("publicTrade"))
    t = m.select(*(c for c in messages.columns if c != raw), F.col("__m.ts").alias("exchange_ms"), F.explode("__m.data").alias("t"))
    out = t.select(
        *(c for c in messages.columns if c != raw),
        "exchange_ms",
        _whole("t", "T").alias("trade_ms"),
        F.col("t")["i"].alias("trade_id"),
        F.nullif(_whole("t", "seq"), F.lit(0)).alias("seq"),
        F.col("t")["s"].alias("symbol"),
        F.col("t")["S"].alias("side"),
        _number(F.col("t")["p"]).alias("price"),
        _number(F.col("t")["v"]).alias("size"),
        F.col("t")["L"].alias("tick_direction"),
        F.coalesce(F.col("t")["BT"] == "true", F.lit(False)).alias("block_trade"),
        F.coalesce(F.col("t")["RPI"] == "true", F.lit(False)).alias("rpi"),
    )
    return out.where("trade_ms is not null and price is not null and size is not null")


def parse_liquidations(messages: DataFrame, raw: str = "value") -> DataFrame:
    """Liquidations, whose `data` may be one object or a list; only the time must be there."""
    many, one = F.from_json(raw, ITEMS), F.from_json(raw, ITEM)
    topic = F.coalesce(many["topic"], one["topic"], F.get_json_object(raw, "$.topic"))
    is_list = F.get_json_object(raw, "$.data").startswith("[")
    rows = messages.withColumn("__t", topic).where(F.col("__t").startswith("allLiquidation") | F.col("__t").startswith("liquidation"))
    rows = rows.select(*(c for c in messages.columns if c != raw), F.explode(F.when(is_list, many["data"]).otherwise(F.array(one["data"]))).alias("l"))
    return rows.select(*(c for c in messages.columns if c != raw), _whole("l", "T").alias("liquidation_ms"), F.col("l")["s"].alias("symbol"), F.col("l")["S"].alias("position_side"), _number(F.col("l")["v"]).alias("size"), _number(F.col("l")["p"]).alias("bankruptcy_price")).where("liquidation_ms is not null")


def parse_books(messages: DataFrame, raw: str = "value") -> DataFrame:
    """Order-book messages: symbol, type (snapshot or delta), update_id, seq, times and levels as structs."""
    m = messages.withColumn("__m", F.from_json(raw, BOOK_DATA)).where(F.col("__m.topic").startswith("orderbook"))
    return m.select(*(c for c in messages.columns if c != raw), F.col("__m.type").alias("type"), F.col("__m.ts").alias("exchange_ms"), F.col("__m.cts").alias("match_ms"), F.col("__m.data.s").alias("symbol"), F.col("__m.data.u").alias("update_id"), F.col("__m.data.seq").alias("seq"), levels("__m.data.b").alias("bids"), levels("__m.data.a").alias("asks"))


def route(messages: DataFrame, raw: str = "value") -> DataFrame:
    """Adds the channel of each message, by the prefix of its topic; null where it has none."""
    topic = F.get_json_object(raw, "$.topic")
    kind = F.when(topic.startswith("publicTrade"), "trades").when(topic.startswith("orderbook"), "orderbook").when(topic.startswith("allLiquidation") | topic.startswith("liquidation"), "liquidations")
    return messages.withColumn("channel", kind)


def dense_records(messages: DataFrame, raw: str = "value") -> DataFrame:
    """Transport-level records: kinds trade, ob_snapshot and ob_delta, with numbers as strings and quote_value of trades."""
    trades = parse_trades(messages, raw).select(F.lit("trade").alias("kind"), "symbol", F.col("trade_ms").alias("exch_ts_ms"), "trade_id", "side", F.col("price").cast("string").alias("price"), F.col("size").cast("string").alias("size"), (F.col("price") * F.col("size")).cast("string").alias("quote_value"))
    books = parse_books(messages, raw).select(F.concat(F.lit("ob_"), "type").alias("kind"), "symbol", F.coalesce("match_ms", "exchange_ms").alias("exch_ts_ms"), "update_id", "seq", "bids", "asks")
    return trades.unionByName(books, allowMissingColumns=True)


def normalise_dense(records: DataFrame, depth: int = 50) -> DataFrame:
    """Dense records as collector rows: trades and two-sided snapshots (best `depth` levels); deltas are left out."""
    kept = records.where((F.col("kind") == "trade") | ((F.col("kind") == "ob_snapshot") & (F.size("bids") > 0) & (F.size("asks") > 0)))
    return kept.withColumns({"price": F.col("price").try_cast("double"), "size": F.col("size").try_cast("double"), "bids": F.slice("bids", 1, depth), "asks": F.slice("asks", 1, depth)})


def trade_messages(trades: DataFrame, per_message: int) -> DataFrame:
    """Trades gathered into JSON messages of at most so many, the inverse of parse_trades."""
    group = F.floor(F.col("event_id") / per_message)
    text = lambda c: F.col(c).cast("string")
    item = F.create_map(F.lit("T"), text("ts_ms"), F.lit("s"), F.col("channel"), F.lit("S"), F.col("side"), F.lit("v"), text("size"), F.lit("p"), text("price"), F.lit("i"), text("event_id"))
    packed = trades.groupBy("channel", group.alias("__g")).agg(F.collect_list(item).alias("data"), F.max("ts_ms").alias("ts"))
    body = F.to_json(F.struct(F.concat(F.lit("publicTrade."), "channel").alias("topic"), "ts", "data"))
    return packed.select(F.col("channel").alias("market"), body.alias("value"))


def trades_from_messages(messages: DataFrame) -> DataFrame:
    return parse_trades(messages).select("market", F.col("trade_id").cast("long").alias("trade_id"), F.col("trade_ms").alias("ts_ms"), "side", "price", "size")
