"""The tables of the test data, read as a market: which columns play which part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import epoch_ms
from ..operators import asof, bars

HOUR = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _size() -> Column:
    """The number k of props. A lone whole number is cut out of its text, as a JSON parser costs several times the rest of a read."""
    props = F.col("props")
    plain = props.rlike(r'\A\{"k": (0|-?[1-9][0-9]{0,14})\}\z')
    return F.when(plain, F.substring(props, F.lit(7), F.length(props) - 7)).otherwise(F.get_json_object(props, "$.k")).cast("double")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as trades: clicks and views on spot, purchases and sign-ups on perp, errors as liquidations."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        epoch_ms("ts").alias("ts_ms"),
        "user_id",
        "event_type",
        "value",
        F.when(kind.isin("click", "view"), "spot").when(kind.isin("purchase", "signup"), "perp").otherwise("liquidation").alias("channel"),
        F.when(F.col("user_id") % 2 == 0, "Buy").otherwise("Sell").alias("side"),
        (100 + F.col("value")).alias("price"),
        _size().alias("size"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.ohlcv(trades(spark, sf_dir).where("channel <> 'liquidation'"), HOUR)


def hourly_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of spot and perp without holes."""
    return asof.fill_bars(hourly(spark, sf_dir), "bar_ms", HOUR)


#: The same relations in SQL.
TRADES = """trades AS (SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, user_id, event_type, value,
    CASE WHEN event_type IN ('click', 'view') THEN 'spot' WHEN event_type IN ('purchase', 'signup') THEN 'perp' ELSE 'liquidation' END AS channel,
    CASE WHEN user_id % 2 = 0 THEN 'Buy' ELSE 'Sell' END AS side, 100 + value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size FROM events)"""
BARS = f"""{TRADES}, bars AS (SELECT channel, ts_ms // 3600000 * 3600000 AS bar_ms, arg_min(price, (ts_ms, event_id)) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, (ts_ms, event_id)) AS close, count(*) AS n, sum(size) AS volume, sum(CASE side WHEN 'Buy' THEN size ELSE -size END) AS delta, sum(price * size) AS turnover
    FROM trades WHERE channel <> 'liquidation' GROUP BY ALL)"""
GRID = f"""{BARS}, times AS (SELECT unnest(range(min(bar_ms), max(bar_ms) + 1, 3600000)) AS bar_ms FROM bars),
    holes AS (SELECT channel, bar_ms, open, high, low, close, n, volume, delta, turnover FROM times CROSS JOIN (SELECT DISTINCT channel FROM bars) LEFT JOIN bars USING (channel, bar_ms)),
    filled AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY channel ORDER BY bar_ms) AS lc FROM holes),
    grid AS (SELECT channel, bar_ms, coalesce(open, lc) AS open, coalesce(high, lc) AS high, coalesce(low, lc) AS low, lc AS close, coalesce(n, 0) AS n, coalesce(volume, 0) AS volume,
        coalesce(delta, 0) AS delta, coalesce(turnover, 0) AS turnover, CAST(CASE WHEN close IS NULL THEN 1 ELSE 0 END AS INTEGER) AS missing FROM filled)"""


def r6(x: str) -> str:
    """SQL of functions.numeric.rounded."""
    return f"floor(({x}) * 1000000 + 0.5) / 1000000"
