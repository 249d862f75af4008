"""Scalar expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Half-up rounding that every SQL engine agrees on: floor(x * 10**digits + 0.5) / 10**digits."""
    scale = float(10**digits)
    return F.floor(col(c) * scale + 0.5).cast("double") / scale


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is zero or null."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def change_bps(a: Column | str, b: Column | str) -> Column:
    """Relative change from b to a in basis points."""
    return (ratio(a, b) - 1) * 1e4


def distance_bps(a: Column | str, b: Column | str) -> Column:
    """|a - b| in basis points of the mean magnitude."""
    return F.abs(col(a) - col(b)) / F.nullif((F.abs(col(a)) + F.abs(col(b))) / 2, F.lit(0.0)) * 1e4


def finite(c: Column | str) -> Column:
    """Null for NaN and infinities."""
    x = col(c)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def first_positive(*columns: str) -> Column:
    """The first of the columns that is a positive number; strings are parsed."""
    return F.coalesce(*(F.when(F.expr(f"try_cast({c} AS BIGINT)") > 0, F.expr(f"try_cast({c} AS BIGINT)")) for c in columns))


#: Event time of live records and of replayed ones: the order in which their fields are tried. Fixed values.
LIVE_TIME = ("tsRecordMs", "tsTradeMs", "tsLiquidationMs", "tsMatchMs", "tsExchangeMs", "tsExchangeMsgMs", "tsSampleMs", "tsRecvMs", "timestampMs", "startMs", "tsMs")
REPLAY_TIME = ("tsRecordMs", "tsTradeMs", "tsSampleMs", "tsLiquidationMs", "exch_ts_ms", "recv_wall_ms", "tsExchangeMs", "tsMatchMs")


def epoch_ms(c: Column | str) -> Column:
    """Milliseconds of a timestamp without time zone, read as UTC whatever the session's zone."""
    return F.unix_millis(F.from_utc_timestamp(col(c).cast("timestamp"), F.current_timezone()))


def floor_to(c: Column | str, step: int) -> Column:
    """The multiple of step at or below c, for non-negative c."""
    return col(c) - F.pmod(col(c), F.lit(step))


def utc_label(c: Column | str) -> Column:
    """Day and minute of an epoch in ms, as dd.MM.yyyy_HH-mm in UTC."""
    local = F.to_utc_timestamp(F.timestamp_millis(col(c)), F.lit("UTC"))
    shifted = F.to_utc_timestamp(local, F.current_timezone())
    return F.date_format(shifted, "dd.MM.yyyy_HH-mm")
