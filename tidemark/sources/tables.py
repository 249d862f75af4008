"""Tables by day: an immutable cache of closed days, range reads, and sinks."""

from __future__ import annotations

import json
import math
import os
import tarfile
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import keep_last

DAY = 86_400_000


def days(start_ms: int, end_ms: int) -> list[int]:
    """Numbers of the UTC days that a range touches."""
    return list(range(start_ms // DAY, end_ms // DAY + 1))


def write_days(df: DataFrame, path: str, at: str, namespace: str, series: str) -> None:
    """Adds rows to the cache; the days that they touch are replaced as a whole, all others stay as they are."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        keyed = df.withColumns({"namespace": F.lit(namespace), "series": F.lit(series), "day": F.floor(F.col(at) / DAY)})
        keyed.write.mode("overwrite").partitionBy("namespace", "series", "day").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def missing_days(spark: SparkSession, path: str, namespace: str, series: str, start_ms: int, end_ms: int, now_ms: int, offline: bool = False) -> list[int]:
    """Days of a range to fetch: those not in the cache, and the current one, which isn't closed. offline: raises for these."""
    try:
        have = {r.day for r in spark.read.parquet(path).where((F.col("namespace") == namespace) & (F.col("series") == series)).select("day").distinct().collect()}
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        have = set()
    wanted = [d for d in days(start_ms, end_ms) if d not in have or (d == now_ms // DAY and not offline)]
    if offline and wanted:
        raise LookupError(f"{series}: days {wanted} are not in the cache")
    return wanted


def read_range(spark: SparkSession, path: str, at: str, namespace: str, series: str, start_ms: int, end_ms: int, tie: str | None = None) -> DataFrame:
    """Rows of a range: whole days are pruned by partition, the rest by a pushed filter; the last row of each time stays."""
    rows = spark.read.parquet(path).where((F.col("namespace") == namespace) & (F.col("series") == series) & F.col("day").between(start_ms // DAY, end_ms // DAY) & F.col(at).between(start_ms, end_ms))
    return keep_last(rows.drop("namespace", "series", "day"), [at], [tie or at])


def window(start_ms: int, end_ms: int, lookback: int, max_gap: int, confirm: int, step: int = 60_000) -> tuple[int, int]:
    """What to read so that look-backs and formations that begin before the range are whole."""
    return start_ms - max(lookback + 10, 2 * max_gap + 2 * confirm + 10) * step, end_ms


def run_window(start_ms: int, end_ms: int, now_ms: int, preroll_days: int = 1, postroll_hours: int = 24) -> tuple[int, int]:
    """The range to enrich, with room before and after, not past a minute ago."""
    return start_ms - preroll_days * DAY, min(end_ms + postroll_hours * 3_600_000, now_ms - 60_000)


def write_rows(df: DataFrame, path: str, kind: str = "parquet", rows_per_file: int = 1_000_000, by: tuple[str, ...] = ()) -> None:
    """A table as parquet, csv (gzip) or JSON lines; files rotate by rows, and appear only when a task is done."""
    w = df.write.mode("append").option("maxRecordsPerFile", rows_per_file)
    if by:
        w = w.partitionBy(*by)
    if kind == "csv":
        w.option("header", True).option("compression", "gzip").csv(path)
    elif kind == "json":
        w.option("compression", "gzip").json(path)
    else:
        w.parquet(path)


def clean_json(value):
    """value with NaN and infinities as null, for json.dumps."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {k: clean_json(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [clean_json(v) for v in value]
    return value


def write_archive(rows: DataFrame, folder: str, batch_id: str, at: str = "ts_ms", channel: str = "channel") -> str:
    """One batch as a tar.gz of JSON lines with its manifest, checked before it gets its name. Returns the path.

    A batch is what one rotation holds: its bound is the rotation's size, and the driver streams it row by row.
    """
    os.makedirs(folder, exist_ok=True)
    final = os.path.join(folder, f"{batch_id}.tar.gz")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("a"), F.max(at).alias("b")).first()
    counts = {r[0]: r[1] for r in rows.groupBy(channel).count().collect()}
    with tempfile.TemporaryDirectory(dir=folder) as tmp:
        lines = os.path.join(tmp, "market.jsonl")
        with open(lines, "w", encoding="utf-8") as f:
            for r in rows.orderBy(at).select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
                f.write(r.j + "\n")
        manifest = os.path.join(tmp, "manifest.json")
        with open(manifest, "w", encoding="utf-8") as f:
            json.dump({"batchId": batch_id, "startMs": stats.a, "endMs": stats.b, "rows": stats.n, "counts": counts, "uncompressedBytes": os.path.getsize(lines)}, f)
        partial = f"{final}.partial"
        with tarfile.open(partial, "w:gz") as tar:
            tar.add(manifest, "manifest.json")
            tar.add(lines, "market.jsonl")
        with tarfile.open(partial, "r:gz") as tar:
            if sorted(tar.getnames()) != ["manifest.json", "market.jsonl"]:
                raise OSError(f"{partial} is not whole")
        os.replace(partial, final)
    return final


def synthetic_ticks(spark: SparkSession, n: int = 2400, seed: int = 7, tick: int = 250) -> DataFrame:
    """A made-up tick timeline: quiet noise with a burst of 20 hot ticks in every 420. Noise is a hash, the same everywhere."""
    noise = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1_000_003)) / 1_000_003.0) - 0.5
    hot = (F.pmod("id", F.lit(420)) >= 200) & (F.pmod("id", F.lit(420)) < 220)
    level = lambda a, b, k: F.greatest(F.when(hot, F.lit(float(a))).otherwise(float(b)) * (1 + 0.4 * noise(k)), F.lit(0.0))
    price = 100 + noise(0) * 0.01
    return spark.range(n).select(
        (F.col("id") * tick).alias("ts_ms"), price.alias("mid"), level(2, 0.1, 1).alias("fast_price_range_bp"), level(3, 0.15, 2).alias("fast_tick_travel_bp"), level(70, 3, 3).alias("fast_trade_rate_s"),
        level(180_000, 7_000, 4).alias("fast_quote_volume_s"), level(450, 70, 5).alias("fast_book_churn_s"), level(0.16, 0.02, 6).alias("fast_imbalance_delta"), (noise(7) * 2).alias("imbalance"),
    )
