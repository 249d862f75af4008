"""Streaming forms of the batch operators: ordering of late rows, de-duplication, minutes, and sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def reordered(events: DataFrame, key: str = "channel", wait_ms: int = 250) -> DataFrame:
    """Rows of each key in time order, each held back until `wait_ms` later ones have come.

    A row that comes later still is not dropped, as a watermark would do, but passed on at once with late = true.
    events: key, ts_ms, event_id, payload (string). What is held at the end of the input comes out with the next rows.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, top, sent = state.get if state.exists else ("[]", -1, -1)
        waiting = [tuple(x) for x in json.loads(held)]
        out = []
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if r.ts_ms <= sent:
                    out.append((k[0], int(r.ts_ms), int(r.event_id), r.payload, True))
                else:
                    waiting.append((int(r.ts_ms), int(r.event_id), r.payload))
                top = max(top, int(r.ts_ms))
        waiting.sort()
        n = sum(1 for w in waiting if w[0] <= top - wait_ms)
        out += [(k[0], *w, False) for w in waiting[:n]]
        if n:
            sent = waiting[n - 1][0]
        state.update((json.dumps(waiting[n:]), top, sent))
        yield pd.DataFrame(out, columns=[key, "ts_ms", "event_id", "payload", "late"])

    rows = events.select(key, "ts_ms", "event_id", "payload")
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} string, ts_ms long, event_id long, payload string, late boolean", "held string, top long, sent long", "append", GroupStateTimeout.NoTimeout)


def without_duplicates(events: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """The first row of each key; keys are forgotten after the delay. Needed where two writers overlap."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def minute_bars(trades: DataFrame, delay: str = "2 days") -> DataFrame:
    """Counts, volume, turnover and delta of each channel and minute, written once the delay has passed."""
    signed = F.when(F.col("side") == "Buy", F.col("size")).otherwise(-F.col("size"))
    per = trades.withWatermark("ts", delay).groupBy("channel", F.window("ts", "1 minute")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"), F.sum(F.col("price") * F.col("size")).alias("turnover"), F.sum(signed).alias("delta"))
    return per.select("channel", F.unix_millis("window.start").alias("minute_ms"), "n", "volume", "turnover", "delta")


def to_tables(rows: DataFrame, path: str, checkpoint: str, collector: str, by: tuple[str, ...] = ("channel", "day"), trigger: str | None = None) -> StreamingQuery:
    """Writes a stream to parquet by channel and day, exactly once. collector keeps two writers apart that overlap."""
    keyed = rows.withColumn("collector_id", F.lit(collector))
    w = keyed.writeStream.format("parquet").option("path", f"{path}/{collector}").option("checkpointLocation", f"{checkpoint}/{collector}").partitionBy(*by).outputMode("append")
    w = w.trigger(processingTime=trigger) if trigger else w.trigger(availableNow=True)
    return w.start()


def segments(records: DataFrame, minutes: int = 15) -> DataFrame:
    """segment_ms of each dense record, the quarter of an hour by default that its file holds."""
    step = minutes * 60_000
    return records.withColumn("segment_ms", F.col("recv_wall_ms") - F.pmod("recv_wall_ms", F.lit(step)))


def status(query: StreamingQuery) -> dict:
    """What a status page shows: rows and rates of the last batch, and where the query stands."""
    p = query.lastProgress
    last = json.loads(p.json) if p is not None and hasattr(p, "json") else (p or {})
    return {"id": str(query.id), "active": query.isActive, "batch": last.get("batchId"), "rows": last.get("numInputRows"), "rate": last.get("processedRowsPerSecond"), "status": query.status}
