"""Paged series from a REST service. The fetch function is given, so nothing here needs a network."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Fetch = Callable[[dict], dict]


def with_retries(fetch: Fetch, attempts: int = 5, first: float = 0.75, longest: float = 8.0, pause: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> Fetch:
    """fetch that tries again after errors and answers with a retCode other than 0, waiting longer each time."""

    def run(params: dict) -> dict:
        for k in range(attempts):
            try:
                answer = fetch(params)
                if answer.get("retCode", 0) == 0:
                    sleep(pause)
                    return answer.get("result", answer)
                error: Exception = OSError(f"retCode {answer['retCode']}: {answer.get('retMsg')}")
            except OSError as e:
                error = e
            if k + 1 < attempts:
                sleep(min(longest, first * 2**k))
        raise error

    return run


def backwards(fetch: Fetch, params: dict, start_ms: int, end_ms: int, at: Callable[[object], int], page: int = 1000) -> list:
    """Rows from newest to oldest page by page until the start, each time once (the last one read), in ascending order.

    Stops when a page is empty or no older than the one before.
    """
    found: dict[int, object] = {}
    end = end_ms
    while end >= start_ms:
        rows = fetch(params | {"start": start_ms, "end": end, "limit": page}).get("list", [])
        times = [at(r) for r in rows]
        found |= {t: r for t, r in zip(times, rows, strict=True) if start_ms <= t <= end_ms}
        if not times or min(times) > end or min(times) <= start_ms:
            break
        end = min(times) - 1
    return [found[t] for t in sorted(found)]


def by_cursor(fetch: Fetch, params: dict, at: Callable[[object], int]) -> list:
    """Rows of all pages of a cursor, each time once, in ascending order; a cursor seen before ends the walk."""
    found: dict[int, object] = {}
    cursor, seen = "", set()
    while cursor not in seen:
        seen.add(cursor)
        answer = fetch(params | ({"cursor": cursor} if cursor else {}))
        found |= {at(r): r for r in answer.get("list", [])}
        cursor = answer.get("nextPageCursor") or ""
        if not cursor:
            break
    return [found[t] for t in sorted(found)]


def klines(spark: SparkSession, rows: list, series: str, symbol: str) -> DataFrame:
    """Bars [start, open, high, low, close, volume, turnover] as a table."""
    number = lambda r, k: float(r[k]) if len(r) > k and r[k] not in (None, "") else None
    data = [(series, symbol, int(r[0]), *(number(r, k) for k in range(1, 7))) for r in rows]
    return spark.createDataFrame(data, "series string, symbol string, startMs long, open double, high double, low double, close double, volume double, turnover double")


def instruments(spark: SparkSession, fetch: Fetch, params: dict) -> DataFrame:
    """symbol and info (the service's record as JSON, nothing left out) of every instrument, over all pages."""
    rows: dict[str, str] = {}
    cursor, seen = "", set()
    while cursor not in seen:
        seen.add(cursor)
        answer = fetch(params | ({"cursor": cursor} if cursor else {}))
        rows |= {str(r["symbol"]): json.dumps(r, sort_keys=True) for r in answer.get("list", [])}
        cursor = answer.get("nextPageCursor") or ""
        if not cursor:
            break
    return spark.createDataFrame(sorted(rows.items()), "symbol string, info string")


def run_jobs(jobs: dict[str, Callable[[], object]]) -> tuple[dict[str, object], dict[str, str]]:
    """Results and errors by job; one job's failure does not end the others."""
    done, failed = {}, {}
    for name, job in jobs.items():
        try:
            done[name] = job()
        except Exception as e:
            failed[name] = str(e)
    return done, failed
