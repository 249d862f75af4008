"""Live order books and their sampling as keyed state of a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "book string"
_OUT = "symbol string, ts_ms long, update_id long, seq long, best_bid double, best_ask double, mid double, spread_bps double, bids string, asks string, reason string"


class LiveBook:
    """Price levels by side. A snapshot clears it; so does an update with id 1, and a first update when not strict."""

    def __init__(self, saved: dict | None = None, strict: bool = False):
        saved = saved or {}
        self.strict = strict
        self.sides: dict[str, dict[float, float]] = {s: {float(p): q for p, q in saved.get(s, {}).items()} for s in ("bids", "asks")}
        self.ready, self.version, self.clean = saved.get("ready", False), saved.get("version", 0), saved.get("clean", 0)
        self.update_id, self.seq, self.last = saved.get("update_id"), saved.get("seq"), saved.get("last")

    @property
    def dirty(self) -> bool:
        return self.version != self.clean

    def apply(self, kind: str, update_id: int | None, seq: int | None, bids, asks) -> int:
        """Applies a message and returns how many levels it changed; updates that don't count change none."""
        if kind == "snapshot" or (not self.strict and (update_id == 1 or not self.ready)):
            self.sides, self.ready = {"bids": {}, "asks": {}}, True
        elif not self.ready:
            return 0
        n = 0
        for name, changed in (("bids", bids), ("asks", asks)):
            side = self.sides[name]
            for level in changed if changed is not None else ():
                n += 1
                if level["qty"] == 0:
                    side.pop(level["price"], None)
                else:
                    side[level["price"]] = level["qty"]
        self.version += 1
        self.update_id, self.seq = update_id, seq
        return n

    def top(self, depth: int) -> tuple[list[tuple[float, float]], list[tuple[float, float]]]:
        return sorted(self.sides["bids"].items(), reverse=True)[:depth], sorted(self.sides["asks"].items())[:depth]

    def saved(self, version: int) -> None:
        """Marks a version as written; changes after it keep the book dirty."""
        if version == self.version:
            self.clean = version

    def dump(self) -> dict:
        return {**self.sides, "ready": self.ready, "version": self.version, "clean": self.clean, "update_id": self.update_id, "seq": self.seq, "last": self.last}


def sampled_books(updates: DataFrame, interval_ms: int = 1000, depth: int = 50, strict: bool = False, on_faster: bool = True, unchanged: bool = False) -> DataFrame:
    """Snapshots of each symbol's book, at most one for each interval, of books that changed since the last one.

    updates (streaming): symbol, ts_ms, type, update_id, seq, bids, asks, and optionally interval_ms, the interval that
    a policy asks for at that time; where it falls, a snapshot is due at once (on_faster). Books with an empty side are
    not written, and don't move the time of the last snapshot.
    """
    own_interval = "interval_ms" in updates.columns

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        book, before = LiveBook(held, strict), held.get("interval")
        out = []
        for pdf in frames:
            for r in pdf.sort_values(["ts_ms", "seq"], kind="stable").itertuples(index=False):
                book.apply(r.type, r.update_id, r.seq, r.bids, r.asks)
                interval = int(r.interval_ms) if own_interval else interval_ms
                faster = on_faster and before is not None and interval < before
                due = book.last is None or r.ts_ms - book.last >= interval
                before = interval
                if not (due or faster) or not (book.dirty or unchanged):
                    continue
                bids, asks = book.top(depth)
                if not bids or not asks:
                    continue
                bid, ask = bids[0][0], asks[0][0]
                mid = (bid + ask) / 2
                out.append((key[0], r.ts_ms, r.update_id, r.seq, bid, ask, mid, (ask - bid) / mid * 1e4, json.dumps(bids), json.dumps(asks), "speedup" if faster and not due else "due"))
                book.last = r.ts_ms
                book.saved(book.version)
        state.update((json.dumps({**book.dump(), "interval": before}),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    return updates.groupBy("symbol").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
