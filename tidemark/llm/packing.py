"""Best-fit packing of documents into sequences.

Best-fit decreasing only looks at lengths, and a piece has at most `capacity` tokens. So the driver packs a histogram of
at most `capacity` lengths, whatever the number of documents: bins with equal remaining capacity are kept as ranges of
sequence numbers, a segment tree over the remaining capacities finds the tightest one that fits in logarithmic time,
and all pieces of one length that go to such a range are placed at once. The outcome equals that of placing them one by
one. Executors then look up where the r-th piece of a length went.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, text_bytes, written
from .encoding import encoder

CAPACITY = 2048


class CapacityTree:
    """A segment tree over the capacities 0 to n: which of them some open bin has left."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, i: int, value: bool) -> None:
        i += self.size
        while i and self.any[i] != value:
            self.any[i] = value
            i //= 2
            value = self.any[2 * i] or self.any[2 * i + 1] if i else value

    def tightest(self, least: int) -> int | None:
        """The smallest marked capacity that is `least` or more."""
        i = least + self.size
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, first sequence, pieces for each sequence, offset of the first), and the sequences.

    Pieces of one length have ranks from 0. A run's pieces go to consecutive sequences, so many to each, one after
    another from the offset on.
    """
    if any(not 1 <= n <= capacity for n in histogram):
        raise ValueError("lengths must be between 1 and the capacity")
    tree = CapacityTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}
    runs, opened = [], 0

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            open_bins.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left > 0:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                first, n = opened, -(-left // (capacity // length))
                opened += n
            else:
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - room))
                leave(room - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and 0 < left < each:
                runs.append((length, rank, left, first, left, capacity - room))
                leave(room - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            leave(room, first, n)
    return runs, opened


_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of at most `capacity` ids of a text and its end id; `nth` counts its length in its part."""
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, enc, end = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(tokenizer), struct.pack("<I", end_id)
        for batch in batches:
            out: list[tuple] = []
            for i, found in zip(batch.column(0).to_pylist(), enc.encode(text_bytes(batch.column(1))), strict=True):
                found += end
                for k in range(0, len(found), 4 * capacity):
                    some = found[k : k + 4 * capacity]
                    n = len(some) // 4
                    out.append((i, k // (4 * capacity), k // 4, n, zlib.crc32(some), part, int(seen[n])))
                    seen[n] += 1
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, _PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Packs all documents; per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece with the end id alone, rows with a null or repeated id are packed like any
    other, and an empty table gives an empty result. Pieces of equal length take their places in the order of Spark's
    partitions. Texts are encoded once; afterwards only the pieces' few numbers move.
    """
    pieces = written(token_pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = best_fit_decreasing(histogram, capacity)
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 6).T.copy()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    # Ranges in length and rank: a run for each bin range that a length was put to, fewer than a few for each length.
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, _, first, each, at = shared.value
        keys = (lengths.astype(np.uint64) << np.uint64(48)) | ranks.astype(np.uint64)
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            k = np.searchsorted(keys, (length.astype(np.uint64) << np.uint64(48)) | rank.astype(np.uint64), "right") - 1
            nth = rank - ranks[k]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start")] + [pa.array(length.astype(np.int64)), batch.column("ids_crc32"), pa.array(first[k] + nth // each[k]), pa.array(at[k] + nth % each[k] * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(offsets, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("ahead")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
