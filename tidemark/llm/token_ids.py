"""Token ids in directly addressable codes.

An id is cut into 8-bit chunks, lowest first. Level 0 holds the first chunk of every id of a segment, level 1 the
second chunk of the ids that have one, and so on. A bitmap at each level says which entries go on, and a directory of
ranks (one count for every 512 bits) says where in the next level an entry goes on, so that any token of a segment is
read without decoding its neighbours.

Layout of a segment, little-endian: ``TMDA``, u8 version, u8 levels, u16 zero, u64 tokens, u64 entries of each level;
then for each level its chunks, and (but for the last) its bitmap, lowest bit first, and its directory of u32 ranks.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, small_batches, text_bytes
from .encoding import encoder

MAGIC = b"TMDA"
EVERY = 512
#: Tokens after which a segment ends; documents are never split.
SEGMENT_TOKENS = 1 << 18


def encode_segment(ids: np.ndarray) -> bytes:
    """The bytes of a segment that holds these ids (unsigned 32-bit)."""
    ids = np.ascontiguousarray(ids, "<u4")
    levels, rest = [], ids
    while True:
        chunk, rest = (rest & np.uint32(0xFF)).astype(np.uint8), rest >> np.uint32(8)
        on = rest > 0
        levels.append((chunk, on))
        if not on.any():
            break
        rest = rest[on]
    out = [MAGIC, struct.pack("<BBHQ", 1, len(levels), 0, len(ids)), struct.pack(f"<{len(levels)}Q", *(len(c) for c, _ in levels))]
    for k, (chunk, on) in enumerate(levels):
        out.append(chunk.tobytes())
        if k + 1 < len(levels):
            sums = np.add.reduceat(on, np.arange(0, len(on), EVERY), dtype=np.uint32)
            out.append(np.packbits(on, bitorder="little").tobytes())
            out.append((np.cumsum(sums, dtype=np.uint32) - sums).astype("<u4").tobytes())
    return b"".join(out)


class Segment:
    """Reads tokens of an encoded segment."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        _, levels, _, self.n = struct.unpack_from("<BBHQ", data, 4)
        sizes = struct.unpack_from(f"<{levels}Q", data, 16)
        at, self.levels = 16 + 8 * levels, []
        for k, n in enumerate(sizes):
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            bits = ranks = None
            if k + 1 < levels:
                bits = np.frombuffer(data, np.uint8, (n + 7) // 8, at)
                at += len(bits)
                ranks = np.frombuffer(data, "<u4", (n + EVERY - 1) // EVERY, at)
                at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return self.n

    def _rank(self, level: int, i: int) -> int:
        """Entries before i of this level that go on."""
        _, bits, ranks = self.levels[level]
        if i >= len(self.levels[level][0]):
            return len(self.levels[level + 1][0])
        block = i // EVERY
        own = np.unpackbits(bits[block * EVERY // 8 : i // 8 + 1], bitorder="little")[: i - block * EVERY]
        return int(ranks[block]) + int(own.sum())

    def get(self, i: int) -> int:
        """Token i, with one directory look-up for each level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for k, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if bits is None or not bits[i // 8] >> (i % 8) & 1:
                break
            i, shift = self._rank(k, i), shift + 8
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Tokens a to b - 1 as unsigned 32-bit integers."""
        a, b = max(0, a), min(b, self.n)
        out = np.zeros(max(0, b - a), "<u4")
        into = np.arange(len(out))
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[into] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * k)
            if bits is None or a >= b:
                break
            low = a // 8
            on = np.unpackbits(bits[low : (b + 7) // 8], bitorder="little")[a - 8 * low : b - 8 * low].astype(bool)
            into = into[on]
            a = self._rank(k, a)
            b = a + len(into)
        return out


_SEGMENTS = "part int, seg int, first long, n_tokens long, doc_ids array<long>, lengths array<long>, codes binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each text, appends end_id to it, and writes segments to `path` in ascending id order; returns them.

    Texts are dealt by ranges of (id, text hash), so that repeated ids spread too, and encoded after the sort. Each row
    is one segment: `first` counts the tokens before it in its part; parts follow each other in id order. Null texts
    are empty, rows with a null id come first, repeated rows stay as they are, an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seg, first = TaskContext.get().partitionId(), 0, 0
        end = b"" if end_id is None else struct.pack("<I", end_id)
        ids: list[int | None] = []
        held: list[bytes] = []
        tokens = 0
        enc = encoder(tokenizer)

        def flush() -> pa.RecordBatch:
            codes = encode_segment(np.frombuffer(b"".join(held), "<u4"))
            row = {"part": [part], "seg": [seg], "first": [first], "n_tokens": [tokens], "doc_ids": [ids], "lengths": [[len(x) // 4 for x in held]], "codes": [codes]}
            return pa.RecordBatch.from_pydict(row, schema=_schema())

        for batch in batches:
            for i, found in zip(batch.column(0).to_pylist(), enc.encode(text_bytes(batch.column(1))), strict=True):
                ids.append(i)
                held.append(found + end)
                tokens += len(held[-1]) // 4
                if tokens >= SEGMENT_TOKENS:
                    yield flush()
                    seg, first, tokens, ids, held = seg + 1, first + tokens, 0, [], []
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    spread.mapInArrow(encode, _SEGMENTS).write.parquet(path)
    return read_token_files(docs.sparkSession, path)


def _schema() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("codes", pa.binary())])


def read_token_files(spark, path: str) -> DataFrame:
    """The segments below `path`."""
    return spark.read.schema(_SEGMENTS).parquet(path)


def part_starts(segments: DataFrame) -> dict[int, int]:
    """For each part the tokens of the parts before it. One number for each of Spark's own partitions."""
    starts, total = {}, 0
    for part, n in sorted(tuple(r) for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        starts[part] = total
        total += n
    return starts


def token_directory(segments: DataFrame) -> DataFrame:
    """Per document, read from the written codes: doc_id, start, n_tokens and the crc32 of its ids."""
    starts = part_starts(segments)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment, lengths = Segment(row["codes"]), np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(segment.slice(b - n, b).tobytes()) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                begin = ends - lengths + (starts[row["part"]] + row["first"])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_ids"], pa.int64()), "start": begin, "n_tokens": lengths, "ids_crc32": pa.array(crcs, pa.int64())})

    return segments.select("part", "first", "doc_ids", "lengths", "codes").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export_files(segments: DataFrame, folder: str) -> int:
    """Writes each segment as a file of its own to a folder that the driver can open, for readers outside Spark."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    for row in segments.select("part", "seg", "codes").toLocalIterator():
        with open(os.path.join(folder, f"{row.part:06d}-{row.seg:06d}.tmda"), "wb") as f:
            f.write(row.codes)
        n += 1
    return n


def addressable_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the token files of `docs` to the shared folder and returns their directory, read back from them."""
    path = shared_path(docs.sparkSession, "token-ids")
    return token_directory(write_token_files(docs, path, tokenizer, end_id))
