"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by size, the number n of their distinct five-word shingles. An item is contained in a text when
at least `need` = ceil(threshold * n) of its shingles occur there. Its sketch is its bottom n - need + h shingles in
min-hash order, where the hits h that are asked for grow with the size class: a text that holds `need` of the shingles
misses n - need at most, so it holds h of the sketch's at least, however long it is. Texts with fewer hits are no
candidates, and the search loses nothing. Candidates are verified by exact containment of the whole shingle set, under
a second hash of the words as well.

The whole text is looked up, shingle by shingle; it has no sketch of its own, which would make recall a matter of chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, rows_where, small_batches, text_bytes
from .hashing import Words, mix, window_hashes, words

SHINGLE = 5
#: Containment in percent.
THRESHOLD = 75
#: Shingles of items that are held at once (8 bytes each); more items are searched for in further blocks.
BLOCK_SHINGLES = 2_000_000


def lowered(texts: list[bytes | None]) -> list[bytes | None]:
    return [t if t is None else t.lower() if t.isascii() else t.decode("utf-8", "replace").lower().encode("utf-8") for t in texts]


def split(texts: list[bytes | None]) -> Words:
    """Words of the texts in lower case: all that isn't punctuation, a symbol, a space or a control character."""
    return words(lowered(texts), plain=True, marks=True)


def item_shingles(w: Words, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Words in a shingle, and the distinct shingles by both hashes, of text k; an item with fewer words has one
    shingle, of that many words."""
    at = slice(w.first[k], w.first[k + 1])
    size = min(SHINGLE, len(w.hash[at]))
    if not size:
        return 0, w.hash[:0], w.hash[:0]
    found, first = np.unique(window_hashes(w.hash[at], size), return_index=True)
    return size, found, window_hashes(w.hash2[at], size)[first]


def sketch_hits(n: int) -> int:
    """Hits in an item's sketch that make a text a candidate: one for small items, more for each larger size class."""
    return max(1, (1 << n.bit_length()) // 16)


class ContainmentIndex:
    """Finds in texts the items (id, words in a shingle, shingles by both hashes) that these contain."""

    def __init__(self, items: list[tuple[int, int, np.ndarray, np.ndarray]], threshold: int):
        self.items, self.threshold = items, threshold
        self.hits = np.array([sketch_hits(len(s)) for _, _, s, _ in items], np.int64)
        self.sketches: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({n for _, n, s, _ in items if len(s)}):
            keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, (_, n, s, _) in enumerate(items):
                if n == size:
                    need = -(-threshold * len(s) // 100)
                    by_hash = s[np.argsort(mix(s ^ np.uint64(0x6A09E667F3BCC909)))][: len(s) - need + int(self.hits[i])]
                    keys.append(by_hash)
                    owners.append(np.full(len(by_hash), i))
            key, owner = np.concatenate(keys), np.concatenate(owners)
            order, screen = np.argsort(key, kind="stable"), np.zeros(1 << 20, bool)
            screen[(key >> np.uint64(44)).astype(np.int64)] = True
            self.sketches[size] = key[order], owner[order], screen

    @staticmethod
    def _probe(runs: np.ndarray, key: np.ndarray, owner: np.ndarray, screen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `runs` of sketch entries, and the items that own these."""
        at = np.flatnonzero(screen[(runs >> np.uint64(44)).astype(np.int64)])
        low = np.searchsorted(key, runs[at], "left")
        n = np.searchsorted(key, runs[at], "right") - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), owner[np.repeat(low, n) + nth]

    def search(self, w: Words) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, shingles of the item, those that the text holds) for every text that contains an item."""
        for size, sketch in self.sketches.items():
            runs = window_hashes(w.hash, size)
            at, item = self._probe(runs, *sketch)
            inside = w.doc[at] == w.doc[at + size - 1]
            at, item = at[inside], item[inside]
            if not len(at):
                continue
            doc = w.doc[at]
            order = np.lexsort((runs[at], item, doc))  # a shingle that a text repeats is one hit
            doc, item, hit = doc[order], item[order], runs[at][order]
            pair = np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
            begin = np.flatnonzero(pair)
            hits = np.add.reduceat(np.concatenate(([True], pair[1:] | (hit[1:] != hit[:-1]))).astype(np.int64), begin)
            second, own, last = None, None, -1
            for d, i in zip(*(x[begin[hits >= self.hits[item[begin]]]].tolist() for x in (doc, item)), strict=True):
                if d != last:
                    span = slice(w.first[d], w.first[d + 1])
                    own, first = np.unique(window_hashes(w.hash[span], size), return_index=True)
                    second, last = window_hashes(w.hash2[span], size)[first], d
                _, _, s, other = self.items[i]
                place = np.minimum(np.searchsorted(own, s), len(own) - 1)
                shared = int(((own[place] == s) & (second[place] == other)).sum())
                if 100 * shared >= self.threshold * len(s):
                    yield d, i, len(s), shared


def _indexes(items: DataFrame, threshold: int, id_col: str, text_col: str) -> Iterator[ContainmentIndex]:
    """The items in blocks of BLOCK_SHINGLES; a block at a time comes to the driver, which indexes it."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = split(text_bytes(batch.column(1)))
            each = [item_shingles(w, k) for k in range(batch.num_rows)]
            both = [[x[k].astype("<u8").tobytes() for x in each] for k in (1, 2)]
            yield pa.RecordBatch.from_pydict({"item_id": batch.column(0), "size": pa.array([x[0] for x in each], pa.int32()), "shingles": pa.array(both[0], pa.binary()), "second": pa.array(both[1], pa.binary())})

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null").distinct()
    block, held = [], 0
    for r in rows.mapInArrow(sketch, "item_id long, size int, shingles binary, second binary").toLocalIterator():
        s = np.frombuffer(r.shingles, "<u8").astype(np.uint64)
        if held and held + len(s) > BLOCK_SHINGLES:
            yield ContainmentIndex(block, threshold)
            block, held = [], 0
        block.append((r.item_id, r.size, s, np.frombuffer(r.second, "<u8").astype(np.uint64)))
        held += len(s)
    if block:
        yield ContainmentIndex(block, threshold)


def contained_items(docs: DataFrame, items: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document and item it contains: doc_id, item_id, item_shingles, shared_shingles, containment.

    Words are runs of letters, digits and marks on these of any script, in lower case; punctuation, symbols and spaces of any script separate them. Items with fewer than five words are looked for as one shingle
    of that many words. Null and empty texts contain nothing and are contained in nothing; rows with a null id take no
    part; repeated rows give their result once each; an item id whose rows have several texts counts as each of them.
    The index of a block of items has a fixed bound and goes to every worker; more items take another pass each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    schema = "doc_id long, item_id long, item_shingles int, shared_shingles int"
    out = spark.createDataFrame([], schema)
    for index in _indexes(items, threshold, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
                for a, b in chunked(texts):
                    hits = [(ids[a + d], index.items[i][0], n, k) for d, i, n, k in index.search(split(texts[a:b]))]
                    if hits:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "item_shingles", "shared_shingles"])

        out = out.unionAll(rows.mapInArrow(search, schema))
    return out.withColumn("containment", F.col("shared_shingles") / F.col("item_shingles"))


def without_items(docs: DataFrame, items: DataFrame, threshold: int = THRESHOLD, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, columns as they are, whose texts contain no item. Null and empty texts contain none."""
    spark = docs.sparkSession
    small_batches(spark)
    for index in _indexes(items, threshold, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(index)

        def keep(shared=shared):
            index = shared.value

            def marks(texts: list[bytes | None]) -> list[bool]:
                out = [True] * len(texts)
                for a, b in chunked(texts):
                    for d, *_ in index.search(split(texts[a:b])):
                        out[a + d] = False
                return out

            return marks

        docs = rows_where(docs, keep, text_col)
    return docs
