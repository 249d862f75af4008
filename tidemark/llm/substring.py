"""Exact substring removal across documents by Rabin-Karp hashes of every window of 50 words.

A window is repeated when its word sequence also starts in a document with a smaller id. All windows of a text are
hashed, each with its anchor: the least hash among the 16-word windows inside it. Equal windows have equal anchors, so
only windows whose anchor occurs in two documents need counting. The steps:

1. (anchor, document) pairs of all texts, grouped in Spark: which anchors lie in more than one document.
2. Documents with such anchors send these anchors' windows: Rabin-Karp hash, second hash, document, place. A task that
   meets a window again in a larger id knows it to be a repeat and sends its interval alone.
3. Spark finds the smallest id of each window, by its two hashes. A window that very many documents hold comes about
   once from each task, so no task gets a hot group.
4. The windows of each document merge into maximal intervals of words, which are cut from its text.

Nothing is sampled or capped; a window counts as repeated when its Rabin-Karp hash and the second one agree (125 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunked, small_batches, text_bytes, written
from .hashing import Words, mixed_windows, window_hashes, words

WINDOW = 50
ANCHOR = 16


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each n consecutive values."""
    held, span = x, 1
    while 2 * span <= n:
        held, span = np.minimum(held[:-span], held[span:]), 2 * span
    rest = n - span
    return np.minimum(held[: len(held) - rest], held[rest:]) if rest else held


#: Repeated windows that a task remembers from one batch to the next; may be forgotten without harm.
REMEMBERED = 1 << 17


class Windows:
    """All windows of a batch of texts: text, first word, anchor and, where wanted, both hashes."""

    def __init__(self, w: Words, size: int, anchor: int, hashed: bool = True):
        n = len(w.hash) - size + 1
        ok = np.flatnonzero(w.doc[:n] == w.doc[size - 1 :]) if n > 0 else np.zeros(0, np.int64)
        self.text = w.doc[ok]
        self.at = ok - w.first[self.text]
        none = np.zeros(0, np.uint64)
        self.anchor = _sliding_min(mixed_windows(w.hash, anchor), size - anchor + 1)[ok] if len(ok) else none
        self.hash = window_hashes(w.hash, size)[ok] if hashed and len(ok) else none
        self.hash2 = mixed_windows(w.hash2, size)[ok] if hashed and len(ok) else none

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of consecutive windows of one text with one anchor begin, and end."""
        if not len(self.text):
            return self.at, self.at
        new = np.flatnonzero((self.text[1:] != self.text[:-1]) | (self.anchor[1:] != self.anchor[:-1])) + 1
        return np.concatenate(([0], new)), np.concatenate((new, [len(self.text)]))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    return rows.withColumn("text_key", F.xxhash64("text"))


def shared_anchors(rows: DataFrame, size: int, anchor: int) -> DataFrame:
    """doc_id, anchors: those of each document's anchors that also lie in another document."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), text_bytes(batch.column(1))
            for a, b in chunked(texts):
                w = Windows(words(texts[a:b]), size, anchor, hashed=False)
                begin, _ = w.runs()
                if len(begin):
                    yield pa.RecordBatch.from_arrays([pa.array(w.anchor[begin].view(np.int64)), pa.array(ids[a:b][w.text[begin]])], ["anchor", "doc_id"])

    pairs = written(rows.select("doc_id", "text").mapInArrow(emit, "anchor long, doc_id long"), "anchors")
    shared = pairs.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    return pairs.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))


class Known:
    """Repeated windows that a task has met, with the smallest id of each."""

    def __init__(self):
        self.hash = self.hash2 = np.zeros(0, np.uint64)
        self.doc = np.zeros(0, np.int64)

    def repeats(self, hash: np.ndarray, hash2: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which of these windows are also in a smaller document, as far as the task knows."""
        h = np.concatenate((self.hash, hash))
        h2, d = np.concatenate((self.hash2, hash2)), np.concatenate((self.doc, doc))
        order = np.lexsort((d, h2, h))
        h, h2, d = h[order], h2[order], d[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])))[: len(h)]
        begin = np.flatnonzero(new)
        least = np.repeat(d[begin], np.diff(np.append(begin, len(d))))
        out = np.empty(len(d), bool)
        out[order] = d > least
        known = begin[np.maximum.reduceat(d > least, begin)] if len(begin) else begin
        held = len(self.doc)
        if len(known) > REMEMBERED:
            known = known[:0]
        self.hash, self.hash2, self.doc = h[known], h2[known], d[known]
        return out[held:]


_SENT = "hash long, hash2 long, doc_id long, text_key long, at int, n int, more array<int>"


def _sent_windows(rows: DataFrame, anchors: DataFrame, size: int, anchor: int) -> DataFrame:
    """Windows with a shared anchor, as (hash, hash2) at a place, and where else in a batch of the same text (more); and
    runs of n windows that are known to be repeated."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            ids, keys, texts, wanted = batch.column(0).to_numpy(), batch.column(1).to_numpy(), text_bytes(batch.column(2)), batch.column(3)
            for a, b in chunked(texts):
                w = Windows(words(texts[a:b]), size, anchor)
                own, edges = w.anchor.view(np.int64), np.searchsorted(w.text, np.arange(b - a + 1))
                shared = np.zeros(len(own), bool)
                for i in np.flatnonzero(np.diff(edges)).tolist():
                    shared[edges[i] : edges[i + 1]] = np.isin(own[edges[i] : edges[i + 1]], wanted[a + i].values.to_numpy())
                at = np.flatnonzero(shared)
                if not len(at):
                    continue
                text = a + w.text[at]
                again = known.repeats(w.hash[at], w.hash2[at], ids[text])
                if not again.all():
                    k = at[~again]
                    k = k[np.lexsort((k, w.text[k], w.hash2[k], w.hash[k]))]
                    same = [x[k[1:]] == x[k[:-1]] for x in (w.hash, w.hash2, w.text)]
                    begin = np.flatnonzero(np.concatenate(([True], ~(same[0] & same[1] & same[2]))))
                    one, n = k[begin], np.diff(np.append(begin, len(k)))
                    others = np.delete(w.at[k], begin).astype(np.int32)
                    more = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n - 1))), pa.int32()), pa.array(others), mask=pa.array(n == 1))
                    yield _batch(w.hash[one].view(np.int64), w.hash2[one].view(np.int64), ids[a + w.text[one]], keys[a + w.text[one]], w.at[one], np.ones(len(one)), more)
                if again.any():
                    place, t = w.at[at[again]], text[again]
                    begin = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (np.diff(place) != 1))))
                    yield _batch(None, None, ids[t[begin]], keys[t[begin]], place[begin], np.diff(np.append(begin, len(place))), None)

    return rows.join(anchors, "doc_id").select("doc_id", "text_key", "text", "anchors").mapInArrow(emit, _SENT)


def _batch(*columns: np.ndarray | pa.Array | None) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
    rows = len(columns[2])
    arrays = [pa.nulls(rows, k) if c is None else c if isinstance(c, pa.Array) else pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["hash", "hash2", "doc_id", "text_key", "at", "n", "more"])


def _repeated(sent: DataFrame) -> DataFrame:
    """doc_id, text_key, first, n: runs of repeated windows."""
    equal = Window.partitionBy("hash", "hash2")
    # Runs that are known to be repeated need no partner: null hashes are dealt out by place.
    spread = sent.withColumn("hash2", F.coalesce("hash2", F.xxhash64("doc_id", "at")))
    least = spread.withColumn("least", F.min("doc_id").over(equal))
    found = least.where("hash is null or least < doc_id")
    places = F.concat(F.array("at"), F.coalesce("more", F.array().cast("array<int>")))
    return found.select("doc_id", "text_key", F.explode(places).alias("first"), "n")


def repeated_spans(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: for each id with repeats, (text_key, first, end) of the words that they cover.

    Words are runs of anything but ASCII white space, compared byte by byte. text_key (Spark's xxhash64 of the text)
    tells rows that share an id apart; these don't count as repeats of each other. Null, empty and short texts have no
    windows; rows with a null id take no part. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows, anchor = _rows(docs, id_col, text_col), max(1, min(ANCHOR, size // 2))
    runs = _repeated(_sent_windows(rows, shared_anchors(rows, size, anchor), size, anchor))
    span = F.struct("text_key", "first", (F.col("first") + F.col("n") + size - 1).alias("end"))
    return runs.groupBy("doc_id").agg(F.collect_set(span).alias("spans"))


def merged(first: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal intervals that the spans cover."""
    if not len(first):
        return []
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    begin = np.flatnonzero(np.concatenate(([True], first[1:] > reach[:-1])))
    return list(zip(first[begin].tolist(), reach[np.append(begin[1:] - 1, len(first) - 1)].tolist(), strict=True))


def remove_repeats(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, removed (maximal word intervals), kept_text (kept words joined by one space).

    One row for each row with an id; see repeated_spans for the rules.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            spans = batch.column(3)
            edges, held = spans.offsets.to_numpy(), [spans.values.field(c).to_numpy() for c in ("text_key", "first", "end")]
            for k, (doc, key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True)):
                span_key, first, end = (x[edges[k] : edges[k + 1]] for x in held)
                own, removed, kept, at = (text or b"").split(), merged(first[span_key == key], end[span_key == key]), [], 0
                for a, b in removed:
                    kept += own[at:a]
                    at = b
                if removed:
                    kept += own[at:]
                else:
                    kept = own
                out.append((doc, len(own), len(own) - len(kept), [{"first": a, "end": b} for a, b in removed], b" ".join(kept).decode("utf-8")))
            if out:
                spans_type = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), spans_type, pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "removed", "kept_text"])

    spans = repeated_spans(docs, size, id_col, text_col)
    # By id alone, as in the join with the anchors: Spark shuffles the texts once for both.
    found = _rows(docs, id_col, text_col).join(spans, "doc_id", "left").select("doc_id", "text_key", "text", "spans")
    return found.mapInArrow(cut, "doc_id long, n_words long, n_removed long, removed array<struct<first:int,end:int>>, kept_text string")
