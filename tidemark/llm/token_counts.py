"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie. Each node has a failure link, and the number of tokens that a matcher gives off when it falls
back along it, worked out once. Reading a word then takes one step a letter, without restarting at any letter and
without building pieces: the count of a word is the sum of the numbers on the links it falls along.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, small_batches, text_bytes
from .encoding import byte_letters

END = "</w>"


class LongestMatch:
    """Counts the pieces of greedy longest-match-first tokenization. A word ends in the symbol END."""

    def __init__(self, vocabulary: Iterable[tuple[str, ...]]):
        self.next: list[dict[str, int]] = [{}]
        token = [False]
        for piece in vocabulary:
            v = 0
            for c in piece:
                if c not in self.next[v]:
                    self.next[v][c] = len(self.next)
                    self.next.append({})
                    token.append(False)
                v = self.next[v][c]
            token[v] = v > 0
        self.fail: list[int] = [-1] * len(self.next)
        self.popped: list[int] = [0] * len(self.next)
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for c, v in self.next[u].items():
                todo.append(v)
                if token[v]:
                    self.fail[v], self.popped[v] = 0, 1
                    continue
                z, n = self.fail[u], self.popped[u]
                while z >= 0 and c not in self.next[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.next[z][c], n

    def count(self, symbols: Iterable[str]) -> int:
        """Pieces of a word; a word that the vocabulary can't spell is one unknown piece."""
        v = n = 0
        for c in symbols:
            while c not in self.next[v]:
                if self.fail[v] < 0:
                    return 1
                n += self.popped[v]
                v = self.fail[v]
            v = self.next[v][c]
        while v:
            if self.fail[v] < 0:
                return 1
            n += self.popped[v]
            v = self.fail[v]
        return n


class PieceCounter:
    """Words and greedy pieces of texts under the vocabulary of a tokenizer file with word ends.

    Texts are normalised and split into words as the file says (NFC, lower case, its word pattern). Counts of strings
    between white space are remembered, up to a bound.
    """

    MOST = 1_000_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pieces = ((*p.removesuffix(END), END) if p.endswith(END) else tuple(p) for p in spec["model"]["vocab"])
        self.automaton = LongestMatch(pieces)
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.known: dict[bytes, int] = {}

    def words(self, text: str) -> list[str]:
        import unicodedata

        return self.pattern.findall("".join(map(str.lower, unicodedata.normalize("NFC", text))))

    def of_word(self, word: str) -> int:
        return self.automaton.count(chain((self.letters[b] for b in word.encode("utf-8")), (END,)))

    def _packed(self, piece: bytes) -> int:
        """Words and pieces of a string without white space, in one number."""
        found = self.words(piece.decode("utf-8", "replace"))
        return len(found) << 32 | sum(map(self.of_word, found))

    def counts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        words, pieces = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for a, b in chunked(texts):
            split = [(t or b"").split() for t in texts[a:b]]
            new = set().union(*split).difference(self.known)
            if len(self.known) + len(new) > self.MOST:
                self.known.clear()
                new = set().union(*split)
            extra = {}
            for p in new:
                (self.known if len(p) <= 64 and len(self.known) < self.MOST else extra)[p] = self._packed(p)
            get = (lambda p, extra=extra: extra[p] if p in extra else self.known[p]) if extra else self.known.__getitem__
            for i, own in enumerate(split):
                both = np.fromiter(map(get, own), np.int64, len(own))
                words[a + i], pieces[a + i] = (both >> 32).sum(), (both & 0xFFFFFFFF).sum()
        return words, pieces


_counters: dict[str, PieceCounter] = {}


def piece_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens for every row; null texts have none of either. Rows with null or repeated ids count too."""
    small_batches(docs.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _counters:
            _counters[tokenizer] = PieceCounter(tokenizer)
        for batch in batches:
            words, pieces = _counters[tokenizer].counts(text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(pieces)], ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(emit, "doc_id long, n_words long, n_tokens long")
