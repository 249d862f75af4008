"""Toxicity scores from a learned lexicon, matched by Levenshtein automata.

A lexicon of terms (whole words, or stems that many words begin with) is learned from labelled texts. It is kept as a
trie. For every word of a text a Levenshtein automaton, run along the trie's edges, finds the term within one edit, or
the stem within one edit of some prefix (exact matches and stems first), so misspelled terms count too. Stems and short
terms have many neighbours: they are matched so only where clean labelled texts hold few words that are near, and
words that those texts hold as often as others don't count. Words are runs of letters and digits of any script and any
length. Each hit is weighed by the words around it: marks of quotation, and the words that labelled texts have beside
hits more in clean rows (quotation, report) or in toxic ones (address, abuse), say how far a hit is a quotation. A
logistic model turns the sums of a text into a score.

The fit is the same in every run: near copies give way to the one with the least hash, and nothing else is chosen.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, rows_where, small_batches, text_bytes, written
from .decontaminate import lowered
from .hashing import Words, mix, shingle_sets, words

#: Labelled rows of each class that the lexicon and the model are fitted on, at most: the bound on the fit's sample.
TRAIN_ROWS = 10_000
#: Positive rows that a term must be in, how much likelier it must be there, and how far (the logarithm of the likelihood
#: ratio) its counts must be from those of a word that says nothing: few of a million such words get so far.
LEAST_ROWS, LEAST_RATIO, EVIDENCE = 4, 25.0, 12.0
#: Letters of the shortest term, and of the longest prefix that may be a stem; whole words have any length.
SHORTEST, LONGEST_STEM = 3, 16
MIN_HASHES = 4
#: Words on each side of a hit that its context takes in.
CONTEXT = 6
FUZZY_LETTERS = 5
#: Share of clean rows that may hold an unseen word near a stem or a short term, for it to be matched with an edit.
NEAR_SHARE = 0.002
#: What quotation marks around a hit say before any text is seen: of 10 marked hits, half of them expected to be clean,
#: how many are clean and how many toxic.
MARKED_PRIOR = (8.2, 1.8)

#: Marks before and after a quotation.
QUOTES = tuple((a.encode(), b.encode()) for a, b in ('""', "“”", "„“", "«»", "»«", "‹›", "「」"))

EXACT, STEM, FUZZY = 1, 2, 3


@dataclass
class Node:
    next: dict[str, Node] = field(default_factory=dict)
    kind: int = 0


class Trie:
    """Terms that are met by automaton, and what words near them must hold."""

    def __init__(self, terms: dict[str, int]):
        self.root = Node()
        # One edit leaves the first or the last half of a term as it is: so a word must begin or end with one. What
        # follows a stem is open: there its last half may be at three places.
        self.starts: set[str] = set()
        self.ends: set[str] = set()
        self.middles: dict[tuple[int, int], set[str]] = {}
        for term, kind in terms.items():
            Lexicon._add(self.root, term, kind)
            half = len(term) // 2
            self.starts.add(term[:half])
            if kind == STEM:
                for at in (half - 1, half, half + 1):
                    self.middles.setdefault((at, len(term) - half), set()).add(term[half:])
            else:
                self.ends.add(term[half:])
        self.longest = max(map(len, terms), default=0)
        self.start_sizes, self.end_sizes = sorted({len(x) for x in self.starts}), sorted({len(x) for x in self.ends})

    def near(self, word: str) -> bool:
        """Whether a word may be near a term."""
        return any(word[:n] in self.starts for n in self.start_sizes) or any(word[-n:] in self.ends for n in self.end_sizes) or any(word[at : at + n] in held for (at, n), held in self.middles.items())


class Lexicon:
    """A trie of terms. Stems match every word that begins with them; other terms match words within one edit.

    `near` are the stems, and the terms of under FUZZY_LETTERS letters, that are met with an edit as well (null: stems
    of that many letters), but for words in `clean`.
    """

    def __init__(self, terms: dict[str, int], near: frozenset[str] | None = None, clean: frozenset[str] = frozenset()):
        self.terms, self.root, self.clean = terms, Node(), clean
        for term, kind in terms.items():
            self._add(self.root, term, kind)
        if near is None:
            near = frozenset(t for t in guarded(terms) if len(t) >= FUZZY_LETTERS)
        #: Letters of a word that decide about every term.
        self.letters = max(map(len, terms), default=0) + 2
        self.words = Trie({t: k for t, k in terms.items() if k == EXACT and len(t) >= FUZZY_LETTERS})
        self.guarded = Trie({t: k for t, k in terms.items() if t in near})

    @staticmethod
    def _add(node: Node, term: str, kind: int) -> None:
        for c in term:
            node = node.next.setdefault(c, Node())
        node.kind = kind

    def match(self, word: str) -> int:
        """EXACT, STEM, FUZZY or 0."""
        node = self.root
        for c in word:
            node = node.next.get(c)
            if node is None:
                break
            if node.kind == STEM:
                return STEM
        if node is not None and node.kind:
            return node.kind
        return FUZZY if self._within_one(self.words, word) or word not in self.clean and self._within_one(self.guarded, word) else 0

    @staticmethod
    def _within_one(trie: Trie, word: str) -> bool:
        """Intersects the trie with the automaton of all strings one edit from the word, or for stems from a prefix.

        Bit i of a state says that i letters of the word are consumed: `same` without an edit, `one` with one.
        """
        word = word[: trie.longest + 2]
        if not trie.near(word):
            return False
        place: dict[str, int] = {}
        for i, c in enumerate(word):
            place[c] = place.get(c, 0) | 1 << i
        full, end = (1 << len(word) + 1) - 1, 1 << len(word)
        todo = [(trie.root, 1, 2)]
        while todo:
            node, same, one = todo.pop()
            if node.kind and one & (full if node.kind == STEM else end):
                return True
            for c, child in node.next.items():
                on = place.get(c, 0)
                after = (same & on) << 1
                # match; the word lacks the letter; the word has another one; the word has one too many
                edited = ((one & on) << 1 | same | same << 1 | after << 1) & full
                if after or edited:
                    todo.append((child, after, edited))
        return False


def guarded(terms: dict[str, int]) -> list[str]:
    """Terms that need evidence to be met with an edit: stems and short terms, which have many neighbours."""
    return [t for t, kind in terms.items() if kind == STEM or len(t) < FUZZY_LETTERS]


def learn_near(terms: dict[str, int], words: list[tuple[str, int, int]], positive: int, negative: int) -> tuple[frozenset[str], frozenset[str]]:
    """Guarded terms that are met with an edit, and words that aren't, from (word, positive rows, negative rows).

    A word near a term that clean rows hold counts as a misspelling only where it is LEAST_RATIO times likelier in
    positive rows. The clean words that one row alone holds estimate how many more there are (Good and Turing): a term
    with too many isn't met with an edit.
    """
    clean = {w: neg for w, pos, neg in words if neg and pos / max(1, positive) < LEAST_RATIO * neg / max(1, negative)}
    near = set()
    for t in guarded(terms):
        trie = Trie({t: terms[t]})
        if 1 + sum(n == 1 and Lexicon._within_one(trie, w) for w, n in clean.items()) <= NEAR_SHARE * (1 + negative):
            near.add(t)
    every = Trie({t: terms[t] for t in near})
    return frozenset(near), frozenset(w for w in clean if Lexicon._within_one(every, w))


def evidence(pos: int, neg: int, share: float) -> float:
    """Logarithm of the likelihood ratio of these counts against a share of positive ones."""
    n = pos + neg
    return sum(k * math.log(k / (n * p)) for k, p in ((pos, share), (neg, 1 - share)) if k)


def learn_terms(units: list[tuple[str, int, int, int]], positive: int, negative: int) -> dict[str, int]:
    """Terms from (unit, whole-word rows, positive rows, negative rows), a unit being a whole word or a prefix.

    A unit qualifies when positive rows hold words that begin with it, negative ones hardly do, and chance is no
    likely cause. From the shortest on, it is lengthened while one longer unit keeps nearly all of its rows, and its
    extensions are dropped.
    """
    counts = {u: (whole, pos, neg) for u, whole, pos, neg in units}
    longer: dict[str, list[str]] = {}
    for u in counts:
        longer.setdefault(u[: min(len(u) - 1, LONGEST_STEM)], []).append(u)

    def strong(u: str) -> bool:
        _, pos, neg = counts[u]
        return pos >= LEAST_ROWS and pos / max(1, positive) >= LEAST_RATIO * (neg + 0.25) / max(1, negative) and evidence(pos, neg, positive / (positive + negative)) >= EVIDENCE

    found = {u for u in counts if strong(u)}
    terms: dict[str, int] = {}
    for u in sorted(found):
        if any(u[:n] in found for n in range(SHORTEST, min(len(u), LONGEST_STEM + 1))):
            continue
        while True:
            best = max(longer.get(u, []), key=lambda x: (counts[x][1], x), default=None)
            if best is None or counts[best][1] < 0.9 * counts[u][1]:
                break
            u = best
        whole, pos, _ = counts[u]
        terms[u] = EXACT if whole >= 0.8 * pos else STEM
    return terms


def split(texts: list[bytes | None]) -> Words:
    return words(lowered(texts), plain=True, marks=True)


def spelled(w: Words, at: int, letters: int | None = None) -> str:
    """A word, or its first letters."""
    end = int(w.end[at]) if letters is None else min(int(w.end[at]), int(w.start[at]) + 4 * letters)
    return w.buffer[w.start[at] : end].decode("utf-8", "replace")[:letters]


@dataclass(frozen=True)
class Context:
    """What speaks for a quotation, as logarithms of odds: marks around a hit, and words (by hash) beside it."""

    marks: float = math.log(MARKED_PRIOR[0] / MARKED_PRIOR[1])
    words: dict[int, float] = field(default_factory=dict)


def beside(w: Words, at: int) -> tuple[bool, set[int]]:
    """Whether the hit at this word stands between quotation marks, and the hashes of the words around it."""
    doc = int(w.doc[at])
    low, high = max(int(w.first[doc]), at - CONTEXT), min(int(w.first[doc + 1]), at + CONTEXT + 1)
    # What separates the window from the words beyond belongs to it.
    left = w.end[low - 1] if low > w.first[doc] else w.offset[doc]
    right = w.start[high] if high < w.first[doc + 1] else w.offset[doc + 1] if doc + 1 < len(w.offset) else len(w.buffer)
    before, after = w.buffer[left : w.start[at]], w.buffer[w.end[at] : right]
    marks = any(a in before and b in after and (a != b or before.count(a) % 2 == 1) for a, b in QUOTES)
    return marks, set(w.hash[low:at].tolist()) | set(w.hash[at + 1 : high].tolist())


def learn_context(rows: list[tuple[int | None, int, int, float]]) -> Context:
    """Weights from (hash of a word beside hits, clean rows, toxic rows, clean rows expected); null: marks around hits.

    What is expected follows from the words hit alone, so that a context doesn't stand for these. A word counts where
    chance is no likely cause of its counts.
    """

    def odds(neg: int, pos: int, expected: float, a: float, b: float) -> float:
        middle = (a + b) / 2
        return math.log((neg + a) / (expected + middle)) - math.log((pos + b) / (neg + pos - expected + middle))

    _, *marked = next((r for r in rows if r[0] is None), (None, 0, 0, 0.0))
    found = {h: odds(neg, pos, e, 0.5, 0.5) for h, neg, pos, e in rows if h is not None and 0 < e < neg + pos and evidence(pos, neg, 1 - e / (neg + pos)) >= EVIDENCE}
    return Context(odds(*marked, *MARKED_PRIOR), found)


class Matcher:
    """Finds hits of a lexicon in batches of texts; verdicts on words are remembered, up to a bound."""

    MOST = 300_000

    def __init__(self, lexicon: Lexicon, context: Context | None = None):
        self.lexicon, self.context = lexicon, context or Context()
        self.known: dict[int, int] = {}

    def hits(self, texts: list[bytes | None]) -> Iterator[tuple[int, Words, np.ndarray]]:
        """For each part of the texts its first text's index, its words, and what each word is."""
        for a, b in chunked(texts):
            w = split(texts[a:b])
            if not len(w.hash):
                continue
            unique, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
            verdicts = np.zeros(len(unique), np.int8)
            if len(self.known) + len(unique) > self.MOST:
                self.known.clear()
            known, match, letters = self.known, self.lexicon.match, self.lexicon.letters
            for i, (h, f) in enumerate(zip(unique.tolist(), first.tolist(), strict=True)):
                v = known.get(h)
                if v is None:
                    v = known[h] = match(spelled(w, f, letters))
                verdicts[i] = v
            yield a, w, verdicts[inverse]

    def features(self, texts: list[bytes | None]) -> np.ndarray:
        """One row for each text: how much exact, stem, misspelled and quoted hits it has, and hits for each word."""
        out = np.zeros((len(texts), 5))
        for a, w, found in self.hits(texts):
            for at in np.flatnonzero(found).tolist():
                doc, quoted = int(w.doc[at]), self._quoted(w, at)
                out[a + doc, found[at] - 1] += 1 - quoted
                out[a + doc, 3] += quoted
            n = len(w.first) - 1
            out[a : a + n, 4] = np.bincount(w.doc, weights=found > 0, minlength=n) / np.maximum(1, np.diff(w.first))
        out[:, :4] = 1 - np.exp(-1.5 * out[:, :4])  # the first hit says most
        out[:, 4] = np.sqrt(out[:, 4])
        return out

    def _quoted(self, w: Words, at: int) -> float:
        """0 (nothing speaks for a quotation) to 1."""
        marks, near = beside(w, at)
        odds = self.context.marks * marks + sum(sorted(self.context.words[h] for h in near & self.context.words.keys()))
        return max(0.0, math.tanh(odds / 2))


#: What hits weigh before any text is seen: a kind of hit that the labelled texts lack keeps its weight.
PRIOR = (8.0, 8.0, 8.0, 0.0, 0.0, 0.0)


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: tuple[float, ...] = PRIOR, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (last: intercept) of a logistic regression that is drawn to the prior, by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    middle = np.array(prior)
    w = middle.copy()
    penalty = ridge * len(x) * np.diag([1.0] * (len(w) - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - penalty @ (w - middle))
        w = w + step * min(1.0, 4.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    terms: dict[str, int]
    weights: np.ndarray
    near: frozenset[str] | None = None
    clean: frozenset[str] = frozenset()
    context: Context = Context()

    def matcher(self) -> Matcher:
        return Matcher(Lexicon(self.terms, self.near, self.clean), self.context)


def word_sets(texts: list[bytes | None]) -> Iterator[set[str]]:
    """The distinct words of each text."""
    for a, b in chunked(texts):
        w = split(texts[a:b])
        _, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        found = [spelled(w, k) for k in first.tolist()]
        for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            yield {found[k] for k in np.unique(inverse[i:j]).tolist()}


class Units:
    """Distinct words of texts, and their units: their prefixes of up to LONGEST_STEM letters, and themselves."""

    MOST = 50_000

    def __init__(self):
        self.known: dict[str, tuple[str, ...]] = {}

    def _units(self, word: str) -> tuple[str, ...]:
        out = self.known.get(word)
        if out is None:
            out = tuple(word[:n] for n in range(SHORTEST, min(len(word), LONGEST_STEM) + 1))
            if len(word) > LONGEST_STEM:
                return (*out, word)  # too rare and too long to be remembered
            if len(self.known) >= self.MOST:
                self.known.clear()
            self.known[word] = out
        return out

    def of(self, texts: list[bytes | None]) -> Iterator[tuple[set[str], set[str]]]:
        for found in word_sets(texts):
            own = {w for w in found if len(w) >= SHORTEST}
            yield own, set().union(*map(self._units, own))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns lexicon, contexts and weights from labelled texts: TRAIN_ROWS of each class at most, by a hash of the id.

    Of several labels for an id the highest counts. Null labels, ids and texts are left out. A text that agrees with
    another of its label in two of MIN_HASHES min-hashes (near copies mostly do) stays only if its hash is the lesser
    one, or words of copies would pass for terms. Without rows of both classes the model knows no terms, and scores the share of the class that there is.
    """
    spark = docs.sparkSession
    small_batches(spark)
    given = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    given = given.groupBy("doc_id").agg(F.max("label").alias("label"))
    some = [given.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS) for k in (0, 1)]
    chosen = F.broadcast(some[0].unionAll(some[1]))  # 2 * TRAIN_ROWS rows of two numbers at most
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")

    marks = [f"m{i}" for i in range(MIN_HASHES)]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(1, MIN_HASHES + 1, dtype=np.uint64))
        for batch in batches:
            least = np.zeros((batch.num_rows, MIN_HASHES), np.int64)
            for a, b in chunked(texts := text_bytes(batch.column(0))):
                for i, s in enumerate(shingle_sets(words(texts[a:b], lower=True))):
                    if len(s):
                        least[a + i] = [int(mix(s ^ seed).min() >> np.uint64(1)) for seed in seeds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in least.T)], ["text", "label", *marks])

    sample = rows.join(chosen, "doc_id").select("text", "label").mapInArrow(mark, "text string, label int, " + ", ".join(f"{m} long" for m in marks))
    sample = sample.groupBy("label", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"), *(F.min(m).alias(m) for m in marks))
    sample = written(sample, "toxicity-sample")
    pairs = [F.struct(F.lit(i * MIN_HASHES + j).alias("k"), F.col(marks[i]).alias("x"), F.col(marks[j]).alias("y")) for i in range(MIN_HASHES) for j in range(i)]
    keys = sample.select("label", "h", F.explode(F.array(*pairs)).alias("key"))
    beaten = keys.join(keys.groupBy("label", "key").agg(F.min("h").alias("least")), ["label", "key"]).where("least < h").select("label", "h").distinct()
    sample = written(sample.join(beaten, ["label", "h"], "left_anti").select("text", "label"), "toxicity-sample")
    size = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    positive, negative = size.get(1, 0), size.get(0, 0)
    if not positive or not negative:
        return Model({}, np.array([0.0] * 5 + [8.0 if positive else -8.0]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, rows, units = Counter(), (Counter(), Counter()), Units()
        for batch in batches:
            for (own, found), label in zip(units.of(text_bytes(batch.column(0))), batch.column(1).to_pylist(), strict=True):
                rows[label].update(found)
                if label:
                    whole.update(own)
        if names := list(rows[0] | rows[1]):
            numbers = ([x[u] for u in names] for x in (whole, rows[1], rows[0]))
            yield pa.RecordBatch.from_pydict({"unit": pa.array(names)} | {c: pa.array(x, pa.int64()) for c, x in zip(("whole", "pos", "neg"), numbers, strict=True)})

    units = sample.mapInArrow(count, "unit string, whole long, pos long, neg long").groupBy("unit").agg(*(F.sum(c).alias(c) for c in ("whole", "pos", "neg")))
    # Only units that qualify, or that may lengthen one that does, come to the driver.
    likely = units.where((F.col("pos") >= LEAST_ROWS * 0.8) & (F.col("pos") / positive >= 0.8 * LEAST_RATIO * (F.col("neg") + 0.25) / negative))
    terms = learn_terms([tuple(r) for r in likely.select("unit", "whole", "pos", "neg").collect()], positive, negative)

    guards = {t: terms[t] for t in guarded(terms)}

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, exact, verdicts, rows = Trie(guards), Lexicon(terms, frozenset()), {}, {}
        for batch in batches:
            for own, label in zip(word_sets(text_bytes(batch.column(0))), batch.column(1).to_pylist(), strict=True):
                for w in own:
                    if w not in verdicts:
                        verdicts[w] = not exact.match(w) and Lexicon._within_one(trie, w)
                    if verdicts[w]:
                        rows.setdefault(w, [0, 0])[label] += 1
        if rows:
            yield pa.RecordBatch.from_pydict({"word": list(rows), "pos": pa.array([n[1] for n in rows.values()], pa.int64()), "neg": pa.array([n[0] for n in rows.values()], pa.int64())})

    counted = sample.select("text", "label").mapInArrow(neighbours, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    near, clean = learn_near(terms, [tuple(r) for r in counted.where("neg > 0").collect()], positive, negative)
    model = Model(terms, np.zeros(6), near, clean)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, rows = model.matcher(), {}
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for a, w, found in matcher.hits(text_bytes(batch.column(0))):
                held: dict[int, set[tuple[int, int, int]]] = {}
                for at in np.flatnonzero(found).tolist():
                    (marks, near), own = beside(w, at), int(w.hash[at])
                    held.setdefault(a + int(w.doc[at]), set()).update({(own, 2, h) for h in near}, {(own, 0, 0)}, {(own, 1, 0)} if marks else ())
                for doc, keys in held.items():
                    for key in keys:
                        rows.setdefault(key, [0, 0])[labels[doc]] += 1
        if rows:
            numbers = np.array([(key[1], *n) for key, n in rows.items()], np.int64)
            hashes = np.array([(key[0], key[2]) for key in rows], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (hashes[:, 0], numbers[:, 0], hashes[:, 1], numbers[:, 1], numbers[:, 2])], ["hit", "kind", "hash", "neg", "pos"])

    seen = sample.select("text", "label").mapInArrow(windows, "hit long, kind long, hash long, neg long, pos long")
    seen = written(seen.groupBy("hit", "kind", "hash").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")), "toxicity-windows")
    # Words that only rows of one label hold say nothing on contexts.
    mixed = seen.where("kind = 0 and neg > 0 and pos > 0").select("hit", (F.col("neg") / (F.col("neg") + F.col("pos"))).alias("share"))
    around = seen.where("kind > 0").join(mixed, "hit").groupBy("kind", "hash")
    around = around.agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"), F.sum((F.col("neg") + F.col("pos")) * F.col("share")).alias("expected"))
    around = around.where((F.col("kind") == 1) | (F.col("neg") + F.col("pos") >= 2 * LEAST_ROWS)).collect()  # words of the sample's rows
    context = learn_context([(r.hash % (1 << 64) if r.kind == 2 else None, r.neg, r.pos, round(r.expected, 9)) for r in around])
    model = Model(terms, np.zeros(6), near, clean, context)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            x = matcher.features(text_bytes(batch.column(0)))
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c) for c in x.T)], ["label", *(f"x{i}" for i in range(5))])

    held = sample.select("text", "label").mapInArrow(measure, "label int, " + ", ".join(f"x{i} double" for i in range(5))).collect()
    x = np.array(sorted(tuple(r) for r in held), float)  # in one order, so that sums come out alike
    return Model(terms, fit_logistic(x[:, 1:], x[:, 0]), near, clean, context)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row; null and empty texts score as texts without hits."""
    small_batches(docs.sparkSession)
    weights = model.weights

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            x = matcher.features(text_bytes(batch.column(1)))
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(emit, "doc_id long, score double")


def held_out(column: str = "doc_id"):
    """Whether a row is kept from the fit: crc32 of its id as text is divisible by 5."""
    return F.crc32(F.col(column).cast("string")) % 5 == 0


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; the fit sees only labels of rows that aren't held out."""
    model = fit(docs, labels.where(~held_out()))
    found = score(docs, model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def below(docs: DataFrame, model: Model, limit: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, columns as they are, that score below the limit."""
    weights = model.weights

    def keep():
        matcher = model.matcher()
        return lambda texts: (1 / (1 + np.exp(-np.clip(matcher.features(texts) @ weights[:-1] + weights[-1], -30, 30))) < limit).tolist()

    return rows_where(docs, keep, text_col)
