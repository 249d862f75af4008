"""Substring removal, n-gram join, decontamination."""

import hashlib
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import components, decontaminate, hashing, ngram_join, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_hashes_tell_words_apart():
    texts = ["a b  ab\tba\n", "", " ", "ab a", "x" * 5000, None]
    w = hashing.words([t if t is None else t.encode() for t in texts])
    assert np.diff(w.first).tolist() == [4, 0, 0, 2, 1, 0] and len(set(w.hash.tolist())) == 5
    assert w.hash[2] == w.hash[4] and w.hash[0] == w.hash[5]
    rng = random.Random(1)
    long = " ".join(rng.choice("ab") * rng.randint(1, 9) for _ in range(400_000)).encode()
    spelled = long.split()
    h = hashing.words([long]).hash.tolist()
    assert len(h) == len(spelled) and len(set(zip(h, spelled, strict=True))) == len(set(h)) == len(set(spelled))


@pytest.mark.parametrize("size", [1, 2, 7, 12, 50, 64])
def test_windows_are_equal_where_words_are(size):
    rng = random.Random(2)
    words = [rng.choice("abc") for _ in range(500)]
    words += words[100:300]
    w = hashing.words([" ".join(words).encode()])
    for h in (hashing.window_hashes(w.hash, size), hashing.mixed_windows(w.hash2, size)):
        seen = {}
        for i, x in enumerate(h.tolist()):
            assert seen.setdefault(x, tuple(words[i : i + size])) == tuple(words[i : i + size])
        assert len(h) == 701 - size and len(seen) == len({tuple(words[i : i + size]) for i in range(701 - size)})


def test_rabin_karp_is_modulo_a_prime(monkeypatch):
    monkeypatch.setattr(hashing, "_RUN", 64)  # several runs
    value = hashing.mix(np.arange(1000, dtype=np.uint64))
    p = (1 << 61) - 1
    base = 0x5851F42D4C957F2D % p
    want = [sum(int(value[i + j]) * pow(base, j, p) for j in range(50)) % p for i in range(951)]
    assert (hashing.window_hashes(value, 50) == hashing.mix(np.array(want, np.uint64))).all()


def _morse(n, a="a", b="b"):
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))


def test_words_that_repeat_a_pattern_differ(spark, documents):
    """Thue-Morse words have equal polynomial hashes modulo powers of two, whatever the base."""
    words = [_morse(n, *ab) for n in (8, 9, 255, 256, 257, 512, 1024, 2048, 4096) for ab in ("ab", "ba")]
    w = hashing.words([" ".join(words).encode()])
    assert len(set(w.hash.tolist())) == len(set(w.hash2.tolist())) == len(words)
    rng = random.Random(8)
    text = [f"w{rng.randint(0, 999)}" for _ in range(30)]
    rows = [(k, " ".join([*text, x, *text])) for k, x in enumerate(words)] + [(100 + k, x) for k, x in enumerate(words)] + [(200, " ".join([*text, words[-1], *text]))]
    rows += [(300 + k, " ".join(_morse(4096, *ab))) for k, ab in enumerate(("ab", "ba"))]
    got = substring.remove_repeats(documents(rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got) == _plain_removal(rows, 50)
    assert {r.doc_id for r in got if r.n_removed and r.doc_id < 300} == {200}
    got = ngram_join.ngram_components(documents(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == _plain_groups(rows)
    items = [(k, x) for k, x in enumerate(words)]
    found = decontaminate.contained_items(documents(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {tuple(r)[:4] for r in found} == _plain_contained(rows, items)


def _plain_removal(rows, size):
    owned = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - size + 1):
                key = tuple(w[k : k + size])
                owned[key] = min(i, owned.get(key, i))
    out = Counter()
    for i, w in split:
        if i is None:
            continue
        gone = {k + j for k in range(len(w) - size + 1) if owned[tuple(w[k : k + size])] < i for j in range(size)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("size", [50, 7])
def test_substrings(spark, documents, corpus, size):
    rows = substring.remove_repeats(documents(corpus), size).collect()
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in rows)
    assert got == _plain_removal(corpus, size)
    for r in rows:
        assert sum(s.end - s.first for s in r.removed) == r.n_removed and all(a.end < b.first for a, b in zip(r.removed, r.removed[1:], strict=False))
    assert substring.remove_repeats(documents([])).count() == 0


def _tokens(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _plain_groups(rows):
    nodes = [(i, _tokens(t)) for i, t in rows if i is not None]
    group = list(range(len(nodes)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(nodes)):
        for b in range(a):
            x, y = nodes[a][1], nodes[b][1]
            if x and y and (nodes[a][0] == nodes[b][0] or 100 * len(x & y) >= 75 * len(x | y)):
                group[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(nodes):
        least[top(k)] = min(i, least.get(top(k), i))
    return Counter((i, len(s), least[top(k)]) for k, (i, s) in enumerate(nodes))


def test_groups(spark, documents, corpus):
    rows = ngram_join.ngram_components(documents(corpus)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == _plain_groups(corpus)
    assert ngram_join.ngram_components(documents([])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_groups_of_chains(spark, documents, seed, monkeypatch):
    """Copies of copies: links that only some members have, near the threshold, and frequent passages."""
    if seed % 2:  # lists in parts, and pairs once for several lists
        monkeypatch.setattr(ngram_join, "LIST_ROWS", 4)
        monkeypatch.setattr(ngram_join, "LONG_LIST", 3)
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    rows, common = [], [word() for _ in range(30)]
    for _ in range(6):
        text = [word() for _ in range(rng.randint(30, 90))] + common
        for _ in range(14):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = word()
    rng.shuffle(rows)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(documents(rows)).collect())
    assert got == _plain_groups(rows)


def test_one_of_each_group_stays(spark, documents, corpus):
    docs = documents(corpus)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {top for _, _, top in _plain_groups(corpus)}
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(want)
    assert kept.where("doc_id is null").count() == 2


def test_orders_are_intersected_before_texts_move():
    """Sets that share few tokens meet under one order now and then, hardly under all."""
    rng = np.random.default_rng(5)
    one = both = 0
    for _ in range(300):
        x, y = (np.unique(hashing.mix(rng.integers(0, 2**63, 100).astype(np.uint64))) for _ in range(2))
        y[:12] = x[:12]
        y = np.unique(y)
        sketches = [ngram_join.sketch(s, 75) for s in (x, y)]
        half = [s[: len(s) // 2] for s in sketches]
        one += bool(np.isin(*(np.frombuffer(h, "<u2") for h in half)).any())
        both += ngram_join.prefixes_meet(sketches[0], len(x), sketches[1], len(y), 75)
    assert 0 < both < one < 300


def test_a_list_of_many_members(spark, documents):
    """A passage that 6,000 documents share, of which few are similar: every link is found and none made up."""
    rng = random.Random(21)
    passage = [f"p{k}" for k in range(30)]
    rows = [(k, " ".join([*passage, *(f"o{k}x{j}" for j in range(rng.choice([5, 6, 7, 30])))])) for k in range(6_000)]
    rows += [(30_000 + k, rows[k][1] + " more") for k in range(0, 200, 20)]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(documents(rows)).collect()}
    shingles = lambda n: 30 + n - 4
    size = {k: len(t.split()) - 30 for k, t in rows}
    # 26 shared shingles of 31 and 31 (5 own words) are 72 %; so only the copies link.
    assert all(100 * 26 < 75 * (shingles(a) + shingles(b) - 26) for a in (5, 6, 7, 30) for b in (5, 6, 7, 30))
    assert got == {k: k - 30_000 if k >= 30_000 else k for k, _ in rows} and max(size.values()) == 31


def test_signatures_never_exclude_similar_sets():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n, m = rng.integers(1, 800, 2)
        pool = hashing.mix(rng.integers(0, 2**63, n + m).astype(np.uint64))
        x, y = np.unique(rng.choice(pool, n)), np.unique(rng.choice(pool, m))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 50 * (len(x) + len(y) - both):
            assert ngram_join.prefixes_meet(ngram_join.sketch(x, 50), len(x), ngram_join.sketch(y, 50), len(y), 50)
            assert ngram_join.may_be_similar(ngram_join.signature(x), len(x), ngram_join.signature(y), len(y), 50)
        assert ngram_join.similar(x, y, 50) == (100 * both >= 50 * (len(x) + len(y) - both))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def _plain_contained(docs, items):
    spell = lambda t: "".join(" " if unicodedata.category(c)[0] in "PSZ" or unicodedata.category(c) == "Cc" or c in "\u200b\ufeff" else c for c in (t or "").lower()).split(" ")
    spell = lambda t, each=spell: [w for w in each(t) if w]
    out = set()
    for j, item in items:
        w = spell(item)
        n = min(5, len(w))
        s = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for i, t in docs:
            d = spell(t)
            held = s & {tuple(d[k : k + n]) for k in range(len(d) - n + 1)}
            if s and i is not None and j is not None and 100 * len(held) >= 75 * len(s):
                out.add((i, j, len(s), len(held)))
    return out


def test_contained_items(spark, documents, corpus):
    rng = random.Random(9)
    items = []
    for j in range(30):
        words = (rng.choice(corpus[:50])[1]).split()
        at = rng.randrange(len(words))
        some = words[at : at + rng.randint(1, 40)]
        if j % 3 == 0:
            some[rng.randrange(len(some))] = "changed"
        items.append((j, ", ".join(some).upper()))
    items += [(40, None), (41, ""), (42, "..."), (None, "no id at all"), (43, "one two"), (7, items[7][1]), (44, corpus[65][1] if corpus[65][1] else "x")]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(corpus)
    got = Counter(tuple(r)[:4] for r in decontaminate.contained_items(docs, table).collect())
    assert set(got) == _plain_contained(corpus, items)
    clean = decontaminate.without_items(docs, table)
    hit = {i for i, *_ in got}
    assert clean.columns == docs.columns
    texts = {t for i, t in corpus if i in hit}
    assert Counter(r.doc_id for r in clean.collect() if r.doc_id is not None) == Counter(i for i, t in corpus if i is not None and (i not in hit or not _plain_contained([(i, t)], items)))
    assert texts and decontaminate.contained_items(docs, table.limit(0)).count() == 0 and decontaminate.contained_items(documents([]), table).count() == 0


def test_retyped_marks_hide_no_item(spark, documents):
    rng = random.Random(4)
    words = [f"w{rng.randint(0, 500)}é" for _ in range(40)]
    item = ", ".join(words)
    texts = ["“" + "”—“".join(words) + "”", "\u00a0«".join(words), "…".join(words[:31]), "…".join(words[:29]), "。".join(words)]
    got = {tuple(r)[:4] for r in decontaminate.contained_items(documents(list(enumerate(texts))), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == _plain_contained(list(enumerate(texts)), [(1, item)]) and {d for d, *_ in got} == {0, 1, 2, 4}


@pytest.mark.parametrize("seed", range(3))
def test_items_of_every_size_at_the_threshold(spark, documents, seed):
    """Items of 1 to 300 words, of which texts hold about three quarters, in several pieces."""
    rng = random.Random(seed)
    items, rows = [], []
    for j in range(60):
        words = [f"v{rng.randint(0, 5000)}" for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 17, 40, 130, 300]))]
        items.append((j, " ".join(words)))
        for _ in range(3):
            some = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 15))):
                some[rng.randrange(len(some))] = "other"
            rows.append((len(rows), " ".join([f"x{rng.randint(0, 99)}" for _ in range(rng.randint(0, 30))] + some * rng.randint(1, 2))))
    got = {tuple(r)[:4] for r in decontaminate.contained_items(documents(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = _plain_contained(rows, items)
    assert got == want and len(want) > 20


def test_items_beyond_one_block(spark, documents, corpus, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 10)
    items = [(j, corpus[j][1]) for j in range(8)]
    got = {tuple(r)[:4] for r in decontaminate.contained_items(documents(corpus), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == _plain_contained(corpus, items)
