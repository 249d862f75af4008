"""Token files, counts and packing."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing, token_counts, token_ids
from tidemark.llm.encoding import WordEncoder, tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def _ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.integers(0, 2**32 - 1), max_size=3000), st.data())
@settings(max_examples=40, deadline=None)
def test_segments_give_every_token_back(ids, data):
    s = token_ids.Segment(token_ids.encode_segment(np.array(ids, np.uint32)))
    assert s.slice(0, len(ids)).tolist() == ids == [int(x) for x in s.slice(-5, len(ids) + 5)]
    if ids:
        i = data.draw(st.integers(0, len(ids) - 1))
        j = data.draw(st.integers(i, len(ids)))
        assert s.get(i) == ids[i] and s.slice(i, j).tolist() == ids[i:j]


def test_many_blocks():
    ids = np.random.default_rng(1).integers(0, 49_408, 20_000)
    s = token_ids.Segment(token_ids.encode_segment(ids))
    assert [s.get(i) for i in range(0, 20_000, 37)] == ids[::37].tolist()
    with pytest.raises(ValueError):
        token_ids.Segment(b"????")
    with pytest.raises(IndexError):
        s.get(20_000)


@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60) | st.text(alphabet="abIS'.,<|>endoftext \t́éİ ", max_size=40) | st.text(alphabet="abcéßœžǆάςσωжяІŉſK", max_size=12))
@settings(max_examples=300, deadline=None)
def test_words_encode_as_whole_texts_do(text):
    enc = test_words_encode_as_whole_texts_do.__dict__.setdefault("enc", WordEncoder(tokenizer_path(), cache_words=50))
    assert np.frombuffer(enc.encode([text.encode("utf-8", "replace")])[0], "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files(spark, documents, corpus, library):
    docs = documents(corpus)
    got = sorted((tuple(r) for r in token_ids.addressable_tokens(docs, tokenizer_path()).collect()), key=lambda r: r[1])
    assert Counter(r[0] for r in got) == Counter(i for i, _ in corpus)
    want = Counter()
    for i, text in corpus:
        ids = _ids(library, text) + [2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((i, n, c) for i, _, n, c in got) == want
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()
    assert [r[0] if r[0] is not None else -1 for r in got] == sorted(i if i is not None else -1 for i, _ in corpus)


def test_token_files_of_an_empty_table(spark, documents, tmp_path):
    assert token_ids.addressable_tokens(documents([]), tokenizer_path()).count() == 0
    segments = token_ids.write_token_files(documents([(1, "a b"), (2, "c")]), str(tmp_path / "x"), tokenizer_path())
    n = token_ids.export_files(segments, str(tmp_path / "files"))
    files = sorted((tmp_path / "files").iterdir())
    assert len(files) == n and sum(len(token_ids.Segment(f.read_bytes())) for f in files) == 5


def _plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if capacity - sum(b) >= n]
        if fits:
            min(fits, key=lambda b: capacity - sum(b)).append(n)
        else:
            bins.append([n])
    return Counter(sum(b) for b in bins)  # which of two equally full bins takes a piece is open


@given(st.lists(st.integers(1, 40), max_size=120), st.sampled_from([40, 64, 97]))
@settings(max_examples=150, deadline=None)
def test_packing_equals_one_by_one(lengths, capacity):
    runs, n = packing.best_fit_decreasing(dict(Counter(lengths)), capacity)
    bins, placed = {}, Counter()
    for length, rank, pieces, first, each, at in runs:
        assert rank == placed[length]
        placed[length] += pieces
        for k in range(pieces):
            bins.setdefault(first + k // each, []).append((at + k % each * length, length))
    for b in bins.values():
        ends = 0
        for at, length in sorted(b):
            assert at == ends
            ends += length
        assert ends <= capacity
    assert placed == Counter(lengths) and sorted(bins) == list(range(n))
    assert Counter(sum(x for _, x in b) for b in bins.values()) == _plain_best_fit(lengths, capacity)


def test_lengths_out_of_range():
    with pytest.raises(ValueError):
        packing.best_fit_decreasing({0: 1}, 8)


def test_pack(spark, documents, corpus, library):
    rows = [tuple(r) for r in packing.pack_documents(documents(corpus), tokenizer_path()).collect()]
    want = Counter()
    for i, text in corpus:
        ids = _ids(library, text) + [0]
        for k in range(0, len(ids), 2048):
            some = ids[k : k + 2048]
            want[i, k // 2048, k, len(some), zlib.crc32(np.array(some, "<u4").tobytes())] += 1
    assert Counter(r[:5] for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r[5], []).append((r[6], r[3]))
    for pieces in by.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(pieces), sorted(pieces)[1:], strict=False)) and min(pieces)[0] == 0 and sum(n for _, n in pieces) <= 2048
    assert len(by) == sum(_plain_best_fit([r[3] for r in rows], 2048).values())
    assert packing.pack_documents(documents([]), tokenizer_path()).count() == 0


def _greedy(vocabulary, word):
    n, i = 0, 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in vocabulary), None)
        if j is None:
            return 1
        n, i = n + 1, j
    return n


@given(st.sets(st.text("abc", min_size=1, max_size=4), max_size=12), st.lists(st.text("abc", min_size=1, max_size=15), max_size=12))
@settings(max_examples=200, deadline=None)
def test_counts_equal_restarting_at_every_piece(vocabulary, words):
    machine = token_counts.LongestMatch(tuple(v) for v in vocabulary)
    assert [machine.count(w) for w in words] == [_greedy(vocabulary, w) for w in words]


def test_counts(spark, documents, corpus):
    counter = token_counts.PieceCounter(tokenizer_path())
    vocabulary = {(*p.removesuffix("</w>"), "</w>") if p.endswith("</w>") else tuple(p) for p in counter_vocabulary()}
    want = Counter()
    for i, text in corpus:
        words = counter.words(text or "")
        spelled = [(*(counter.letters[b] for b in w.encode()), "</w>") for w in words]
        want[i, len(words), sum(_greedy(vocabulary, w) for w in spelled)] += 1
    assert Counter(tuple(r) for r in token_counts.piece_counts(documents(corpus), tokenizer_path()).collect()) == want


def counter_vocabulary():
    import json

    with open(tokenizer_path(), encoding="utf-8") as f:
        return json.load(f)["model"]["vocab"]
