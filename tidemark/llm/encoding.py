"""Token ids of whole texts by the tokenizers library, with a bounded cache of words."""

from __future__ import annotations

import json
import os
from array import array
from collections import ChainMap
from unicodedata import is_normalized

import numpy as np

from .common import chunked

WORD_BPE = "word_bpe_49k.json"


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones are themselves, others follow 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


def tokenizer_path(name: str = WORD_BPE) -> str:
    """Where the box keeps a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes texts with a tokenizer whose pieces never cross white space.

    That holds for a vocabulary that splits on white space before anything else and whose normaliser works on each
    word alone, as word_bpe_49k.json. Every word that isn't in the cache goes through the library itself; the cache is
    emptied when `cache_words` are held, so that a worker's memory stays bounded.
    """

    LONGEST = 64  # bytes of a word that is kept
    SHORT = 7  # bytes up to which a word outlives an emptying: most frequent words are short
    SLICE = 200_000  # words of one text that are looked up at once
    CHUNK = 1_000_000  # bytes of texts that are split at once
    JOINED = 2_000  # words that the library gets in one call

    def __init__(self, path: str, cache_words: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = {}
        self.most = cache_words
        spec = json.loads(self.tokenizer.to_str())
        self.model = self.tokenizer.model if self._plain_words(spec) else None
        self.letters = dict(enumerate(byte_letters()))
        added = self.tokenizer.get_added_tokens_decoder()
        self.between, self.mark = next(((t.content, i) for i, t in added.items() if t.special and not t.lstrip and not t.rstrip), ("", -1))

    @staticmethod
    def _plain_words(spec: dict) -> bool:
        """Whether a word of composed, lower-case letters is one piece that reaches the model as its bytes' letters."""
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        split, last = before[0], before[-1]
        letters = split.get("type") == "Split" and r"[\p{L}]+" in split["pattern"].get("Regex", "") and split["behavior"] == "Removed" and split["invert"]
        return bool(normal == ["NFC", "Replace", "Lowercase"] and letters and len(before) == 2 and last.get("type") == "ByteLevel" and not last["add_prefix_space"] and not last["use_regex"])

    def _ask(self, wanted: list[bytes]) -> list[bytes]:
        """The library's ids of each word.

        Words of composed, lower-case Latin, Greek or Cyrillic letters go to its model at once, as its normaliser and
        splitter would pass them on unchanged. Others go through all of it, in one text with a special token between.
        """
        texts = [w.decode("utf-8") for w in wanted]
        out: list[bytes] = [b""] * len(texts)
        rest = range(len(texts))
        if self.model is not None:
            rest, tokenize, letters = [], self.model.tokenize, self.letters
            for i, (w, t) in enumerate(zip(wanted, texts, strict=True)):
                if t.isalpha() and (t.isascii() or max(t) < "\u0500" and is_normalized("NFC", t)) and t == t.lower():
                    out[i] = array("I", [x.id for x in tokenize(w.decode("latin-1").translate(letters))]).tobytes()
                else:
                    rest.append(i)
        plain = [i for i in rest if self.between and "<" not in texts[i]]
        for k in range(0, len(plain), self.JOINED):
            some = plain[k : k + self.JOINED]
            [found] = self.tokenizer.encode_batch_fast([self.between.join([texts[i] for i in some])], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            cuts = np.concatenate(([-1], np.flatnonzero(ids == self.mark), [len(ids)]))
            held = ids.tobytes()
            for i, a, b in zip(some, (4 * cuts[:-1] + 4).tolist(), (4 * cuts[1:]).tolist(), strict=True):
                out[i] = held[a:b]
        if other := sorted(set(rest).difference(plain)):
            for i, e in zip(other, self.tokenizer.encode_batch_fast([texts[i] for i in other], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def _learn(self, wanted: set[bytes]) -> ChainMap | dict[bytes, bytes]:
        """A table that holds all of `wanted`."""
        cache = self.cache
        new = wanted.difference(cache)
        if new and len(cache) + len(new) > self.most:
            kept = {w: x for w, x in cache.items() if len(w) <= self.SHORT}
            cache.clear()
            if len(kept) < self.most // 2:
                cache.update(kept)
            new = wanted.difference(cache)
        if not new:
            return cache
        new = sorted(new)
        found = self._ask(new)
        if max(map(len, new)) <= self.LONGEST:
            cache.update(zip(new, found, strict=True))
            return cache
        extra = {}
        for w, ids in zip(new, found, strict=True):
            (cache if len(w) <= self.LONGEST else extra)[w] = ids
        return ChainMap(cache, extra)

    def _split(self, texts: list[bytes]) -> list[list[bytes]]:
        """Words of each text, with a sign after a letter as a word of its own and ASCII letters lower-cased.

        Neither changes any id: a piece never joins letters with . , ; : ! ? and the normaliser lower-cases anyway.
        Texts with combining marks (which compose before they are lower-cased) or special tokens keep their case.
        """
        held = [t if b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.lower() for t in texts]
        raw = np.frombuffer(b"\n\xff\n".join(held), np.uint8)
        signs = np.flatnonzero(_SIGN[raw])
        signs = signs[signs >= 2]
        before, lead = raw[signs - 1], raw[signs - 2]
        after = _LETTER[before] | ((lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))
        return [t.split() for t in np.insert(raw, signs[after], 0x20).tobytes().split(b"\xff")]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers (null: none)."""
        out: list[bytes] = []
        for a, b in chunked(texts, self.CHUNK):
            split = self._split([t or b"" for t in texts[a:b]])
            if b - a > 1 or len(split[0]) <= self.SLICE:
                get = self._learn(set().union(*split)).__getitem__
                out += [b"".join(map(get, w)) for w in split]
            else:  # one very long text
                parts = []
                for k in range(0, len(split[0]), self.SLICE):
                    part = split[0][k : k + self.SLICE]
                    parts.append(b"".join(map(self._learn(set(part)).__getitem__, part)))
                out.append(b"".join(parts))
        return out


_SIGN, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_SIGN[list(b".,;:!?")] = True
_LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, cache_words: int = 1_000_000) -> WordEncoder:
    """The worker's encoder for a vocabulary file; its cache lives as long as the worker."""
    if (path, cache_words) not in _encoders:
        _encoders[path, cache_words] = WordEncoder(path, cache_words)
    return _encoders[path, cache_words]
