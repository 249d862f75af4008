"""Vectorised hashes of words and word windows.

A word is read in blocks of 8 bytes; each of two 64-bit lanes mixes one block after the other into its state, which
is no polynomial, so words that repeat a pattern don't cancel out. Words of up to 8 bytes have equal hashes in no case,
since mixing is bijective. Words of a whole batch are hashed with a handful of numpy calls; no Python object is made per
word, but for the few words beyond LONG bytes, which get a keyed digest.

Windows have two hashes as well: Rabin-Karp modulo the prime 2**61 - 1 over the first lane, and a mixed one over the
second. Both together tell windows apart (125 bits); where one is used alone, that is said there.
"""

from __future__ import annotations

import hashlib
import unicodedata
from dataclasses import dataclass, replace

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 20
_MASK = (1 << 64) - 1
#: Bytes from which on a word is hashed by a digest.
LONG = 256
#: Starting states and multipliers of the two lanes.
_LANES = ((np.uint64(0x243F6A8885A308D3), np.uint64(0x9E3779B97F4A7C15)), (np.uint64(0x13198A2E03707344), np.uint64(0xC2B2AE3D27D4EB4F)))
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PLAIN = np.ones(256, bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    _PLAIN[_c] = False
_PLAIN[0x80:] = False
_marks: list[np.ndarray] = []


def _mark_table() -> np.ndarray:
    """For each code point past ASCII whether it is punctuation, a symbol, a space or a control character."""
    if not _marks:
        kinds = (unicodedata.category(chr(c)) for c in range(0x80, 0x110000))
        _marks.append(np.concatenate((np.zeros(0x80, bool), np.fromiter((k[0] in "PSZ" or k == "Cc" for k in kinds), bool, 0x110000 - 0x80))))
        _marks[0][[0x200B, 0xFEFF]] = True  # spaces without width
    return _marks[0]


def _add_marks(space: np.ndarray, raw: np.ndarray) -> None:
    """Marks all bytes of such characters in `raw`, which is UTF-8, as separators."""
    lead = np.flatnonzero(raw >= 0xC2)
    if not len(lead):
        return
    b = np.concatenate((raw, np.zeros(3, np.uint8))).astype(np.int32)
    first, low = b[lead], [b[lead + k] & 0x3F for k in (1, 2, 3)]
    two = (first & 0x1F) << 6 | low[0]
    three = (first & 0x0F) << 12 | low[0] << 6 | low[1]
    four = (first & 0x07) << 18 | low[0] << 12 | low[1] << 6 | low[2]
    code = np.where(first < 0xE0, two, np.where(first < 0xF0, three, np.minimum(four, 0x10FFFF)))
    found = _mark_table()[code]
    lead, size = lead[found], 2 + (first[found] >= 0xE0) + (first[found] >= 0xF0)
    for k in range(4):
        at = lead[size > k] + k
        space[at[at < len(space)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _spans(space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    return edges[::2], edges[1::2]


def _word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both lanes' hashes of the words raw[start:end]. raw has 8 bytes more than the words."""
    size = end - start
    blocks = np.ndarray((len(raw) - 7,), "<u8", raw.data, 0, (1,))
    lanes = [np.full(len(start), seed, np.uint64) ^ size.astype(np.uint64) * times for seed, times in _LANES]
    todo, at, left = None, start, size  # words that go on, where, and how many bytes
    while len(at):
        block = blocks[at] & _KEEP[np.minimum(left, 8)]
        for k, (_, times) in enumerate(_LANES):
            own = lanes[k] if todo is None else lanes[k][todo]
            own = mix(own ^ block * times)
            if todo is None:
                lanes[k] = own
            else:
                lanes[k][todo] = own
        on = np.flatnonzero((left > 8) & (left <= LONG) if todo is None else left > 8)
        todo, at, left = (on if todo is None else todo[on]), at[on] + 8, left[on] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        both = np.frombuffer(hashlib.blake2b(raw[start[i] : end[i]], digest_size=16, key=b"words").digest(), "<u8")
        lanes[0][i], lanes[1][i] = both
    return lanes[0], lanes[1]


@dataclass
class Words:
    """Words of several texts: `doc` the text's index, `hash` and `hash2`, and byte positions in the joined buffer."""

    doc: np.ndarray
    hash: np.ndarray
    hash2: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # first word of each text, and one past the last word
    offset: np.ndarray  # where each text starts in the joined buffer
    buffer: bytes

    def second(self) -> Words:
        """The same words by their second hash."""
        return replace(self, hash=self.hash2, hash2=self.hash)


def words(texts: list[bytes | None], lower: bool = False, plain: bool = False, marks: bool = False) -> Words:
    """Words of the texts (null: none). plain: letters and digits only, all other ASCII bytes separate. marks: so do
    punctuation, symbols and spaces past ASCII (the texts are UTF-8)."""
    texts = [t or b"" for t in texts]
    buffer = b"\n".join(texts)
    if lower:
        buffer = buffer.lower()
    raw, padded = np.frombuffer(buffer, np.uint8), np.frombuffer(buffer + bytes(8), np.uint8)
    separates = _PLAIN if plain else _SPACE
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offset = np.concatenate(([0], np.cumsum(sizes + 1)))[: len(texts)]
    starts, ends = [], []
    at = 0
    while at < len(raw):
        to = min(len(raw), at + _PIECE)
        while to < len(raw):  # a piece ends at a separator
            gaps = np.flatnonzero(separates[raw[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
                break
            to = min(len(raw), at + 2 * (to - at))
        piece = raw[at:to]
        space = separates[piece]
        if marks:
            _add_marks(space, piece)
        s, e = _spans(space)
        if len(s):
            starts.append(s + at)
            ends.append(e + at)
        at = to
    none = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else none
    end = np.concatenate(ends) if ends else none
    value, second = _word_hashes(padded, start, end)
    first = np.searchsorted(start, np.append(offset, len(raw) + 1))
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(doc, value, second, start, end, first, offset, buffer)


_PRIME = np.uint64((1 << 61) - 1)
#: Windows that are hashed at once: bounds the tables of powers.
_RUN = 1 << 15


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1, for any unsigned 64-bit x."""
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, of numbers below it."""
    low, half = np.uint64((1 << 31) - 1), np.uint64(31)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    middle = ah * bl + al * bh
    x = ((ah * bh) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half)
    return _fold(_fold(x) + _fold(al * bl))


_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of the base modulo 2**61 - 1; kept for the next call."""
    held = _tables.get(base, np.ones(1, np.uint64))
    while len(held) < n:
        held = np.concatenate((held, _times(held, np.full(len(held), pow(base, len(held), int(_PRIME)), np.uint64))))
    _tables[base] = held
    return held[:n]


def window_hashes(value: np.ndarray, size: int, seed: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """Rabin-Karp hash of each run of `size` word hashes, one for each start; runs may cross texts."""
    n = len(value) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size <= 8:
        out = np.zeros(n, np.uint64)
        for j in range(size):
            out += value[j : j + n] * np.uint64(pow(seed | 1, j + 1, 1 << 64))
        return mix(out)
    base, step = seed % int(_PRIME), max(_RUN, 4 * size)
    return np.concatenate([_rabin_karp(value[at : at + step + size - 1], size, base) for at in range(0, n, step)])


def _rabin_karp(value: np.ndarray, size: int, base: int) -> np.ndarray:
    n = len(value) - size + 1
    terms = _times(_fold(value), _powers(base, len(value)))
    total = []  # running sums of the terms' halves, which stay below 2**64
    for half in (terms & np.uint64((1 << 31) - 1), terms >> np.uint64(31)):
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(half, dtype=np.uint64)))
        total.append(_fold(run[size:] - run[:n]))
    held = _fold(total[0] + _times(total[1], np.full(n, 1 << 31, np.uint64)))
    return mix(_times(held, _powers(pow(base, -1, int(_PRIME)), n)))


def mixed_windows(value: np.ndarray, size: int) -> np.ndarray:
    """A second hash of each run of `size` word hashes, which joins shorter runs' hashes and mixes them."""
    n = len(value) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, covered, held, span = None, 0, value, 1  # `held` are hashes of runs of `span`, `done` of runs of `covered`
    while True:
        if size & span:
            done = held[:n] if done is None else mix(done * np.uint64(_BASE) + held[covered : covered + n])
            covered += span
        if 2 * span > size:
            return done
        held, span = mix(held[:-span] * np.uint64(_BASE) + held[span:]), 2 * span


def shingle_sets(w: Words, size: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; fewer words than `size` make one shingle, no words none."""
    runs, out = window_hashes(w.hash, size), []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(short_shingle(w.hash[a:b]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def short_shingle(value: np.ndarray) -> np.ndarray:
    """The one shingle of a text with fewer words than a shingle has."""
    acc = len(value)
    for x in value.tolist():
        acc = (acc * _BASE + x) & _MASK
    return mix(np.array([acc], np.uint64))
