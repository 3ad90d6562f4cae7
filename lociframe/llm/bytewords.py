"""NumPy kernels over the UTF-8 bytes of many texts at once: normal form, word bounds, hashes of words and shingles."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BREAK, SPACE = 10, 32
_FOLD = np.full(256, SPACE, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_FOLD_BYTES = _FOLD.tobytes()

_RNG = np.random.default_rng(20240229)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _RNG.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the n + 1 bounds between them; a null is an empty text."""
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


@dataclass
class Words:
    """`stream`: lower-cased words with one space behind each, a BREAK in front of and behind each text, eight zero
    bytes at the end. `start`, `end`: bounds of each word in it. `first`: number of the first word of each text, and
    the total."""

    stream: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def text_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, words, side="right") - 1


def normalise(text: str) -> bytes:
    """The stream form of one text without breaks: words with single spaces between them."""
    return b" ".join(text.encode().translate(_FOLD_BYTES).split())


def words_of(texts: pa.Array) -> Words:
    """Words are runs of digits, a-z (A-Z folded) and all that is not ASCII."""
    data, bounds = raw_bytes(texts)
    n = len(bounds) - 1
    whole = np.full(len(data) + n + 1, BREAK, np.uint8)
    place = np.ones(len(whole), bool)
    place[bounds + np.arange(n + 1)] = False
    whole[place] = _FOLD[data]
    word = (whole != SPACE) & (whole != BREAK)
    behind = np.zeros(len(whole), bool)
    behind[1:] = word[:-1]
    stream = whole[word | (whole == BREAK) | behind]
    word = (stream != SPACE) & (stream != BREAK)
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.searchsorted(start, np.flatnonzero(stream == BREAK))
    return Words(np.concatenate([stream, np.zeros(8, np.uint8)]), start, end, first)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 23:  # a longer one serves one long text and is not held
            _powers[name] = have
    return have


def word_hashes(w: Words) -> np.ndarray:
    """64 bits for each word, from running sums of byte values times powers; equal words have equal hashes."""
    n = len(w.stream)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[w.stream] * _power("up", _BASE, n)[:n], out=total[1:])
    return mixed((total[w.end] - total[w.start]) * _power("down", _INVERSE, n)[w.start] + (w.end - w.start).astype(np.uint64))


def shingle_hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words inside a text, and the number of the first word of each."""
    hashes = word_hashes(w)
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = np.repeat(w.first[1:], np.diff(w.first))  # end of the text that each word is in
    at = np.flatnonzero(np.arange(n) + size <= last[:n])
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * _PLACE[k]
    return mixed(total[at]), at


def words_at(w: Words, a: int, b: int) -> list[bytes]:
    """Words a to b - 1, which must lie in one text."""
    return w.stream[w.start[a] : w.end[b - 1]].tobytes().split() if b > a else []
