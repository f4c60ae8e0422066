"""Word shingles and MinHash signatures as NumPy kernels over UTF-8 bytes.

A word is a run of bytes outside ``0x20`` and ``0x09-0x0D``; A-Z are lower-cased and nothing else is
changed.  A document's set holds its distinct shingles of ``width`` consecutive words; a document with
fewer words has its whole word sequence as its only shingle, one without words has the empty set.

Everything is computed block by block (``BLOCK`` bytes), so memory follows the block and the number of
distinct shingles, not the length of a text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BLOCK = 1 << 18
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    symbols = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    steps = mix64(np.arange(1, 65, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
    return symbols, steps


_ODD = _U(0x5851F42D4C957F2D)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i modulo 2**64 for positions inside a block."""
    n = BLOCK + (1 << 16)
    inverse = _U(pow(int(_ODD), -1, 1 << 64))
    up, down = np.full(n + 1, _ODD, dtype=np.uint64), np.full(n + 1, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def _hash_block(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of one block, in order, and where they start."""
    space = _is_space(raw)
    edge = np.diff(np.concatenate(([1], space.view(np.int8), [1])))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    symbols, _ = _tables()
    up, down = _powers()
    if len(raw) > len(up) - 1:  # one word longer than a block: its powers are made here
        n = len(raw)
        inverse = _U(pow(int(_ODD), -1, 1 << 64))
        up, down = np.full(n + 1, _ODD, dtype=np.uint64), np.full(n + 1, inverse, dtype=np.uint64)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(symbols[raw] * up[: len(raw)], out=total[1:])
    words = (total[ends] - total[starts]) * down[starts]
    return mix64(words + (ends - starts).astype(np.uint64) * _U(0x9E3779B97F4A7C15)), starts


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of all words of a text, lower-cased in A-Z; null gives none."""
    if not text:
        return np.empty(0, np.uint64)
    data = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    if len(data) <= BLOCK:
        return _hash_block(np.frombuffer(data, np.uint8))[0]
    raw, parts, at = np.frombuffer(data, np.uint8), [], 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        while end < len(raw):  # cut before a space only
            gaps = np.flatnonzero(_is_space(raw[end : end + 65536]))
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(len(raw), end + 65536)
        parts.append(_hash_block(raw[at:end])[0])
        at = end
    return np.concatenate(parts)


def combine(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words (the whole sequence if it is shorter), repeats kept."""
    if not len(words):
        return words
    _, steps = _tables()
    width_here = min(width, len(words)) if len(words) < width else width
    if width_here > len(steps):
        steps = mix64(np.arange(1, width_here + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
    n = len(words) - width_here + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(width_here):
        out += words[j : j + n] * steps[j]
    return mix64(out + _U(width_here))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    return np.unique(combine(word_hashes(text), width))


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """``shingle_set`` of several texts; short ones are hashed together."""
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    data, index, bounds, size = [], [], [0], 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if len(raw) > BLOCK // 2:
            out[i] = shingle_set(text, width)
        elif raw:
            data.append(raw)
            index.append(i)
            size += len(raw) + 1
            bounds.append(size)
        if data and (size > BLOCK // 2 or i == len(texts) - 1):
            _together(data, index, bounds, width, out)
            data, index, bounds, size = [], [], [0], 0
    if data:
        _together(data, index, bounds, width, out)
    return out


def _together(data: list[bytes], index: list[int], bounds: list[int], width: int, out: list[np.ndarray]) -> None:
    words, starts = _hash_block(np.frombuffer(b" ".join(data).translate(_LOWER) + b" ", np.uint8))
    cuts = np.searchsorted(starts, bounds)
    runs = combine(words, width) if len(words) >= width else words[:0]
    for k, i in enumerate(index):
        a, b = int(cuts[k]), int(cuts[k + 1])
        own = runs[a : b - width + 1] if b - a >= width else combine(words[a:b], width)
        if len(own) > 1:
            own = np.sort(own)
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        out[i] = own


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """Order-free 128-bit digest of a set, as two signed 64-bit integers."""
    if not len(shingles):
        return 0, 0
    a = mix64(shingles ^ _U(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    b = mix64(shingles + _U(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


@lru_cache(maxsize=4)
def _family(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 31, (count, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return odd, rng.integers(0, 1 << 32, (count, 1), dtype=np.uint32)


def signature(shingles: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """``count`` MinHash values (unsigned 32-bit) of a non-empty set, in slices of bounded size."""
    odd, shift = _family(count, seed)
    best = np.full(count, 0xFFFFFFFF, dtype=np.uint32)
    low = (shingles >> _U(17)).astype(np.uint32)
    step = 4096
    for at in range(0, len(low), step):
        part = (low[None, at : at + step] ^ shift) * odd
        part ^= part >> np.uint32(15)
        np.minimum(best, part.min(axis=1), out=best)
    return best


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Intersection size of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
