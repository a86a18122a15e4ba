"""Hashes of words and word n-grams of many texts at once, on the bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; a longer text is cut at white space.
AT_ONCE = 1 << 18
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Odd multipliers for the positions in an n-gram.
_POSITIONS = [U64(pow(0xD1342543DE82EF95, k + 1, 1 << 64)) for k in range(16)]

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Kinds of bytes for the shape of a word: letters by case (bytes beyond ASCII are letters), digits, others as they are.
KIND = np.arange(256, dtype=np.uint8)
KIND[65:91], KIND[97:123], KIND[128:], KIND[48:58] = 65, 97, 97, 48


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that makes all bits depend on all bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, AT_ONCE + 1), base, U64)
        known[0] = 1
        _powers[base] = known = np.cumprod(known, dtype=U64)
    return known[:n]


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], polynomials over random values of the bytes."""
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_VALUE[data] * _power(_BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(U64))


def _cut_at_space(data: np.ndarray) -> Iterator[np.ndarray]:
    while len(data) > AT_ONCE:
        space = np.flatnonzero(SPACE[data[:AT_ONCE]])
        if not len(space):
            space = AT_ONCE + np.flatnonzero(SPACE[data[AT_ONCE:]])[:1]
        stop = int(space[-1]) + 1 if len(space) else len(data)
        yield data[:stop]
        data = data[stop:]
    yield data


def _words(data: np.ndarray, bounds: np.ndarray, shapes: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    if not len(data):
        return np.zeros(0, U64), np.zeros(0, U64) if shapes else None, np.zeros(len(bounds) - 1, np.int64)
    space = SPACE[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[bounds] = True
    starts = ~space
    starts[1:] &= space[:-1] | fresh[1:-1]
    ends = ~space
    ends[:-1] &= space[1:] | fresh[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    counts = np.diff(np.searchsorted(starts, bounds))
    shape = None
    if shapes:
        kind = KIND[data]
        keep = ~space
        keep[1:] &= kind[1:] != kind[:-1]
        keep[starts] = True
        at = np.zeros(len(data) + 1, np.int64)
        np.cumsum(keep, out=at[1:])
        shape = _span_hashes(kind[keep], at[starts], at[ends])
    return _span_hashes(data, starts, ends), shape, counts


def word_groups(
    texts: pa.Array, lower: bool = False, shapes: bool = False
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None, np.ndarray]]:
    """Groups of neighbouring texts: first and last row, hashes of words, of their shapes, number of words of each text.

    Words are runs of anything but ASCII white space; the shape of a word is its bytes' kinds, runs as one.
    Null counts as empty. A group has about AT_ONCE bytes or is a single text.
    """
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    row = 0
    with np.errstate(over="ignore"):
        while row < len(texts):
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + AT_ONCE, "right")) - 1)
            part, bounds = data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
            part = LOWER[part] if lower else part
            if len(part) <= AT_ONCE:
                words, shape, counts = _words(part, bounds, shapes)
            else:
                found = [_words(p, np.array([0, len(p)]), shapes) for p in _cut_at_space(part)]
                words = np.concatenate([f[0] for f in found])
                shape = np.concatenate([f[1] for f in found]) if shapes else None
                counts = np.array([len(words)])
            yield row, stop, words, shape, counts
            row = stop


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each word on, across texts too; the last n - 1 words begin none."""
    if len(words) < n:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        total = words[: len(words) - n + 1] * _POSITIONS[0]
        for k in range(1, n):
            total = total + words[k : len(words) - n + 1 + k] * _POSITIONS[k]
        return mix(total)
