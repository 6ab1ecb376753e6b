"""Sets of word shingles as sorted 64-bit hashes, computed on whole columns of bytes.

Words are runs of bytes other than space and U+0009 to U+000D, with A-Z lower-cased (all these are
single bytes in UTF-8). A text's set has one hash for each distinct run of ``SIZE`` words; fewer
words are one shingle as a whole, and no words are an empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SIZE = 5
#: Bytes of text for which word hashes are computed at a time, and of the texts handled together.
PIECE, GROUP = 1 << 18, 1 << 21

_K = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which all bits depend on all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _K)
_PLACE = mix(np.arange(1001, 1257, dtype=np.uint64) * _K) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[32, 9, 10, 11, 12, 13]] = False


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offsets of its rows in them (one more than rows); null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word; no word goes over one of ``begins``."""
    inside = _IN_WORD[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    here = begins[begins < len(data)]
    starts[here] = inside[here]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(starts)
    cuts = np.searchsorted(at, first)
    place = np.arange(len(at)) - np.repeat(cuts, np.diff(np.append(cuts, len(at))))
    weight = _PLACE[place & 255]
    if place.max() > 255:
        weight = weight + (place >> 8).astype(np.uint64) * (_K << np.uint64(1))
    values = _BYTE[_LOWER[data[at]]] * weight
    return mix(np.add.reduceat(values, cuts) + np.diff(np.append(cuts, len(at))).astype(np.uint64)), first


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many come before each offset."""
    hashes, places, a = [], [], 0
    while a < len(data):
        b = min(len(data), a + PIECE)
        k = int(np.searchsorted(offsets, b))
        if b < len(data) and offsets[k] - a <= 2 * PIECE:
            b = int(offsets[k])
        while b < len(data) and _IN_WORD[data[b]] and offsets[np.searchsorted(offsets, b)] != b:
            b += 1
        h, first = _words(data[a:b], offsets[(offsets >= a) & (offsets < b)] - a)
        hashes.append(h)
        places.append(first + a)
        a = b
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted set of each row's shingles."""
    data, offsets = text_bytes(column)
    row, rows = 0, len(column)
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + GROUP, side="right")) - 1)
        own = offsets[row : end + 1]
        words, before = word_hashes(data[own[0] : own[-1]], own - own[0])
        runs = words
        if len(words) >= SIZE:
            runs = words[: len(words) - SIZE + 1]
            for k in range(1, SIZE):
                runs = runs * _K + words[k : len(words) - SIZE + 1 + k]
            runs = mix(runs)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if b - a >= SIZE:
                one = np.sort(runs[a : b - SIZE + 1])
                yield one if len(one) == 1 else one[np.append(True, one[1:] != one[:-1])]
            elif b > a:
                whole = np.uint64(b - a)
                for w in words[a:b].tolist():
                    whole = np.uint64((int(whole) * int(_K) + w) & 0xFFFFFFFFFFFFFFFF)
                yield mix(np.array([whole], np.uint64) ^ _K)
            else:
                yield np.zeros(0, np.uint64)
        row = end
