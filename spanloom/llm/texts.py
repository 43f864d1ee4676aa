"""Whole Arrow text columns as numpy words and hashes, a bounded run of documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all their bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    up = np.full(n, base, dtype=U64)
    down = np.full(n, pow(base, -1, 1 << 64), dtype=U64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def runs(column: pa.Array, at_most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of documents: (first row, bytes, offsets within the bytes).

    A run has about ``at_most`` bytes; a longer document stands alone, whole.
    A null text has no bytes.
    """
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + at_most, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the words (runs of anything but white space)."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([True], ~word[:-1])) | edge[:-1]
    after = np.concatenate((~word[1:], [True])) | edge[1:]
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Documents and hashes of all word shingles of a run, A-Z in lower case.

    A document of fewer words has its whole sequence as one shingle; one
    without words has none. Repeats are kept.
    """
    data = LOWER[data]
    starts, ends, docs = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    counts = np.bincount(docs, minlength=len(offsets) - 1) if len(docs) else np.zeros(len(offsets) - 1, dtype=np.int64)
    n = max(0, len(words) - width + 1)
    inside = docs[:n] == docs[width - 1 :] if n else np.zeros(0, dtype=bool)
    where = np.flatnonzero(inside)
    value = np.full(len(where), width, dtype=U64)
    for j in range(width):
        value = mix(value * U64(0xFF51AFD7ED558CCD) + words[where + j])
    of = docs[where]
    begin = np.concatenate(([0], np.cumsum(counts)))
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        few = counts[short].astype(U64)
        some = few.copy()
        for j in range(width - 1):
            has = counts[short] > j
            at = np.minimum(begin[short] + j, len(words) - 1)
            some = np.where(has, mix(some * U64(0xFF51AFD7ED558CCD) + words[at]), some)
        of, value = np.concatenate((of, short)), np.concatenate((value, some))
        order = np.argsort(of, kind="stable")
        of, value = of[order], value[order]
    return of, value


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row that has any."""
    for first, data, offsets in runs(column):
        of, value = shingles(data, offsets, width)
        cuts = np.flatnonzero(np.diff(of)) + 1
        for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(of)]))):
            if b > a:
                yield first + int(of[a]), np.unique(value[a:b])
