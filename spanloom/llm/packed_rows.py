"""Packed id matrices: best-fit-decreasing with a segment tree over capacities.

Every task packs the documents of its own input split, a window of tokens at a
time, so ids are never shuffled and memory is bounded by the window and the
longest document. Within a window pieces are sorted from longest to shortest
and put into the fullest row that still has room; a segment tree over the free
capacity finds it. Only the last rows of a window can have much room.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.tokens import cuts, document_ids, encoder

CAPACITY = 2048
WINDOW = 1 << 22
PADDING = 50256
BATCH = 256
SCHEMA = (
    "first_doc_id long, first_piece int, n_tokens int, n_segments int, input_ids array<int>, position_ids array<int>, "
    "cu_seqlens array<int>, doc_ids array<bigint>, pieces array<int>, starts array<bigint>"
)


class Rooms:
    """Rows by free capacity; the smallest capacity that is large enough is found in a segment tree."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self.count(room, 1)

    def count(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.tree[at] += by
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) with the smallest room of at least ``least``."""
        at = least + self.size
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at <<= 1
                if not self.tree[at]:
                    at += 1
        room = at - self.size
        self.count(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows as lists of indices into ``lengths``; ties go by index."""
    rooms, rows = Rooms(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = rooms.take(lengths[i])
        if found is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(i)
        if room > lengths[i]:
            rooms.add(room - lengths[i], row)
    return rows


def packed(pieces: list[tuple], capacity: int, padding: int) -> Iterator[pa.RecordBatch]:
    rows = best_fit_decreasing([len(p[3]) for p in pieces], capacity)
    for k in range(0, len(rows), BATCH):
        part = rows[k : k + BATCH]
        n = len(part)
        ids, places = np.full((n, capacity), padding, dtype=np.int32), np.zeros((n, capacity), dtype=np.int32)
        ends, docs, numbers, starts = [], [], [], []
        for r, row in enumerate(part):
            at, edge = 0, [0]
            for i in row:
                doc, number, start, values = pieces[i]
                ids[r, at : at + len(values)] = values
                places[r, at : at + len(values)] = np.arange(len(values), dtype=np.int32)
                at += len(values)
                edge.append(at)
            ends.append(edge)
            docs.append([pieces[i][0] for i in row])
            numbers.append([pieces[i][1] for i in row])
            starts.append([pieces[i][2] for i in row])
        offsets = pa.array(np.arange(0, n * capacity + 1, capacity, dtype=np.int32))
        matrix = [pa.ListArray.from_arrays(offsets, pa.array(m.ravel())) for m in (ids, places)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([d[0] for d in docs], pa.int64()),
                pa.array([p[0] for p in numbers], pa.int32()),
                pa.array([e[-1] for e in ends], pa.int32()),
                pa.array([len(d) for d in docs], pa.int32()),
                *matrix,
                pa.array(ends, pa.list_(pa.int32())),
                pa.array(docs, pa.list_(pa.int64())),
                pa.array(numbers, pa.list_(pa.int32())),
                pa.array(starts, pa.list_(pa.int64())),
            ],
            names="first_doc_id first_piece n_tokens n_segments input_ids position_ids cu_seqlens doc_ids pieces starts".split(),
        )


def pack_split(capacity: int, window: int, padding: int, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        pieces, held = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = document_ids(encode, text.as_py())
                for number, (start, length) in enumerate(cuts(len(ids), capacity)):
                    pieces.append((doc, number, start, ids[start : start + length].astype(np.int32)))
                held += len(ids)
                if held >= window:
                    yield from packed(pieces, capacity, padding)
                    pieces, held = [], 0
        if pieces:
            yield from packed(pieces, capacity, padding)

    return run


def pack_rows(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, window: int = WINDOW, padding: int = PADDING, path: str | None = None
) -> DataFrame:
    """One row per packed sequence.

    ``input_ids`` has ``capacity`` ids, padded behind ``n_tokens``;
    ``position_ids`` starts again at 0 with every segment; ``cu_seqlens`` has
    the ``n_segments`` + 1 cumulative lengths; ``doc_ids``, ``pieces`` and
    ``starts`` say which part of which document a segment is, so that joining
    pieces in order gives each document's ids back. A null or empty text is a
    segment of one id (the end of document). Null ids stay null, repeated rows
    are packed each, other columns are not read, an empty table gives no rows.
    """
    base = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    return base.mapInArrow(pack_split(capacity, window, padding, path), SCHEMA)
