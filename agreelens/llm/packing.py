"""Harmonic packing of tokenized documents into training sequences."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from agreelens.llm.common import id_and_bytes
from agreelens.llm.tokens import worker_tokenizer

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
SCHEMA = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length")]
    + [("ids", pa.binary())]
    + [(n, pa.int64()) for n in ("doc_tokens", "sequence_id", "offset")]
)


def cut(n: int, capacity: int, grain: int) -> list[int]:
    """Piece lengths of a document of ``n`` tokens: whole sequences, then powers of two, then the rest below ``grain``."""
    out = [capacity] * (n // capacity)
    size, n = capacity // 2, n % capacity
    while size >= grain:
        if n >= size:
            out.append(size)
            n -= size
        size //= 2
    return out + [n] * (n > 0)


class Bins:
    """The open bins of one task. A class holds pieces of one length; its bins hold a fixed number of them."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity = capacity
        self.next_id = first_id
        self.open: dict[int, list[tuple]] = defaultdict(list)

    def close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids) // 4, ids, total, self.next_id, offset
            offset += len(ids) // 4
        self.next_id += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        length = len(piece[2]) // 4
        held = self.open[length]
        held.append(piece)
        if len(held) == self.capacity // length:
            self.open[length] = []
            yield from self.close(held)

    def finish(self) -> Iterator[tuple]:
        """What no full bin took: cut to powers of two and laid out by falling size, which leaves no gap."""
        small = []
        for held in self.open.values():
            for doc_id, start, ids, total in held:
                at, n = 0, len(ids) // 4
                while n:
                    size = 1 << (n.bit_length() - 1)
                    small.append((doc_id, start + at, ids[4 * at : 4 * (at + size)], total))
                    at, n = at + size, n - size
        small.sort(key=lambda p: -len(p[2]))
        left = sum(len(p[2]) // 4 for p in small)
        held, room = [], min(self.capacity, 1 << (left.bit_length() - 1)) if left else 0
        for piece in small:
            held.append(piece)
            size = len(piece[2]) // 4
            left, room = left - size, room - size
            if not room:
                yield from self.close(held)
                held, room = [], min(self.capacity, 1 << (left.bit_length() - 1)) if left else 0


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 4096,
    end_id: int = 2,
    grain: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Documents as token ids, each followed by ``end_id``, packed into sequences of ``capacity`` tokens.

    Harmonic classes: a piece of length L falls into the class of capacity // L, whose bins take exactly
    that many pieces. Documents are cut so that all classes but the last few are exact (capacity / 2^i);
    the rest below ``grain`` stays whole and wastes less than ``grain`` tokens a bin. Each task fills its
    own bins, so nothing is shuffled and a lost task is redone alone; pieces left over at a task's end
    are cut to powers of two and make sequences whose length is a power of two, which need no padding.

    One row per piece: ``ids`` holds little-endian unsigned 32-bit ids, ``start`` counts the ids of the
    document before it, ``offset`` those of the sequence. Null and empty texts are one piece with ``end_id``. A null id
    stays null, repeated rows are packed each on their own, other columns are ignored. A task holds at
    most one open bin per class, however long a text is.
    """
    if capacity & (capacity - 1) or grain & (grain - 1) or grain > capacity:
        raise ValueError("capacity and grain must be powers of two")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(vocabulary)
        bins = Bins(capacity, TaskContext.get().partitionId() << 33)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids, bounds = tokenizer.encode([(t or b"").decode() for t in part.column(1).to_pylist()])
                data = ids.astype("<u4").tobytes()
                done: list[tuple] = []
                for doc_id, a, b in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    own, total, start = data[4 * a : 4 * b] + end, b - a + 1, 0
                    for n in cut(total, capacity, grain):
                        done += bins.add((doc_id, start, own[4 * start : 4 * (start + n)], total))
                        start += n
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), SCHEMA)], schema=SCHEMA)
        if last := list(bins.finish()):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*last), SCHEMA)], schema=SCHEMA)

    return id_and_bytes(docs, id_col, text_col).mapInArrow(pack, PIECES)
