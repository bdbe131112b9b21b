"""Passages repeated from earlier documents, by parsing every document against an index of all windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agreelens.llm.common import WordHashes, covered, id_and_bytes, window_hashes

KEYS = "batch long, block long, size long, hashes binary, owners binary, ids binary"
FLAGS = "batch long, block long, repeated binary"
PARSED = "doc_id long, n_words long, spans array<struct<first:int,end:int>>, kept_text string"
PARSED_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))), ("kept_text", pa.string())]
)


def gaps(hashes: np.ndarray) -> bytes:
    """Ascending hashes: the first, the width of the widest gap in bytes, then all gaps in that width."""
    steps = np.diff(hashes)
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    packed = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    return int(hashes[0]).to_bytes(8, "little") + bytes([width]) + packed.tobytes()


def from_gaps(data: bytes, n: int) -> np.ndarray:
    steps = np.zeros((n, 8), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 8)
    steps[1:, : data[8]] = np.frombuffer(data, np.uint8, offset=9).reshape(n - 1, data[8])
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


class Batch:
    """The documents of one batch by id, and the distinct windows in them, each with its first owner."""

    def __init__(self, table: pa.Table, window: int, hashes: WordHashes):
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or b""))
        self.ids = [r[0] for r in rows]
        self.words = [(r[1] or b"").split() for r in rows]
        own = [window_hashes(hashes.of(w), window) for w in self.words]
        self.bounds = np.cumsum([0, *map(len, own)])
        # A document without an id is later than all others, and such documents are not compared.
        self.order = np.array([np.iinfo(np.int64).max if i is None else i for i in self.ids], np.int64)
        owner = np.repeat(np.arange(len(rows)), np.diff(self.bounds))
        every = np.concatenate(own) if own else np.zeros(0, np.uint64)
        self.distinct, first, self.inverse = np.unique(every, return_index=True, return_inverse=True)
        self.first = owner[first]
        self.here = self.order[self.first][self.inverse] < self.order[owner]

    def block_edges(self, blocks: int) -> np.ndarray:
        """Where each block's share of the distinct windows begins; a block is a range of hashes."""
        lows = [np.uint64((b << 64) // blocks) for b in range(blocks)]
        return np.append(np.searchsorted(self.distinct, lows), len(self.distinct))


def remove_repeats(
    docs: DataFrame, window: int = 13, block_chars: int = 16_000_000, batch_chars: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Removes every word inside a run of ``window`` words that also begins in a document with a smaller id.

    A Lempel-Ziv parse relative to the whole corpus. The reference is the windows of all documents, indexed
    in blocks by hash range; each document is parsed against every block at once, as a window can only be
    in the block that owns its hash. Neighbouring hits join to the longest factors, ``spans``: a factor begins and ends where
    the window before and after it has no earlier occurrence, so only runs of ``window`` words count.

    Batches of documents send each distinct window once, under its first document, so a passage shared by a
    third of all documents reaches its block once per batch. What is found inside a batch stays there. The
    answer is one bit per window; no pairs are formed. Batches and blocks grow in number with the text,
    not in size; a window of 64 bits is taken as equal to another by hash.

    Returns ``doc_id, n_words, spans, kept_text`` (kept words joined by one space). Null, empty and short
    texts lose nothing. Rows without an id come last: they lose what documents with ids hold. Rows with the
    same id do not count as earlier than each other. Other columns are ignored. An empty table gives an empty result.
    """
    docs = id_and_bytes(docs, id_col, text_col)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, batches = int(chars // block_chars + 1), int(chars // batch_chars + 1)
    batched = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(batches)))

    def keys(table: pa.Table) -> pa.Table:
        own = Batch(table, window, WordHashes())
        edges = own.block_edges(blocks)
        rows = []
        for block in np.flatnonzero(np.diff(edges)).tolist():
            a, b = edges[block], edges[block + 1]
            used, owners = np.unique(own.first[a:b], return_inverse=True)
            kind = np.uint8 if len(used) <= 256 else np.uint32
            rows.append((block, int(b - a), gaps(own.distinct[a:b]), owners.astype(kind).tobytes(), own.order[used].tobytes()))
        columns = list(zip(*rows)) or [[]] * 5
        batch = pa.array([table.column("batch")[0].as_py()] * len(rows), pa.int64())
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([batch, *(pa.array(c, t) for c, t in zip(columns, types))], ["batch", "block", "size", "hashes", "owners", "ids"])

    def look_up(table: pa.Table) -> pa.Table:
        parts, orders = [], []
        sizes = table.column("size").to_pylist()
        for n, data, owners, ids in zip(sizes, *(table.column(c).to_pylist() for c in ("hashes", "owners", "ids"))):
            parts.append(from_gaps(data, n))
            kind = np.uint8 if len(owners) == n else np.uint32
            orders.append(np.frombuffer(ids, np.int64)[np.frombuffer(owners, kind)])
        every, order = np.concatenate(parts), np.concatenate(orders)
        at = np.argsort(every, kind="stable")
        begins = np.flatnonzero(np.concatenate([[True], np.diff(every[at]) != 0]))
        earliest = np.repeat(np.minimum.reduceat(order[at], begins), np.diff(np.append(begins, len(at))))
        repeated = np.empty(len(at), bool)
        repeated[at] = earliest < order[at]
        bits = [np.packbits(p).tobytes() if p.any() else None for p in np.split(repeated, np.cumsum(sizes)[:-1])]
        out = pa.table([table.column("batch"), table.column("block"), pa.array(bits, pa.binary())], ["batch", "block", "repeated"])
        return out.filter(pa.array([b is not None for b in bits], pa.bool_()))

    def parse(table: pa.Table, flags: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([[]] * 4, schema=PARSED_ARROW)
        own = Batch(table, window, WordHashes())
        edges = own.block_edges(blocks)
        before = np.zeros(len(own.distinct), bool)
        for block, bits in zip(flags.column("block").to_pylist(), flags.column("repeated").to_pylist()):
            a, b = edges[block], edges[block + 1]
            before[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(b - a))
        hit = own.here | before[own.inverse] if len(own.inverse) else np.zeros(0, bool)
        rows = []
        for doc_id, words, a, b in zip(own.ids, own.words, own.bounds[:-1], own.bounds[1:]):
            gone = covered(np.flatnonzero(hit[a:b]), window, len(words))
            turns = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
            spans = [{"first": int(x), "end": int(y)} for x, y in zip(turns[::2], turns[1::2])]
            kept = [w for w, g in zip(words, gone.tolist()) if not g] if spans else words
            rows.append((doc_id, len(words), spans, b" ".join(kept).decode()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), PARSED_ARROW)], schema=PARSED_ARROW)

    routed = batched.groupBy("batch").applyInArrow(keys, KEYS)
    flags = routed.groupBy("block").applyInArrow(look_up, FLAGS)
    return batched.groupBy("batch").cogroup(flags.groupBy("batch")).applyInArrow(parse, PARSED)

