"""Fill-in-the-middle transformation: documents are cut at token counts and their pieces put in another order."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")

#: Bytes that the rolling hash sees at once; a chunk ends about every 256 bytes, and after ``LONGEST`` at the latest.
ROLLING, LONGEST = 16, 4096
#: Bytes of text hashed at once, and bytes of chunks that a worker remembers.
SEGMENT, MEMORY = 1 << 20, 64 << 20

_BASE = 0x9E3779B97F4A7C15
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Byte classes: a letter, another first byte of a character, a later byte of one.
_CLASSES = bytes(ord("a") if b in _LETTERS else ord("c") if 0x80 <= b < 0xC0 else ord("x") for b in range(256))


class RollingHash:
    """Where the chunks of a text end: places that depend on the bytes around them, not on what stands far before.

    Two texts that share a passage share the chunks inside it. In a run of one byte every place looks alike; only the first
    of such a row of places counts, and ``LONGEST`` cuts what has none.
    """

    def __init__(self, segment: int = SEGMENT):
        self.segment = segment
        # A random odd 64-bit number per byte, and the powers of the hash's base and of its inverse.
        self.weights = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = np.full(segment + ROLLING + 1, _BASE, np.uint64)
        self.down = np.full(segment + ROLLING + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        self.up[0] = self.down[0] = 1
        np.multiply.accumulate(self.up, out=self.up)
        np.multiply.accumulate(self.down, out=self.down)

    def matches(self, raw: bytes, first: int, last: int) -> np.ndarray:
        """Places p in [first, last) where the hash of the ``ROLLING`` bytes before p says that a chunk may end."""
        low = max(0, first - ROLLING)
        ends = np.arange(max(first, ROLLING) - low, last - low)
        if not len(ends):
            return ends
        sums = np.cumsum(self.weights[np.frombuffer(raw, np.uint8, last - 1 - low, low)] * self.up[: last - 1 - low])
        # Place p sees the bytes p - ROLLING to p - 1, whose sum is a difference of two prefix sums.
        before = np.where(ends > ROLLING, sums[np.maximum(ends - ROLLING - 1, 0)], np.uint64(0))
        return ends[((sums[ends - 1] - before) * self.down[ends - 1]) >> np.uint64(56) == 0] + low

    def chunk_ends(self, raw: bytes) -> list[int]:
        n = len(raw)
        if n <= ROLLING:
            return [n] if n else []
        places = np.concatenate([self.matches(raw, at, min(at + self.segment, n)) for at in range(1, n, self.segment)])
        places = places[np.diff(places, prepend=-1) > 1]
        edges = np.concatenate(([0], places, [n]))
        if (np.diff(edges) <= LONGEST).all():
            return edges[1:].tolist()
        return [e for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) for e in (*range(a + LONGEST, b, LONGEST), b)]


class ChunkMemo(dict):
    """Boundary summary of each chunk: tokens, characters, whether it begins and whether it ends with a letter.

    A chunk is found by its whole content, so equal hashes cannot be taken for equal chunks. All are forgotten once the
    chunks held exceed ``limit`` bytes.
    """

    def __init__(self, limit: int = MEMORY):
        self.limit, self.held, self.misses = limit, 0, 0
        self.rolling = RollingHash()

    def __missing__(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        kinds = chunk.translate(_CLASSES)
        inside = kinds.count(b"c")
        runs = kinds.count(b"xa") + kinds.count(b"ca") + kinds.startswith(b"a")
        summary = kinds.count(b"x") + runs, len(chunk) - inside, kinds.startswith(b"a"), kinds.endswith(b"a")
        self.misses += 1
        if self.held + len(chunk) > self.limit:
            self.clear()
            self.held = 0
        self.held += len(chunk)
        self[chunk] = summary
        return summary


class CountedText:
    """A text's tokens, letter runs and single other characters, counted by chunks."""

    def __init__(self, raw: bytes, memo: ChunkMemo):
        self.raw = raw
        self.edges = [0, *memo.rolling.chunk_ends(raw)]
        chunks = [memo[raw[a:b]] for a, b in zip(self.edges, self.edges[1:])]
        # A letter run that goes on across an edge was counted on both sides.
        joined = [False, *(a[3] and b[2] for a, b in zip(chunks, chunks[1:]))]
        self.joined = joined
        self.tokens = [0, *accumulate(c[0] - j for c, j in zip(chunks, joined))]
        self.chars = [0, *accumulate(c[1] for c in chunks)]

    def place(self, k: int) -> tuple[int, int]:
        """Byte and character at which the first k tokens end."""
        if k <= 0:
            return 0, 0
        if k >= self.tokens[-1]:
            return self.edges[-1], self.chars[-1]
        # Token k begins in the last chunk before which at most k tokens have begun; a chunk in which none begins has equal counts.
        i = bisect_right(self.tokens, k) - 1
        kinds = np.frombuffer(self.raw[self.edges[i] : self.edges[i + 1]].translate(_CLASSES), np.uint8)
        letter, later = kinds == ord("a"), kinds == ord("c")
        starts = ~later
        starts[1:] &= ~(letter[1:] & letter[:-1])
        if self.joined[i]:
            starts[0] = False
        at = int(np.flatnonzero(starts)[k - self.tokens[i]])
        return self.edges[i] + at, self.chars[i] + at - int(later[:at].sum())


def cut_texts(
    texts: Iterable[bytes | None], first: Sequence[int], second: Sequence[int], memo: ChunkMemo
) -> list[tuple[int, int, int, int, int]]:
    """Per text: tokens n, and the bytes and characters at ``first % (n + 1)`` and ``second % (n + 1)`` tokens, in order."""
    out = []
    for raw, a, b in zip(texts, first, second):
        text = CountedText(raw or b"", memo)
        n = text.tokens[-1]
        low, high = sorted((a % (n + 1), b % (n + 1)))
        out.append((n, *text.place(low), *text.place(high)))
    return out


_CUTS = T.StructType([T.StructField(x, T.LongType()) for x in ("n", "byte1", "char1", "byte2", "char2")])


def fill_in_middle(
    docs: DataFrame,
    plain_percent: int = 10,
    spm_percent: int = 20,
    seed: int = 1,
    sentinels: tuple[str, str, str] = SENTINELS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Documents with a middle to be filled in: prefix, suffix, middle (``psm``), or suffix, prefix, middle (``spm``).

    A token is a run of ASCII letters or any other single character. Of the hex SHA-256 of ``seed:id``, two groups of eight
    digits choose the two cuts among the n + 1 places between tokens, the third leaves ``plain_percent`` % of the texts
    as they are, the fourth gives ``spm_percent`` % of the others the form ``spm``. A text that holds a sentinel stays plain, so
    ``restore`` gives back every text from output and form.

    Counts come from content-defined chunks: a rolling hash ends a chunk where the last bytes say so, each distinct chunk is
    counted once for as long as a worker remembers it, and chunk counts, less the letter runs that cross an edge, add up to the
    count at every edge. Only the two chunks that hold the cuts are looked into.

    Returns ``doc_id, n, form, prefix_chars, middle_chars, output``; the character counts are null if plain. Null and empty texts
    are plain and empty, with n = 0. A null id stays null and is hashed as an empty string; rows that repeat an id have the same random
    numbers. Other columns are ignored. Very long texts are cut whole, and hashed a megabyte at a time. An empty table gives no rows.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]

    @F.arrow_udf(_CUTS)
    def cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        memo = ChunkMemo()
        for texts, first, second in batches:
            rows = cut_texts((t.as_py() for t in texts), first.to_pylist(), second.to_pylist(), memo)
            columns = zip(*rows) if rows else [()] * len(_CUTS)
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], _CUTS.names)

    text = F.coalesce(F.col(text_col), F.lit("")).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *(x.alias(f"h{i + 1}") for i, x in enumerate(h)))
    taken = F.lit(False)
    for s in sentinels:
        taken = taken | F.contains("text", F.lit(s))
    form = (
        F.when((F.col("text") == "") | taken | (F.col("h3") % 100 >= 100 - plain_percent), "plain")
        .when(F.col("h4") % 100 < spm_percent, "spm")
        .otherwise("psm")
    )
    raw = F.col("text").cast("binary")
    rows = rows.withColumn("form", form).withColumn("cut", cuts(raw, "h1", "h2"))
    byte1, byte2 = F.col("cut.byte1").cast("int"), F.col("cut.byte2").cast("int")
    prefix = F.substring(raw, F.lit(1), byte1).cast("string")
    middle = F.substring(raw, byte1 + 1, byte2 - byte1).cast("string")
    suffix = F.substring(raw, byte2 + 1, F.octet_length("text") - byte2).cast("string")
    p, s, m = (F.lit(x) for x in sentinels)
    plain = F.col("form") == "plain"
    output = (
        F.when(plain, F.col("text"))
        .when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .otherwise(F.concat(s, suffix, p, prefix, m, middle))
    )
    return rows.select(
        "doc_id",
        F.col("cut.n").alias("n"),
        "form",
        F.when(~plain, F.col("cut.char1")).alias("prefix_chars"),
        F.when(~plain, F.col("cut.char2") - F.col("cut.char1")).alias("middle_chars"),
        output.alias("output"),
    )


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from a transformed document. Each sentinel's first place after the one before it is its own."""
    p, s, m = (rf"\Q{x}\E" for x in sentinels)
    psm = F.regexp_replace(output, f"(?s)^{p}(.*?){s}(.*?){m}(.*)$", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)^{s}(.*?){p}(.*?){m}(.*)$", "$2$3$1")
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
