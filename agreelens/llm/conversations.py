"""Conversations repaired to the order of roles that training needs: an optional system turn, then user and assistant in turn."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agreelens.llm.common import WORD, staged
from agreelens.operators.joins import splittable_join

#: Costs of the edits; a truncated turn that is not deleted costs ``TRUNCATED`` more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns aligned at once, and turns up to which a worker remembers alignments.
BLOCK, SHORT = 1024, 64

# A turn's code: its role's initial, plus one of the faults.
USER, ASSISTANT, SYSTEM, OTHER = range(4)
CUT, BLANK, REPEATED = 4, 8, 16
#: Pairs of initials that may follow each other.
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
# What has been written before a block: turns, the last one an assistant's or a user's; the system turn alone; nothing.
EXPECT_USER, EXPECT_ASSISTANT, AFTER_SYSTEM, START = STATES = range(4)
#: The insertions that end a conversation from each state.
TAILS = ("", "I", "II", "")
TAIL_COSTS = tuple(INSERT * len(t) for t in TAILS)

_FAR = 1 << 40


@dataclass(frozen=True)
class Way:
    """How a block can be repaired: the state at its end, the cost, edits before the alternating part, its first turn, and the lengths that cost the least."""

    end: int
    cost: int
    before: str = ""
    first: int = 0
    lengths: tuple[int, ...] = ()


class Alignment:
    """Wagner-Fischer tables of a block of turns against every feasible length of alternating roles.

    Counted from the end, targets of all lengths that end alike begin alike. So two tables, one per role that may follow the block,
    hold the alignments to all of them: cell (i, j) is the least cost of turning turns i, i + 1, ... into the last j roles. A path
    to a cell off the diagonal has paid for as many insertions or deletions, so Ukkonen's band, whose width is what a known alignment
    costs beyond the required deletions, holds every best path. Insertions stand before a turn of the block (those after
    the conversation's last turn are its tail), so no audit of a block is the beginning of another.
    """

    def __init__(self, codes: bytes):
        self.codes, self.m = codes, len(codes)
        self.rest = [0] * (self.m + 1)
        for i in range(self.m - 1, -1, -1):
            self.rest[i] = self.rest[i + 1] + (codes[i] < BLANK)
        known = [self.incumbent(phase) for phase in (0, 1)]
        required = DELETE * (self.m - self.rest[0])
        self.tables: list[list[np.ndarray]] = []
        self.down: list[int] = []
        for after in (0, 1):
            # Another end costs one more turn before the last one, which changes its role.
            spare = max(cost + (0 if end == after and self.rest[0] else INSERT + REROLE) for cost, end in known) - required
            self.down.append(spare // DELETE)
            self.tables.append(self.table(after, spare // INSERT, spare // DELETE))

    def incumbent(self, phase: int) -> tuple[int, int]:
        """Cost and end of a plain repair: insert where a role does not follow, rerole what is no user's or assistant's."""
        cost = 0
        for c in self.codes:
            role = c & 3
            if c >= BLANK:
                cost += DELETE
                continue
            if role <= ASSISTANT and role != phase:
                cost += INSERT
                phase ^= 1
            cost += (TRUNCATED if c & CUT else 0) + (REROLE if role > ASSISTANT else 0)
            phase ^= 1
        return cost, phase

    def table(self, after: int, up: int, down: int) -> list[np.ndarray]:
        """Rows i = 0 .. m; entry k of row i is the cell with j = rest[i] - down + k."""
        width = up + down + 1
        places, slope = np.arange(width), INSERT * np.arange(width, dtype=np.int64)
        row = np.full(width, _FAR, np.int64)
        row[down] = 0
        rows = [row]
        for i in range(self.m - 1, -1, -1):
            c, low = self.codes[i], self.rest[i] - down
            if c >= BLANK:
                base = row + DELETE
            else:
                # The last target role is the one that does not follow the block, and they alternate.
                changed = np.where((places + low + after) & 1 == c & 3, 0, REROLE)
                kept = row + changed + (TRUNCATED if c & CUT else 0)
                if low <= 0:
                    kept[: 1 - low] = _FAR
                base = np.minimum(kept, np.append(row[1:], _FAR) + DELETE)
            if low < 0:
                base[:-low] = _FAR
            row = np.minimum.accumulate(base - slope) + slope
            rows.append(row)
        return rows[::-1]

    def cell(self, after: int, i: int, j: int) -> int:
        row, k = self.tables[after][i], j - self.rest[i] + self.down[after]
        return int(row[k]) if j >= 0 and 0 <= k < len(row) else _FAR

    def best(self, end: int, first: int, phase: int, least: int, before: str = "", spent: int = 0) -> Way:
        """The best way from turn ``first`` to the block's end over all targets of at least ``least`` roles."""
        low = self.rest[first] - self.down[end]
        shortest = max(low, least)
        shortest += (shortest ^ phase ^ end) & 1
        costs = self.tables[end][first][shortest - low :: 2]
        cost = int(costs.min()) if len(costs) else _FAR
        lengths = (shortest + 2 * np.flatnonzero(costs == cost)).tolist() if cost < _FAR else ()
        return Way(end, spent + cost, before, first, tuple(lengths))

    def ways(self, state: int) -> Iterator[Way]:
        if state in (EXPECT_USER, EXPECT_ASSISTANT):
            yield from (self.best(end, 0, state, 0) for end in (0, 1))
            return
        yield from (self.best(end, 0, EXPECT_USER, 1) for end in (0, 1))
        yield Way(state, DELETE * self.m, "D" * self.m, self.m)
        for i, c in enumerate(self.codes) if state == START else ():
            if c & 3 == SYSTEM and c < BLANK:
                spent, before = DELETE * i + (TRUNCATED if c & CUT else 0), "D" * i + "K"
                yield from (self.best(end, i + 1, EXPECT_USER, 1, before, spent) for end in (0, 1))
                left = self.m - i - 1
                yield Way(AFTER_SYSTEM, spent + DELETE * left, before + "D" * left, self.m)

    def costs(self) -> list[int]:
        """The least cost from each state to each state, row by row."""
        out = [_FAR] * (len(STATES) ** 2)
        for state in STATES:
            for way in self.ways(state):
                out[len(STATES) * state + way.end] = min(out[len(STATES) * state + way.end], way.cost)
        return out

    def audit(self, state: int, ahead: tuple[int, ...]) -> tuple[str, int]:
        """Edits of the best way from ``state``, given what each state costs from the block's end on, and the state it ends in.

        The best alignments to all lengths are traced back, and the audits compared.
        """
        ways = list(self.ways(state))
        least = min(w.cost + ahead[w.end] for w in ways)
        found = []
        for w in ways:
            if w.cost + ahead[w.end] == least:
                found += [(w.before + self.trace(w.end, w.first, j), w.end) for j in w.lengths] or [(w.before, w.end)]
        return min(found)

    def trace(self, end: int, i: int, j: int) -> str:
        """The best path's edits; of equally good ones the one whose letter comes first: D, I, K, R."""
        out, here = [], self.cell(end, i, j)
        while i < self.m:
            c = self.codes[i]
            if self.cell(end, i + 1, j) + DELETE == here:
                out.append("D")
                i, here = i + 1, here - DELETE
            elif self.cell(end, i, j - 1) + INSERT == here:
                out.append("I")
                j, here = j - 1, here - INSERT
            else:
                kept = (j + end) & 1 == c & 3
                out.append("K" if kept else "R")
                here -= (TRUNCATED if c & CUT else 0) + (0 if kept else REROLE)
                i, j = i + 1, j - 1
        return "".join(out)


class Remembered:
    """Results for short blocks, most of which occur very often; all are forgotten once there are ``limit``."""

    def __init__(self, compute: Callable, limit: int = 100_000):
        self.compute, self.limit, self.held = compute, limit, {}

    def __call__(self, codes: bytes, *more: object) -> object:
        # For the alignment, one reason to delete is like the other.
        codes = bytes(min(c, BLANK) for c in codes)
        if len(codes) > SHORT:
            return self.compute(codes, *more)
        key = (codes, *more)
        if key not in self.held:
            if len(self.held) >= self.limit:
                self.held.clear()
            self.held[key] = self.compute(codes, *more)
        return self.held[key]


# ------------------------------------------------------------------------------------------ turns and blocks

_KEY = ("turn", "role", "mark", "place")
_KEY_TYPES = "conv_id long, turn long, role string, mark string, place long"


def _coded(rows: DataFrame) -> DataFrame:
    """Order key and code of every present turn; texts stay behind."""
    compact = rows.where("present").select(
        "conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_key"), *_KEY, "blank", "cut"
    )
    # Of the turns with one role and text, all but the first repeat it. Only such are joined back.
    same = compact.where("not blank").groupBy("conv_key", "role", "mark")
    first = same.agg(F.min(F.struct("turn", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    compact = splittable_join(compact, first, ["conv_key", "role", "mark"], "left")
    repeated = F.coalesce(F.col("first") < F.struct("turn", "place"), F.lit(False))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "u", USER).when(initial == "a", ASSISTANT).when(initial == "s", SYSTEM).otherwise(OTHER)
    fault = F.when(F.col("blank"), BLANK).when(repeated, REPEATED).when(F.col("cut"), CUT).otherwise(0)
    return compact.select("conv_id", *_KEY, (role + fault).cast("int").alias("code"))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            yield from batch.slice(at, 1000).to_pylist()


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(kinds: str) -> pa.Schema:
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    types |= {f"array<{k}>": pa.list_(t) for k, t in types.items()}
    return pa.schema([(name, types[kind]) for name, kind in (x.split() for x in kinds.split(", "))])


def _blocks(coded: DataFrame, size: int) -> DataFrame:
    """Runs of at most ``size`` neighbouring turns of one conversation, each with its matrix of costs.

    Turns are dealt out by range of conversation and turn, so a long conversation lies in many tasks.
    """
    kinds = _KEY_TYPES + ", codes binary, costs array<long>"
    schema = _arrow(kinds)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = Remembered(lambda codes: Alignment(codes).costs())

        def blocks() -> Iterator[tuple]:
            for _, turns in groupby(_rows(batches), key=lambda r: r["conv_id"]):
                head, codes = None, bytearray()
                for r in turns:
                    if len(codes) == size:
                        yield *head, bytes(codes), costs(bytes(codes))
                        codes.clear()
                    if not codes:
                        head = (r["conv_id"], *(r[k] for k in _KEY))
                    codes.append(r["code"])
                yield *head, bytes(codes), costs(bytes(codes))

        yield from _batches(blocks(), schema)

    ordered = coded.repartitionByRange("conv_id", *_KEY).sortWithinPartitions("conv_id", *_KEY)
    return ordered.mapInArrow(cut, kinds)


def _looked_ahead(blocks: DataFrame) -> DataFrame:
    """Adds what each state at a block's end costs to the end of the conversation, from its last block backwards; one number per state is carried."""
    kinds = _KEY_TYPES + ", codes binary, ahead array<long>, leads boolean"
    schema = _arrow(kinds)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for _, group in groupby(_rows(batches), key=lambda r: r["conv_id"]):
                ahead, held = list(TAIL_COSTS), None
                for b in group:
                    if held:
                        yield *held, False
                    held = (b["conv_id"], *(b[k] for k in _KEY), b["codes"], ahead)
                    ahead = [min(b["costs"][len(STATES) * s + e] + ahead[e] for e in STATES) for s in STATES]
                yield *held, True

        yield from _batches(out(), schema)

    order = [F.desc(k) for k in _KEY]
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(carry, kinds)


def _audited(blocks: DataFrame) -> DataFrame:
    """Adds the audit of each block, and the state at its end, for each state that it may begin in."""
    kinds = _KEY_TYPES + ", codes binary, audits array<string>, ends array<int>"
    schema = _arrow(kinds)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_audits(codes: bytes, ahead: tuple[int, ...], leads: bool) -> list[tuple[str, int]]:
            table = Alignment(codes)
            return [table.audit(s, ahead) if s == START or not leads else ("", 0) for s in STATES]

        remembered = Remembered(all_audits)

        def out() -> Iterator[tuple]:
            for b in _rows(batches):
                least = min(b["ahead"])
                found = remembered(b["codes"], tuple(a - least for a in b["ahead"]), b["leads"])
                yield b["conv_id"], *(b[k] for k in _KEY), b["codes"], [a for a, _ in found], [e for _, e in found]

        yield from _batches(out(), schema)

    # Blocks of one conversation are traced in many tasks.
    return blocks.repartition("conv_id", *_KEY).mapInArrow(trace, kinds)


# ------------------------------------------------------------------------------------------ repaired conversations


@dataclass
class Repair:
    """One conversation as its turns pass by, in order: counts, audit and the repaired turns."""

    state: int = START
    phase: int = 0
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0))
    turns: list = field(default_factory=lambda: [None, None, 0])
    last_role: int | None = None
    audit: list[str] = field(default_factory=list)
    edits: Iterator[str] = iter(())
    codes: Iterator[int] = iter(())
    cost: int = 0

    def block(self, codes: bytes, audits: list[str], ends: list[int]) -> None:
        audit = audits[self.state]
        self.audit.append(audit)
        self.codes, self.edits, self.state = iter(codes), iter(audit), ends[self.state]

    def _written(self) -> str:
        role = ("user", "assistant")[self.phase]
        self.phase ^= 1
        return role

    def turn(self, turn: int | None, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        code = next(self.codes)
        self.counts["blank"] += bool(code & BLANK)
        self.counts["duplicate"] += bool(code & REPEATED)
        self.counts["truncated"] += bool(code & CUT)
        self.counts["illegal"] += self.last_role is not None and (self.last_role, code & 3) not in LEGAL
        self.last_role = code & 3
        low, high, distinct = self.turns
        if turn is not None and turn != high:
            self.turns = [turn if low is None else low, turn, distinct + 1]
        for edit in self.edits:
            if edit == "I":
                self.cost += INSERT
                yield edit, self._written(), ""
                continue
            if edit == "D":
                self.cost += DELETE
            else:
                self.cost += (REROLE if edit == "R" else 0) + (TRUNCATED if code & CUT else 0)
                opens = edit == "K" and code & 3 == SYSTEM
                own = None if opens else self._written()
                yield edit, role if edit == "K" else own, text
            return

    def tail(self) -> Iterator[tuple[str, str, str]]:
        self.audit.append(TAILS[self.state])
        self.cost += TAIL_COSTS[self.state]
        for edit in TAILS[self.state]:
            yield edit, self._written(), ""

    @property
    def gaps(self) -> int:
        low, high, distinct = self.turns
        return 0 if low is None else high - low + 1 - distinct


def _passed_by(turns: DataFrame, present: Column, block: int, each: Callable, kinds: str) -> DataFrame:
    """``each(conv_id, repair, written)`` for every conversation, where ``written`` runs through its repaired turns."""
    white = F.lit(" \t\n\v\f\r")
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        text.alias("text"),
        F.coalesce(present, F.lit(False)).alias("present"),
    )
    rows = rows.select(
        "*",
        F.md5("text").alias("mark"),
        F.monotonically_increasing_id().alias("place"),
        (~F.col("text").rlike(WORD)).alias("blank"),
        (~F.coalesce(F.right(F.rtrim("text", white), F.lit(1)).isin(".", "!", "?"), F.lit(False))).alias("cut"),
    )
    rows = staged(rows, "conversations")
    audited = _audited(_looked_ahead(_blocks(_coded(rows), block)))
    empty = {"text": F.lit(None).cast("string"), "present": F.lit(True)}
    marks = {"codes": "binary", "audits": "array<string>", "ends": "array<int>"}
    names = ["conv_id", *_KEY, "text", "present", *marks]
    leading = audited.withColumns(empty).select(*names, F.lit(0).alias("kind"))
    bare = rows.withColumns({c: F.lit(None).cast(t) for c, t in marks.items()}).select(*names, F.lit(1).alias("kind"))
    schema = _arrow(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def written(group: Iterator[dict], repair: Repair) -> Iterator[tuple[str, str, str]]:
            for r in group:
                if r["kind"] == 0:
                    repair.block(r["codes"], r["audits"], r["ends"])
                elif r["present"]:
                    yield from repair.turn(r["turn"], r["role"], r["text"])
            yield from repair.tail()

        def out() -> Iterator[tuple]:
            for conv_id, group in groupby(_rows(batches), key=lambda r: r["conv_id"]):
                repair = Repair()
                yield from each(conv_id, repair, written(group, repair))

        yield from _batches(out(), schema)

    # A block stands right before its first turn.
    return leading.unionByName(bare).repartition("conv_id").sortWithinPartitions("conv_id", *_KEY, "kind").mapInArrow(run, kinds)


def conversation_audits(turns: DataFrame, present: Column | None = None, block: int = BLOCK) -> DataFrame:
    """One row per conversation: faults, the cheapest repair's cost and audit, and a digest of the repaired conversation.

    ``turns`` has ``conv_id, turn, role, text``. Turns that are not ``present`` only say that their conversation exists. A repaired
    conversation's role initials are ``(s?(ua)+)?``. Edits, in order and by initial: Keep (cost 0), Rerole to user or assistant (3), Delete (4; blank
    and duplicate turns must go), Insert a turn without text (3); a truncated turn that stays costs 3 more. Of equally cheap audits the
    least in ASCII counts.

    Blocks of at most ``block`` turns are aligned with targets of all feasible lengths (``Alignment``), in as many tasks as a long conversation needs;
    their costs from state to state are carried backwards over a conversation's blocks, every block is traced from each state that it can begin
    in, and the last pass runs through the turns once, holding one block's audit. That pass reads a conversation in one task and in order, as its
    digest demands, and holds no text longer than a batch; all other work on a conversation is spread.

    Returns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` (of ``role:text`` lines). Faults
    are counted once per turn, in the order blank, duplicate, truncated. ``gaps`` are the turn numbers missing between the least and greatest.

    Null roles and texts read as one space. Null turns come first; a null ``conv_id`` is a conversation. Turns of one number are ordered by
    role, then MD5 of the text; repeated rows are duplicates. Empty texts are blank. A conversation without turns has zeros, an empty audit and
    the digest of the empty string. Other columns are ignored; an empty table gives no rows.
    """
    kinds = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def summary(conv_id: int | None, repair: Repair, written: Iterator[tuple[str, str, str]]) -> Iterator[tuple]:
        digest, first = hashlib.sha256(), True
        for _, role, text in written:
            digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
            first = False
        counts = (repair.counts[c] for c in ("blank", "duplicate", "truncated", "illegal"))
        yield conv_id, repair.gaps, *counts, repair.cost, "".join(repair.audit), digest.hexdigest()

    return _passed_by(turns, F.lit(True) if present is None else present, block, summary, kinds)


def repaired_turns(turns: DataFrame, present: Column | None = None, block: int = BLOCK) -> DataFrame:
    """The repaired conversations themselves: ``conv_id, position, edit, role, text``, where ``edit`` is K, R or I. Rules as in ``conversation_audits``."""

    def listed(conv_id: int | None, repair: Repair, written: Iterator[tuple[str, str, str]]) -> Iterator[tuple]:
        for position, (edit, role, text) in enumerate(written):
            yield conv_id, position, edit, role, text

    kinds = "conv_id long, position long, edit string, role string, text string"
    return _passed_by(turns, F.lit(True) if present is None else present, block, listed, kinds)


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with known damage, and whether they are still ``present``, by CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops a turn, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it a user's. Nulls count as one space.
    """
    space = F.lit(" ")
    number = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *number).cast("binary")) % 20
    text, role = (F.coalesce(F.col(c).cast("string"), space) for c in ("text", "role"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("kind") != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
