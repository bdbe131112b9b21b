"""Vote strings to arrays, arrays to bucket counts.

Everything is array functions on one row: no explode, no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import PY_WHITESPACE

BucketRule = tuple[str, Callable[[Column], Column]]

# Checked in this order wherever the first hit wins.
VOTE_BUCKETS: tuple[BucketRule, ...] = (
    ("entailment", lambda v: v.between(1, 3)),
    ("neutral", lambda v: v == 0),
    ("contradiction", lambda v: v.between(-3, -1)),
)

POLICIES = ("fail", "neutral", "drop")


# Whitespace becomes a plain space, which the integer cast trims. Other control characters, which it would
# trim too, become a letter, so that they stay malformed.
_SPACES = PY_WHITESPACE.replace(" ", "")
_CONTROLS = "".join(chr(c) for c in (*range(32), *range(0x7F, 0xA0)) if chr(c) not in PY_WHITESPACE)
_FROM, _TO = _SPACES + _CONTROLS, " " * len(_SPACES) + "x" * len(_CONTROLS)


def vote_pieces(raw: Column, policy: str, skip_empty: bool | None = None) -> Column:
    """Pieces of a comma-separated vote string, possibly with spaces around.

    The policies differ in where quotes may stand: around each piece ("fail"), anywhere ("neutral") or
    around the whole string ("drop"). Empty pieces are skipped except under "neutral".
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown vote policy {policy!r}, expected one of {POLICIES}")
    clean = F.translate(F.coalesce(raw, F.lit("")), _FROM, _TO)
    if policy == "neutral":
        pieces = F.split(F.replace(clean, F.lit('"'), F.lit("")), ",")
    elif policy == "drop":
        pieces = F.split(F.btrim(clean, F.lit('"')), ",")
    else:
        pieces = F.split(clean, ",")
        # A piece of blanks between quotes is malformed, one of blanks alone is empty.
        bare = lambda t: F.regexp_replace(F.btrim(F.trim(t), F.lit('"')), "^ +$", "x")
        pieces = F.when(F.contains(clean, F.lit('"')), F.transform(pieces, bare)).otherwise(pieces)
    if skip_empty is None:
        skip_empty = policy != "neutral"
    return F.filter(pieces, lambda t: F.trim(t) != "") if skip_empty else pieces


def parse_votes(raw: Column, policy: str = "drop", skip_empty: bool | None = None) -> Column:
    """``array<bigint>`` of votes in which a malformed piece is NULL, or an error under "fail".

    One cast of the whole array does the parsing: no per-element pattern match.
    """
    votes = vote_pieces(raw, policy, skip_empty).try_cast("array<bigint>")
    if policy != "fail":
        return votes
    error = F.raise_error(F.concat(F.lit("malformed vote in: "), raw)).cast("bigint")
    return F.transform(votes, lambda v: F.coalesce(v, error))


def has_malformed(votes: Column) -> Column:
    return F.exists(votes, lambda v: v.isNull())


def bucket_count(votes: Column, rule: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(votes, rule))


def vote_sum(votes: Column) -> Column:
    return F.aggregate(votes, F.lit(0).cast("bigint"), lambda acc, v: acc + F.coalesce(v, F.lit(0)))


def first_agreed(counts: Sequence[tuple[str, Column]], total: Column, min_agreement: float) -> Column:
    """First label, in the given order, whose share reaches ``min_agreement``; else NULL."""
    chosen = F.lit(None).cast("string")
    for label, n in reversed(counts):
        chosen = F.when(F.try_divide(n, total) >= min_agreement, F.lit(label)).otherwise(chosen)
    return chosen
