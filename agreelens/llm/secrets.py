"""Secret scanning with corpus-wide ownership of candidates. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agreelens.llm.common import staged

# Fixed patterns: the base kinds, in their order.
BASE = {
    "assign": (
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    ),
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
#: Least length of what is found (of group 2 for ``assign``).
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Further candidates: long runs that mix cases and digits. Only owner-specific ones become spans.
MIXED = "mixed"
MIXED_RUN = r"[A-Za-z0-9+/_-]{32,}"


def found(text: Column, pattern: str, value_group: int, kind: str, number: int, least: int, maybe: str) -> Column:
    """Matches as structs (start, number, end, kind, value); places come from the lengths of gaps and matches."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else matches
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("match"), values.alias("value"))
    empty = F.array().cast("array<struct<start:int,number:int,end:int,kind:string,value:string>>")

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["gap"])
        end = start + F.coalesce(F.length(piece["match"]), F.lit(0))
        hit = F.struct(
            start.alias("start"), F.lit(number).alias("number"), end.alias("end"), F.lit(kind).alias("kind"), piece["value"].alias("value")
        )
        good = F.coalesce(F.length(piece["value"]), F.lit(0)) >= least
        return F.struct(end.alias("at"), F.when(good, F.concat(state["hits"], F.array(hit))).otherwise(state["hits"]).alias("hits"))

    all_hits = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("hits")), step, lambda s: s["hits"])
    # Most texts hold no candidate: one cheap search spares them the rest.
    return F.when(text.rlike(maybe), all_hits).otherwise(empty)


def written(spans: Column) -> Column:
    text = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def scan_secrets(
    docs: DataFrame,
    max_owners: int = 2,
    max_repositories: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repository_col: str = "doc_id",
) -> DataFrame:
    """Secrets per document, with spans, and how widely each candidate is spread over the corpus.

    Base kinds (``BASE``) are always spans. Every candidate, base or ``mixed``, is hashed, and the distinct
    owners and repositories of each hash are counted over the whole corpus. A candidate of at most ``max_owners``
    owners and ``max_repositories`` repositories looks live: it is ``owned``, and a ``mixed`` one becomes a span. One that is spread
    wider is a copied example: it counts as ``copied``, and stays a span only if it is of a base kind.

    Returns ``doc_id, n_assign, n_access, n_hex, base_spans, spans, n_owned, n_copied``; spans are arrays of (start,
    number, end, kind) in code points, by start, then kind.

    Null and empty texts have none. A null owner or repository counts as one of its own; a null id stays null; repeated
    rows are scanned each, and count once for their owner and repository. Other columns are ignored. Long texts are
    scanned whole. An empty table gives an empty result. Distinct owners are counted in two steps, so a secret found
    in a third of all documents never meets in one task.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository_col).cast("string"), F.lit("")).alias("repository"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    text = F.col("text")
    # The least run a kind needs, for the cheap search.
    assign = found(text, BASE["assign"], 2, "assign", 0, LEAST["assign"], BASE["assign"])
    access = found(text, BASE["access"], 0, "access", 1, LEAST["access"], r"AKIA[A-Z0-9]{16}")
    hexes = found(text, r"[0-9a-f]{24,}", 0, "hex", 2, LEAST["hex"], r"[0-9a-f]{24}")
    mixed = F.filter(
        found(text, MIXED_RUN, 0, MIXED, 3, 32, MIXED_RUN),
        lambda s: s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]") & s["value"].rlike("[0-9]"),
    )
    hits = F.concat(assign, access, hexes, mixed)
    scanned = staged(rows.select("row", "doc_id", "owner", "repository", hits.alias("hits")), "secrets")

    each = scanned.select("row", "owner", "repository", F.explode("hits").alias("hit"))
    each = each.withColumn("key", F.sha2(F.col("hit.value"), 256))
    owners = each.select("key", "owner").distinct().groupBy("key").agg(F.count("*").alias("owners"))
    repositories = each.select("key", "repository").distinct().groupBy("key").agg(F.count("*").alias("repositories"))
    # Written first, so that both sides of the next join are read straight from a shuffle and a hot key's rows can be split.
    spread = staged(owners.join(repositories, "key"), "secret-spread")
    each = each.join(spread, "key")
    owned = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    added = F.when(owned & (F.col("hit.kind") == MIXED), F.col("hit"))
    judged = each.groupBy("row").agg(
        F.sum(owned.cast("long")).alias("n_owned"), F.sum((~owned).cast("long")).alias("n_copied"), F.collect_list(added).alias("added")
    )
    out = scanned.join(judged, "row", "left")
    base = F.filter("hits", lambda s: s["kind"] != MIXED)
    plain = "array<struct<start:int,number:int,end:int,kind:string>>"

    def without_value(spans: Column) -> Column:
        return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["number"], s["end"], s["kind"]))).cast(plain)

    def count(kind: str) -> Column:
        return F.size(F.filter("hits", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    everything = F.when(F.col("added").isNull(), base).otherwise(F.concat(base, F.col("added")))
    return out.select(
        "doc_id",
        *(count(k) for k in BASE),
        without_value(base).alias("base_spans"),
        without_value(everything).alias("spans"),
        F.coalesce("n_owned", F.lit(0)).cast("long").alias("n_owned"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )
