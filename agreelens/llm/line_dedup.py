"""Repeated runs of lines, by prefix doubling over the line sequences of all documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agreelens.llm.common import WORD, staged


def line_suffixes(docs: DataFrame, long_words: int | None = None) -> DataFrame:
    """One row per line with a word: its document, its place among such lines (``i``) and among all (``line``),
    its content as ``name``, ``pos``, which orders all suffixes of the corpus by id and place, and whether the line
    is ``long``: has more than ``long_words`` words."""
    lines = docs.select("doc_id", "copy", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    lines = lines.where(F.col("content").rlike(WORD))
    # Rows equal in id and text share their places.
    i = F.dense_rank().over(Window.partitionBy("doc_id", "copy").orderBy("line"))
    # Rows without an id stand behind all others.
    order = "coalesce(cast(doc_id as decimal(20,0)), 9223372036854775808BD)"
    pos = F.expr(f"cast({order} * 2147483648BD + line as decimal(38,0))")
    name = F.xxhash64(F.trim("content"))
    long = F.lit(False)
    if long_words is not None:
        # A line of so many words has at least as many characters, and blanks between them; most need no count.
        long = (F.length("content") > 2 * long_words) & (F.regexp_count("content", F.lit(WORD)) > long_words)
    return lines.select("doc_id", "copy", i.alias("i"), "line", pos.alias("pos"), name.alias("name"), long.alias("long"))


def doubled(ranks: DataFrame, have: int, step: int) -> DataFrame:
    """Ranks of prefixes of ``have`` lines to ranks of prefixes of ``have + step`` lines, ``step <= have``.

    The longer prefix is named by the pair of the ranks ``step`` lines apart. Its rank is the place of the first
    suffix that has it; prefixes that occur once get none, and play no part from then on.
    """
    ahead = Window.partitionBy("doc_id", "copy").orderBy("i").rangeBetween(step, step)
    pairs = ranks.withColumn("next", F.first("rank").over(ahead))
    both = F.col("rank").isNotNull() & F.col("next").isNotNull()
    classes = pairs.where(both).groupBy("rank", "next").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    # Written first, so the join deals both sides itself and can split a hot pair.
    classes = staged(classes.where("n > 1").select("rank", "next", "first"), "line-classes")
    columns = [c for c in ranks.columns if c != "rank"]
    return pairs.join(classes, ["rank", "next"], "left").select(*columns, F.col("first").alias("rank"))


def suffix_ranks(docs: DataFrame, depth: int, long_words: int | None = None) -> DataFrame:
    """Suffixes of line sequences ranked by their first ``depth`` lines; equal rank, equal prefix.

    Lengths double: 1, 2, 4, ... and a last, overlapping step to ``depth``. Lines that occur once in the corpus
    leave at the start, so later steps work on repeated lines only. The suffixes of one rank are one interval
    of the suffix array with a common prefix of at least ``depth`` lines. ``alone`` keeps what the ranks by one line
    say of long lines: the line is a later copy by itself.
    """
    suffixes = line_suffixes(docs, long_words)
    classes = suffixes.groupBy("name").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    classes = staged(classes.select("name", "first"), "line-classes")
    alone = F.col("long") & (F.col("first") < F.col("pos"))
    ranks = suffixes.join(classes, "name").select(
        "doc_id", "copy", "i", "line", "pos", alone.alias("alone"), F.col("first").alias("rank")
    )
    have = 1
    while have < depth:
        step = min(have, depth - have)
        ranks = staged(doubled(staged(ranks, "line-ranks"), have, step), "line-ranks")
        have += step
    return ranks


def remove_repeated_runs(
    docs: DataFrame, min_lines: int = 2, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = None
) -> DataFrame:
    """``docs`` with ``text_col`` freed of later copies of repeated line runs, and ``n_lines`` and ``n_removed``.

    A run of ``min_lines`` or more lines is a later copy if the same lines stand, in the same order, earlier in
    the corpus: under a smaller id, or higher up in the same text. The first copy stays. Lines are compared
    without blanks at their ends; lines without a word are passed over and stay. All suffixes that share ``min_lines`` lines
    with an earlier one are found, and the lines they cover together are the maximal repeated runs. With ``long_words``, a
    single line of more than so many words is a run too, whatever its neighbours; without it no single line is.

    A hot line is counted before it is shuffled, and its rows are joined to one row per rank, which Spark can
    split; no group is gathered. Content is compared by 64-bit hash.

    Null texts stay null with 0 lines. Rows without an id come last. Rows equal in id and text are one document and
    get the same result; of rows equal in id only, lines at the same place are not later than each other. Columns
    of ``docs`` stay as they are, whatever their names (but ``n_lines`` and ``n_removed`` are replaced). A
    text of any length is one row, split and joined once. An empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(
        F.struct(*(docs[c] for c in keep)).alias("row"),
        docs[id_col].cast("long").alias("doc_id"),
        docs[text_col].alias("text"),
        F.xxhash64(docs[text_col]).alias("copy"),
    )
    ranks = suffix_ranks(keyed.where("text is not null").select("doc_id", "copy", "text"), min_lines, long_words)
    later = F.max((F.col("rank").isNotNull() & (F.col("rank") < F.col("pos"))).cast("int"))
    behind = Window.partitionBy("doc_id", "copy").orderBy("i").rangeBetween(1 - min_lines, 0)
    gone = ranks.withColumn("gone", later.over(behind)).where("gone = 1 or alone")
    gone = gone.groupBy("doc_id", "copy").agg(F.sort_array(F.collect_list("line")).alias("gone"))
    out = keyed.join(
        gone.select(F.col("doc_id").alias("of"), F.col("copy").alias("which"), "gone"),
        F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("copy") == F.col("which")),
        "left",
    )
    out = out.withColumn("lines", F.split("text", "\n", -1))
    cuts = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("lines")))
    out = out.withColumn("cuts", cuts)
    between = F.expr(
        "flatten(transform(sequence(1, size(cuts) - 1), "
        "j -> slice(lines, cuts[j - 1] + 2, greatest(cuts[j] - cuts[j - 1] - 1, 0))))"
    )
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(between, "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter("lines", lambda x: x.rlike(WORD))))
    columns = [text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in keep]
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return out.select(*columns, n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"))

