"""From raw documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agreelens.llm.common import WORD, staged, table
from agreelens.llm.line_dedup import remove_repeated_runs
from agreelens.llm.mixing import mix_documents
from agreelens.llm.near_dedup import near_duplicate_groups
from agreelens.llm.packing import pack_documents
from agreelens.llm.quality import quality_scores
from agreelens.llm.queries import VOCABULARY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the label model, or a base limit, rejects go; rows are told apart by id and text.

    Null and empty texts go. Repeated rows and rows without an id are judged like others.
    """
    good = quality_scores(docs).where("kept").select(F.col("doc_id").alias("of"), F.col("copy").alias("which")).distinct()
    same = docs["doc_id"].eqNullSafe(good["of"]) & (F.xxhash64(docs["text"]) == good["which"])
    return docs.join(good, same, "left_semi")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of two or more lines, and of single lines of over 50 words, go, and documents of which nothing is left.

    Texts that lose nothing stay as they are, null and empty ones too; ``n_chars`` follows the text where it changes.
    """
    # The operator's own counts must not replace columns of these names.
    own = {c: f"{c} of docs" for c in ("n_lines", "n_removed") if c in docs.columns}
    freed = remove_repeated_runs(docs.withColumnsRenamed(own), min_lines=2, long_words=50)
    freed = freed.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    freed = freed.withColumn("n_chars", changed.cast("long"))
    return freed.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Of rows equal in id and text one stays (the first by source). Rows of one id are one document: it goes whole if any
    of its texts is a near copy of a text under a smaller id. Rows without an id, and texts without words, all stay.
    """
    gone = near_duplicate_groups(docs, shingle=5, percent=80).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("row"),
        docs["doc_id"].alias("id"),
        F.xxhash64(docs["text"]).alias("copy"),
        # Rows without an id are each on their own, and so spread over all tasks.
        F.when(docs["doc_id"].isNull(), F.monotonically_increasing_id()).alias("alone"),
    )
    left = rows.join(gone, rows["id"] == gone["gone"], "left_anti")
    equal = F.row_number().over(Window.partitionBy("id", "copy", "alone").orderBy("row.source"))
    return left.withColumn("equal", equal).where("equal = 1").select("row.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: documents stand in it as often, and as far, as their source's quota takes them.

    Null and empty texts, which no quota takes, leave; a null source is a source; ``n_chars`` is that of the text.
    """
    return mix_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of 4,096 token ids, one row per piece; a null or empty text is its end id alone."""
    return pack_documents(docs, VOCABULARY)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("source mix", source_mix),
    ("packing", packing),
]

#: The tokenizer and the label model are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
