"""The operators of this folder over the given tables: thin queries with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agreelens.llm.common import table
from agreelens.llm.conversations import conversation_audits, damaged
from agreelens.llm.fill_middle import fill_in_middle, restore
from agreelens.llm.knn import exact_top_k
from agreelens.llm.line_dedup import remove_repeated_runs
from agreelens.llm.mixing import mix_sources
from agreelens.llm.near_dedup import near_duplicate_groups
from agreelens.llm.packing import pack_documents
from agreelens.llm.quality import quality_scores
from agreelens.llm.secrets import scan_secrets, written
from agreelens.llm.substrings import remove_repeats
from agreelens.llm.token_counts import token_counts
from agreelens.llm.toxicity import toxicity_scores
from agreelens.llm.url_filter import ALLOW, BLOCK, judge_urls

# Verdict, host and path of the URL rules.
URL_RULES = (
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
)

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), VOCABULARY)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), VOCABULARY, limit=2048)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    freed = remove_repeated_runs(table(spark, sf_dir, "documents"), min_lines=2)
    return freed.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), weights=(1, 2, 3), max_repeats=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = remove_repeats(table(spark, sf_dir, "documents"), window=13)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return parsed.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents")).drop("copy")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        "n_owned",
        "n_copied",
    )


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), k=5, query_every=50)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(table(spark, sf_dir, "documents"), plain_percent=10, spm_percent=20)
    return cut.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_audits(damaged(table(spark, sf_dir, "conversations")), present=F.col("present"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_line_dedup": op5_line_dedup,
    "op6_mixing": op6_mixing,
    "op7_substrings": op7_substrings,
    "op8_quality": op8_quality,
    "op9_secrets": op9_secrets,
    "op10_top_k": op10_top_k,
    "op11_fill_middle": op11_fill_middle,
    "op12_url_filter": op12_url_filter,
    "op13_conversations": op13_conversations,
}
