"""Registered queries: each takes ``(spark, sf_dir)`` and reads whole driver tables through ``views``."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import LABELS, LETTERS
from ..functions import votes as VF
from ..functions.labels import extract_label, item_id_from, normalize_gold
from ..operators import annotation as A
from ..operators import errstats as E
from ..operators import metrics as M
from ..operators import probes as P
from ..operators import prompts as PR
from ..operators import representations as RP
from ..operators import responses as R
from ..operators import scoring as S
from ..operators import summary as SU
from ..operators import votes as V
from ..session import shared_dir
from ..sources import json_stream, sinks, tables
from ..sources.row_index import first_rows, with_row_index
from ..streaming import annotation as stream_annotation
from ..streaming import evaluation as stream_evaluation
from . import views as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def tidy(df: DataFrame, digits: int = 8) -> DataFrame:
    """Wide integer and double types, doubles rounded, so that results compare across engines."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            col = col.cast("bigint")
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            # Adding zero turns a rounded -0.0 into 0.0.
            col = F.round(col.cast("double"), digits) + F.lit(0.0)
        out.append(col.alias(field.name))
    return df.select(*out)


# ------------------------------------------------------------------------------------ shared stages


def drop_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bucket_votes(V.parse_votes(W.items(spark, sf_dir), policy="drop"))


def well_formed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without a malformed vote; those without any vote stay, and reach no agreement."""
    parsed = V.parse_votes(W.items(spark, sf_dir), policy="neutral", skip_empty=True)
    return V.bucket_votes(parsed.filter(~F.col("votes_bad")))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, gold_label, entropy_class, verb, genre``."""
    return V.label_plurality(drop_parsed(spark, sf_dir)).select(
        F.col("item_id").cast("string").alias("item_id"), "gold_label", "entropy_class", "verb", "genre"
    )


def preds(spark: SparkSession, sf_dir: str, mode: str = "letter") -> DataFrame:
    return R.predictions(R.flatten_responses(W.responses(spark, sf_dir)), mode)


def joined(spark: SparkSession, sf_dir: str, mode: str = "letter") -> DataFrame:
    return R.match_gold(
        preds(spark, sf_dir, mode).select("run", "item_id", "predicted_label"),
        gold(spark, sf_dir).select("item_id", "gold_label", "entropy_class"),
        # Gold is an aggregate by item.
        unique=True,
    )


def counts(spark: SparkSession, sf_dir: str, keys: Sequence[str] = ("run",), mode: str = "letter") -> DataFrame:
    return M.confusion_counts(joined(spark, sf_dir, mode), keys=keys)


def error_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.add_error_flag(W.evaluated(spark, sf_dir))


def contingency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.contingency(error_table(spark, sf_dir), W.EVAL_CATEGORICAL)


def dense_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.logits_from_vectors(W.logit_vectors(spark, sf_dir), W.tokens(spark, sf_dir))


ANNOTATORS = 10


def annotation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latest_state(W.annotation_log(W.table(spark, sf_dir, "events")))


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    annotators = F.sequence(F.lit(0).cast("bigint"), F.lit(ANNOTATORS - 1).cast("bigint"))
    return A.sheets(W.samples(spark, sf_dir), annotation_state(spark, sf_dir), annotators)


def open_positions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Column]:
    """Labelled positions, annotators and number of samples, for resume and progress; no sheet is written out."""
    positions = with_row_index(W.samples(spark, sf_dir), ["sample_id"], "position")
    labelled = A.labelled_positions_of_log(W.annotation_log(W.table(spark, sf_dir, "events")), positions)
    annotators = spark.range(ANNOTATORS).select(F.col("id").alias("annotator_id"))
    return labelled, annotators, positions.agg(F.count(F.lit(1)).alias("n")).scalar()


def folded_layers(spark: SparkSession, sf_dir: str, order_by: str = "hash") -> DataFrame:
    reps = W.layers(spark, sf_dir)
    one_layer = reps.filter(F.col("layer") == 0)
    folds = P.fold_table(one_layer, P.fold_count(one_layer), order_by=order_by)
    return P.with_folds(reps, folds)


# ------------------------------------------------------------------------------------ sources, sinks


@register
def scan_items(spark, sf_dir):
    df = tables.read_parquet(spark, f"{sf_dir}/orders.parquet", provenance=True)
    return df.select("o_orderkey", "o_orderpriority", "o_orderstatus", "file_name")


@register
def row_ids(spark, sf_dir):
    return with_row_index(W.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"])


@register
def head_n(spark, sf_dir):
    return first_rows(W.items(spark, sf_dir), 250, ["item_id"])


@register
def file_counts(spark, sf_dir):
    paths = [f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet"]
    return tables.file_counts(spark.read.schema("doc_id bigint").parquet(*paths))


@register
def label_lookup(spark, sf_dir):
    docs = W.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return tidy(tables.label_lookup(docs, W.table(spark, sf_dir, "labels"), on="doc_id", label="quality"))


@register
def label_lookup_by_position(spark, sf_dir):
    docs = with_row_index(W.table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], "idx")
    labels = with_row_index(W.table(spark, sf_dir, "embeddings").select("vec_id", "label"), ["vec_id"], "idx")
    return tidy(tables.label_lookup(docs, labels))


def _texts(spark, sf_dir):
    return W.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")


def _fingerprint(df):
    return df.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "source", F.length("text").cast("bigint").alias("length"),
        F.md5("text").alias("text_md5"),
    )


@register
def label_lookup_repeats(spark, sf_dir):
    """Labels of which the last line of an order counts."""
    orders = W.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), "o_orderstatus")
    lines = W.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("idx"), (F.col("l_suppkey") % 3).alias("label"), "l_linenumber", "l_partkey", "l_suppkey"
    )
    return tidy(tables.label_lookup(orders, lines, order=["l_linenumber", "l_partkey", "l_suppkey"]))


@register
def head_large(spark, sf_dir):
    """Nine tenths of the items, of which no task gathers them all."""
    items = W.items(spark, sf_dir)
    return first_rows(items, items.count() * 9 // 10, ["item_id"], in_one_task=1000)


@register
def rt_positional(spark, sf_dir):
    """Items written as CSV under other names and read by position."""
    path = shared_dir(spark, "rt-positional")
    i = W.items(spark, sf_dir)
    cells = {"n0": "item_id", "n1": "genre", "n2": "genre", "n3": "genre", "p1": "verb", "p2": "genre", "h": "verb", "raw": "votes_str"}
    sinks.write_csv(i.select(*[F.col(c).cast("string").alias(n) for n, c in cells.items()]), path)
    read = tables.read_items_by_position(spark, path)
    return read.select(F.col("_c0").cast("bigint").alias("item_id"), "premise", "hypothesis", "votes_str")


@register
def rt_csv(spark, sf_dir):
    path = shared_dir(spark, "rt-csv")
    sinks.write_csv(_texts(spark, sf_dir), path)
    return _fingerprint(tables.read_csv(spark, path))


@register
def rt_json(spark, sf_dir):
    lines, arrays = shared_dir(spark, "rt-json"), shared_dir(spark, "rt-json")
    schema = "doc_id bigint, lang string, source string, text string"
    sinks.write_json_lines(_texts(spark, sf_dir), lines)
    sinks.write_json_arrays(tables.read_json_lines(spark, lines, schema), arrays)
    return _fingerprint(tables.read_json_array(spark, arrays, schema))


@register
def rt_jsonstream(spark, sf_dir):
    path = shared_dir(spark, "rt-jsonstream")
    sinks.write_json_objects(_texts(spark, sf_dir), path)
    schema = "doc_id bigint, lang string, source string, text string"
    return _fingerprint(json_stream.read_json_objects(spark, path, schema, on_bad="fail"))


@register
def rt_jsonstream_mixed(spark, sf_dir):
    """The same texts as objects over several lines, on one line, and with Windows line ends, in one stream."""
    path = shared_dir(spark, "rt-jsonstream-mixed")
    options = {"ignoreNullFields": "false"}
    indented, plain = F.to_json(F.struct("*"), options | {"pretty": "true"}), F.to_json(F.struct("*"), options)
    kind = F.col("doc_id") % 3
    line = F.when(kind == 0, indented).when(kind == 1, plain).otherwise(F.concat(plain, F.lit("\r")))
    _texts(spark, sf_dir).select(line.alias("value")).write.text(path)
    schema = "doc_id bigint, lang string, source string, text string"
    return _fingerprint(json_stream.read_json_objects(spark, path, schema, on_bad="fail"))


# ------------------------------------------------------------------------------------ votes


@register
def votes_parse(spark, sf_dir):
    raw = F.col("votes_str")
    lenient = VF.parse_votes(raw, "neutral")
    dropping = VF.parse_votes(raw, "drop")
    strict = VF.parse_votes(F.replace(raw, F.lit(",x"), F.lit("")), "fail")
    parsed = W.items(spark, sf_dir).select(
        "item_id", strict.alias("strict"), lenient.alias("lenient"), dropping.alias("dropping")
    )
    usable = ~VF.has_malformed(F.col("dropping")) & (F.size("dropping") > 0)
    return tidy(
        parsed.select(
            "item_id",
            F.size("strict").alias("strict_count"),
            VF.vote_sum(F.col("strict")).alias("strict_sum"),
            VF.has_malformed(F.col("lenient")).alias("lenient_bad"),
            F.size("lenient").alias("lenient_pieces"),
            usable.alias("kept"),
            F.when(usable, VF.vote_sum(F.col("dropping"))).alias("kept_sum"),
        )
    )


@register
def vote_buckets(spark, sf_dir):
    return tidy(V.bucket_shares(drop_parsed(spark, sf_dir)).drop("votes", "votes_bad"))


@register
def vote_buckets_long(spark, sf_dir):
    """Bucket counts straight from one row per vote."""
    return tidy(V.bucket_long_votes(W.long_votes(spark, sf_dir)))


@register
def label_threshold(spark, sf_dir):
    return tidy(V.label_threshold(well_formed(spark, sf_dir)).select("item_id", "gold_label", "agreement"))


@register
def label_mean_fallback(spark, sf_dir):
    parsed = V.bucket_votes(V.parse_votes(W.items(spark, sf_dir), policy="neutral"))
    return tidy(V.label_mean_fallback(parsed).select("item_id", "gold_label", "agreed"))


@register
def label_plurality(spark, sf_dir):
    return tidy(V.label_plurality(drop_parsed(spark, sf_dir)).select("item_id", "gold_label", "entropy_class"))


@register
def agreement_filter(spark, sf_dir):
    kept = V.keep_agreed(drop_parsed(spark, sf_dir))
    return tidy(kept.select("item_id", "verb", "genre", "gold_label", "vote_count", "agreement", "mean_vote"))


@register
def agreement_counts(spark, sf_dir):
    return tidy(V.agreement_counts(well_formed(spark, sf_dir), keys=["genre"]))


# ------------------------------------------------------------------------------------ prompts


@register
def prompts_llm(spark, sf_dir):
    return PR.add_prompt(W.pairs(spark, sf_dir)).select("conv_id", "turn", "llm_prompt")


@register
def prompts_chat(spark, sf_dir):
    keyed = W.pairs(spark, sf_dir).withColumn("row_id", F.col("conv_id") * (1 << 32) + F.col("turn"))
    requests = PR.chat_requests(keyed, model="some/model", max_tokens=100)
    message = F.col("body.messages")[0]
    return tidy(
        requests.select(
            "custom_id",
            F.col("body.model").alias("model"),
            message["role"].alias("role"),
            message["content"].alias("content"),
            F.col("body.max_tokens").alias("max_tokens"),
            F.col("body.reasoning.enabled").alias("reasoning"),
            F.col("body.temperature").alias("temperature"),
        )
    )


@register
def pair_text(spark, sf_dir):
    pairs = W.pairs(spark, sf_dir)
    return PR.join_premise(pairs, "premise", "hypothesis", "text", " [SEP] ").select("conv_id", "turn", "text")


# ------------------------------------------------------------------------------------ responses, joins


@register
def resp_flatten(spark, sf_dir):
    return R.flatten_responses(W.responses(spark, sf_dir)).select("custom_id", "content", "reasoning")


@register
def id_extract(spark, sf_dir):
    ids = W.responses(spark, sf_dir).select("custom_id").unionByName(
        W.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("custom_id"))
    )
    return ids.select("custom_id", item_id_from(F.col("custom_id")).alias("item_id"))


def _extracted(spark, sf_dir, mode):
    """Labels read from the chat responses and, as free text, from every conversation turn."""
    replies = R.flatten_responses(W.responses(spark, sf_dir)).select("custom_id", "content")
    turn_id = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("t"), F.col("turn").cast("string"))
    turns = W.table(spark, sf_dir, "conversations").select(turn_id.alias("custom_id"), F.col("text").alias("content"))
    return replies.unionByName(turns).select("custom_id", extract_label(F.col("content"), mode).alias("label"))


@register
def extract_letter(spark, sf_dir):
    return _extracted(spark, sf_dir, "letter")


@register
def extract_word(spark, sf_dir):
    return _extracted(spark, sf_dir, "word")


@register
def extract_letter_after_marker(spark, sf_dir):
    prompts = PR.add_prompt(W.pairs(spark, sf_dir))
    # Responses that echo the prompt, with every answer in turn and one without a label.
    answer = F.element_at(F.array(*map(F.lit, ("E", "N", "C", "?"))), (F.col("turn") % 4 + 1).cast("int"))
    answered = F.concat(F.col("llm_prompt"), F.lit(" "), answer)
    return prompts.select("conv_id", "turn", extract_label(answered, "letter_after_marker").alias("label"))


@register
def gold_dedupe(spark, sf_dir):
    """The last line of every order, as a gold table with repeated ids."""
    lines = W.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item_id"), "l_linenumber", "l_partkey", "l_suppkey"
    )
    return tidy(R.dedupe_gold(lines, order=["l_linenumber", "l_partkey", "l_suppkey"]))


@register
def eval_join(spark, sf_dir):
    return tidy(joined(spark, sf_dir))


@register
def eval_join_dup_gold(spark, sf_dir):
    """Predictions against gold with a row per order line, of which the last counts."""
    lines = W.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("item_id"),
        F.element_at(F.array(*map(F.lit, LABELS)), (F.col("l_partkey") % 3 + 1).cast("int")).alias("gold_label"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )
    predicted = preds(spark, sf_dir).select("run", "item_id", "predicted_label")
    matched = R.match_gold(predicted, lines, order=["l_linenumber", "l_partkey", "l_suppkey"])
    return tidy(matched.select("run", "item_id", "predicted_label", "gold_label"))


@register
def eval_join_salted(spark, sf_dir):
    return tidy(
        R.match_gold(
            preds(spark, sf_dir).select("run", "item_id", "predicted_label"),
            gold(spark, sf_dir).select("item_id", "gold_label", "entropy_class"),
            salts=4,
            unique=True,
        )
    )


@register
def eval_unmatched(spark, sf_dir):
    left = R.unmatched(preds(spark, sf_dir), gold(spark, sf_dir))
    return left.select("custom_id", "item_id", "predicted_label")


@register
def detailed_eval(spark, sf_dir):
    predicted = preds(spark, sf_dir, "word").select("custom_id", "item_id", "predicted_label", "content", "reasoning")
    return R.detailed_records(predicted, gold(spark, sf_dir), unique=True)


# ------------------------------------------------------------------------------------ metrics


@register
def accuracy_known(spark, sf_dir):
    report = M.classification_report(_letter_counts(spark, sf_dir), LETTERS)
    return tidy(
        report.select("num_examples", "num_with_gold", "unknown_prediction_count", "correct", "accuracy_known")
    )


@register
def accuracy_all(spark, sf_dir):
    report = M.classification_report(_letter_counts(spark, sf_dir), LETTERS)
    return tidy(report.select("num_examples", "accuracy_all"))


def _letter_counts(spark, sf_dir):
    """Logit-scored items, a part of which has no known gold label."""
    return M.confusion_counts(scored(spark, sf_dir), pred="prediction")


def scored(spark, sf_dir):
    df = dense_logits(spark, sf_dir)
    return S.scored_predictions(df, "raw_gold", S.legacy_convention(W.logit_vectors(spark, sf_dir), "code"))


@register
def pred_counts(spark, sf_dir):
    return tidy(M.prediction_counts(counts(spark, sf_dir, mode="word"), keys=["run"]))


@register
def label_dist(spark, sf_dir):
    return tidy(M.label_distribution(counts(spark, sf_dir), keys=["run"]))


def _report(spark, sf_dir):
    return M.classification_report(counts(spark, sf_dir), keys=["run"])


@register
def class_counts(spark, sf_dir):
    return tidy(M.per_class(_report(spark, sf_dir), ["run"]).select("run", "label", "tp", "fp", "fn", "support"))


@register
def class_prf(spark, sf_dir):
    classes = M.per_class(_report(spark, sf_dir), ["run"])
    return tidy(classes.select("run", "label", "precision", "recall", "f1", "support"))


@register
def f1_summary(spark, sf_dir):
    return tidy(
        _report(spark, sf_dir).select(
            "run", "num_examples", "correct", "accuracy_all", "macro_f1", "micro_precision", "micro_recall",
            "micro_f1", "weighted_f1",
        )
    )


@register
def confusion(spark, sf_dir):
    return tidy(M.confusion_matrix(counts(spark, sf_dir), keys=["run"]))


@register
def stratum_metrics(spark, sf_dir):
    by_stratum = counts(spark, sf_dir, keys=["run", "entropy_class"])
    keys = ["run", "entropy_class"]
    report = M.classification_report(by_stratum, keys=["run"], strata=SU.STRATA)
    head = [*keys, "num_examples", "correct", "accuracy_all", "macro_f1_present", "micro_f1"]
    return tidy(report.select(*head, F.inline("per_class")).drop("predicted"))


@register
def error_types(spark, sf_dir):
    by_stratum = counts(spark, sf_dir, keys=["run", "entropy_class"], mode="word")
    return tidy(M.error_types(by_stratum, ["run", "entropy_class"]))


@register
def error_types_top3(spark, sf_dir):
    keys = ["run", "entropy_class"]
    by_stratum = counts(spark, sf_dir, keys=keys, mode="word")
    return tidy(M.top_errors(M.error_types(by_stratum, keys), keys))


@register
def summary_json(spark, sf_dir):
    by_stratum = counts(spark, sf_dir, keys=["run", "entropy_class"], mode="word")
    return SU.evaluation_summary(by_stratum, keys=["run"], stratum="entropy_class")


@register
def summary_fields(spark, sf_dir):
    """Figures read back out of the summary documents."""
    paths = {
        "num_examples": ("$.num_examples", "bigint"),
        "accuracy": ("$.accuracy", "double"),
        "weighted_f1": ("$.weighted_f1", "double"),
        "f1_neutral": ("$.per_class_metrics.neutral.f1", "double"),
        "gold_contradiction": ("$.label_distribution.gold.contradiction", "bigint"),
        "low_total": ("$.entropy_breakdown.low_entropy.total", "bigint"),
        "high_accuracy": ("$.entropy_breakdown.high_entropy.accuracy", "double"),
        "high_errors_ent_unk": ("$.entropy_breakdown.high_entropy.errors['Gold:ENT -> Pred:UNK']", "bigint"),
    }
    fields = [F.get_json_object("summary", p).try_cast(t).alias(n) for n, (p, t) in paths.items()]
    return tidy(summary_json(spark, sf_dir).select("run", *fields))


def _numbers(leaves: DataFrame) -> DataFrame:
    """Leaves with their figures rounded; text leaves beside them."""
    number = F.col("value").try_cast("double")
    return tidy(leaves.select(*[c for c in leaves.columns if c != "value"], number.alias("number"), F.when(number.isNull(), F.col("value")).alias("text")))


@register
def summary_leaves(spark, sf_dir):
    """Every figure of the summary documents, with model and predictions file."""
    by_stratum = counts(spark, sf_dir, keys=["run", "entropy_class"], mode="word")
    name = F.concat(F.lit("run"), F.col("run").cast("string"), F.lit(".json"))
    documents = SU.evaluation_summary(by_stratum, keys=["run"], stratum="entropy_class", model="some/model", predictions_file=name)
    return _numbers(SU.leaves(documents, ["run"]))


@register
def run_summary_leaves(spark, sf_dir):
    return _numbers(SU.leaves(run_summary_json(spark, sf_dir)))


@register
def run_summary_json(spark, sf_dir):
    return SU.run_summary(_letter_counts(spark, sf_dir), model="dense-logits", batch_size=4, seed=7)


@register
def majority_class(spark, sf_dir):
    return tidy(M.majority_class(W.layers(spark, sf_dir), keys=["layer"]))


# ------------------------------------------------------------------------------------ logits, gold codes


@register
def gold_normalize(spark, sf_dir):
    codes = W.logit_vectors(spark, sf_dir)
    return codes.select(
        "item_id",
        normalize_gold(F.col("code"), "int", True).alias("int_legacy"),
        normalize_gold(F.col("code"), "int", False).alias("int_preferred"),
        normalize_gold(F.col("code").cast("string"), "string", True).alias("text_legacy"),
        normalize_gold(F.col("raw_gold"), "variant", True).alias("mixed_legacy"),
        normalize_gold(F.col("raw_gold"), "variant", False).alias("mixed_preferred"),
    )


@register
def label_convention(spark, sf_dir):
    return tidy(S.keyed_convention(W.table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 3).alias("split"),
        F.when(F.col("vec_id") % 3 == 0, F.col("label") % 4 - 1).when(F.col("vec_id") % 3 == 1, F.col("label") % 3)
        .otherwise(F.col("label") % 2).alias("label"),
    ), ["split"]))


@register
def label_tokens(spark, sf_dir):
    return tidy(S.label_tokens(W.tokens(spark, sf_dir)))


@register
def label_logits(spark, sf_dir):
    return tidy(S.logits_from_long(W.long_logits(spark, sf_dir), W.tokens(spark, sf_dir)))


@register
def label_logits_dense(spark, sf_dir):
    return tidy(dense_logits(spark, sf_dir).select("item_id", *[f"logit_{x}" for x in LETTERS]))


@register
def label_probs(spark, sf_dir):
    probs = S.label_probabilities(S.logits_from_long(W.long_logits(spark, sf_dir), W.tokens(spark, sf_dir)))
    return tidy(probs.select("item_id", *[f"prob_{x}" for x in LETTERS]))


@register
def label_argmax(spark, sf_dir):
    probs = S.label_probabilities(dense_logits(spark, sf_dir))
    return S.predict_label(probs).select("item_id", "prediction")


@register
def scored_predictions(spark, sf_dir):
    df = scored(spark, sf_dir)
    return tidy(
        df.select(
            "item_id",
            "prediction",
            *[F.col(f"label_logits.{x}").alias(f"logit_{x}") for x in LETTERS],
            *[F.col(f"label_probabilities.{x}").alias(f"prob_{x}") for x in LETTERS],
            "gold_label",
            "is_correct",
        )
    )


def length_scorer():
    """A stand-in model: logits from the text length. A real one would load its weights here."""

    def score(texts):
        lengths = np.array([len(t) for t in texts], dtype="float64")
        return np.stack([lengths % 5, lengths % 3, lengths % 2], axis=1)

    return score


@register
def batch_score_by_length(spark, sf_dir):
    """The same scores from batches of texts of like lengths."""
    prompts = PR.prompt_input(PR.add_prompt(W.pairs(spark, sf_dir)))
    scored_batches = S.score_batches(prompts, length_scorer, group_lengths=True)
    labelled = S.predict_label(S.label_probabilities(scored_batches))
    return tidy(labelled.select("conv_id", "turn", *[f"logit_{x}" for x in LETTERS], "prediction"))


@register
def batch_score(spark, sf_dir):
    prompts = PR.prompt_input(PR.add_prompt(W.pairs(spark, sf_dir)))
    scored_batches = S.score_batches(prompts, length_scorer)
    labelled = S.predict_label(S.label_probabilities(scored_batches))
    return tidy(labelled.select("conv_id", "turn", *[f"logit_{x}" for x in LETTERS], "prediction"))


# ------------------------------------------------------------------------------------ error statistics


@register
def error_flag(spark, sf_dir):
    return tidy(error_table(spark, sf_dir).select("doc_id", "is_correct", "error_flag"))


@register
def corr_numeric(spark, sf_dir):
    return tidy(E.numeric_correlations(error_table(spark, sf_dir), W.EVAL_NUMERIC))


@register
def corr_pvalue(spark, sf_dir):
    return tidy(E.with_correlation_p(E.numeric_correlations(error_table(spark, sf_dir), W.EVAL_NUMERIC)))


@register
def contingency(spark, sf_dir):
    return tidy(contingency_table(spark, sf_dir))


@register
def chi2(spark, sf_dir):
    return tidy(E.chi_square(contingency_table(spark, sf_dir)), 6)


@register
def chi2_pvalue(spark, sf_dir):
    return tidy(E.with_chi2_p(E.chi_square(contingency_table(spark, sf_dir))), 6)


@register
def cramers_v(spark, sf_dir):
    tests = E.with_cramers_v(E.chi_square(contingency_table(spark, sf_dir)))
    return tidy(tests.select("feature", "n", "cramers_v"), 6)


@register
def error_rate_by_cat(spark, sf_dir):
    return tidy(E.error_rates(contingency_table(spark, sf_dir)))


@register
def error_rate_top(spark, sf_dir):
    return tidy(E.ranked_error_rates(E.error_rates(contingency_table(spark, sf_dir))))


@register
def correlation_report(spark, sf_dir):
    table = contingency_table(spark, sf_dir)
    tests = E.with_cramers_v(E.with_chi2_p(E.chi_square(table)))
    correlations = E.with_correlation_p(E.numeric_correlations(error_table(spark, sf_dir), W.EVAL_NUMERIC))
    return SU.correlation_summary(correlations, tests, E.error_rates(table))


@register
def correlation_leaves(spark, sf_dir):
    """Every figure of the report, with the value that it belongs to where there is one."""
    report = correlation_report(spark, sf_dir).withColumn("value_of", F.get_json_object("entry", "$.value"))
    found = _numbers(SU.leaves(report, ["section", "feature", "value_of"], "entry"))
    return found.filter("path <> '$.value'").select("section", "feature", "value_of", "path", F.round("number", 6).alias("number"))


# ------------------------------------------------------------------------------------ probes


@register
def probe_input(spark, sf_dir):
    kept = V.keep_agreed(drop_parsed(spark, sf_dir))
    named = kept.select(
        "item_id", F.col("genre").alias("Context"), F.col("verb").alias("Target"), "gold_label",
        F.when(F.col("verb") != "5-LOW", F.col("verb")).alias("Verb"),
    )
    return tidy(P.probe_input(named, order=["item_id"]).select("item_id", "text", "label", "group"))


@register
def probe_folds(spark, sf_dir):
    return tidy(folded_layers(spark, sf_dir, order_by="group").select("item_id", "layer", "group", "label", "fold"))


@register
def probe_folds_balanced(spark, sf_dir):
    """Folds for groups of unlike size, one of which owns a third of the items."""
    one_layer = W.layers(spark, sf_dir).filter("layer = 0").drop("vec")
    skewed = one_layer.withColumn("group", F.when(F.col("item_id") % 3 == 0, 0).otherwise(F.col("item_id") % 50).cast("int"))
    folds = P.balanced_fold_table(skewed, 5, order_by="group")
    counted = P.with_folds(skewed, folds).groupBy("group", "fold", "label").agg(F.count(F.lit(1)).alias("n"))
    return tidy(counted)


def _length_encoder():
    """A stand-in model of three layers of two numbers, from the text length."""

    def encode(texts):
        n = np.array([len(t) for t in texts], dtype="float64")
        return np.stack([f for i in (2, 3, 4) for f in (n % i, n // i % 11)], axis=1).astype("float32")

    return encode


@register
def probe_representations(spark, sf_dir):
    """Representations of documents, staged once, and joined to labels and groups where they lie."""
    texts = W.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    reps = S.layer_representations(texts, _length_encoder, layers=3)
    name = f"representations_{uuid.uuid4().hex}"
    RP.stage_representations(reps, name, buckets=8)
    items = W.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("group"))
    labels = W.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").alias("label"))
    joined = RP.labelled_representations(spark, name, items.join(labels, "item_id"))
    return tidy(joined.select("item_id", "layer", F.col("vec")[0].alias("first"), F.col("vec")[1].alias("second"), "label", "group"))


@register
def probe_gradient(spark, sf_dir):
    """The gradient of every layer's objective at its fit: zero where the fit is the optimum, which is unique."""
    reps = W.layers(spark, sf_dir)
    fitted = P.probe_parameters(spark, P.final_probes(reps)).filter("weights is not null")
    return tidy(P.gradient_at(reps, fitted), 5)


@register
def probe_oof(spark, sf_dir):
    return P.out_of_fold(folded_layers(spark, sf_dir))


@register
def probe_report(spark, sf_dir):
    return P.probe_report(P.out_of_fold(folded_layers(spark, sf_dir)), classes=[0, 1, 2])


@register
def probe_final(spark, sf_dir):
    return P.probe_parameters(spark, P.final_probes(W.layers(spark, sf_dir)))


# ------------------------------------------------------------------------------------ annotation


@register
def annot_state(spark, sf_dir):
    return tidy(sheet(spark, sf_dir)).orderBy("annotator_id", "sample_id")


@register
def annot_resume(spark, sf_dir):
    return tidy(A.resume_positions(*open_positions(spark, sf_dir)))


@register
def annot_progress(spark, sf_dir):
    return tidy(A.progress_by_annotator(*open_positions(spark, sf_dir)))


@register
def annot_export(spark, sf_dir):
    """One annotator's sheet written as CSV and read back."""
    path = shared_dir(spark, "annot-export")
    own = sheet(spark, sf_dir).filter(F.col("annotator_id") == 3).select("sample_id", "labels", "comments")
    sinks.write_csv(own, path)
    return tidy(tables.read_csv(spark, path, keep_empty=False).withColumn("sample_id", F.col("sample_id").cast("bigint")))


@register
def annot_labels(spark, sf_dir):
    options = ("purchase", "click", "signup")
    return tidy(A.option_counts(sheet(spark, sf_dir), options, keys=["annotator_id"]))


# ------------------------------------------------------------------------------------ streams


@register
def stream_confusion(spark, sf_dir):
    """The orders file as a stream of responses against static gold."""
    source = W.table(spark, sf_dir, "orders").schema
    stream = spark.readStream.schema(source).parquet(f"{sf_dir}/orders*.parquet")
    out, checkpoint = shared_dir(spark, "stream"), shared_dir(spark, "stream-checkpoint")
    # Gold is built once, not in every trigger.
    built, gold_dir = gold(spark, sf_dir), shared_dir(spark, "stream-gold")
    built.write.parquet(gold_dir)
    static = spark.read.schema(built.schema).parquet(gold_dir)
    live = W.response_columns(stream)
    stream_evaluation.run_confusion(live, static, out, checkpoint, keys=["run"]).awaitTermination()
    return tidy(stream_evaluation.latest_counts(spark, out))


@register
def stream_annot(spark, sf_dir):
    """The events file as a stream of annotation log rows."""
    source = W.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(source).parquet(f"{sf_dir}/events*.parquet")
    out, checkpoint = shared_dir(spark, "stream"), shared_dir(spark, "stream-checkpoint")
    live = stream_annotation.stream_state(W.annotation_log(stream))
    stream_annotation.run_to_table(live, out, checkpoint).awaitTermination()
    return tidy(stream_annotation.current_state(spark, out))


@register
def stream_annot_compacted(spark, sf_dir):
    """The same state out of a compacted base."""
    source = W.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(source).parquet(f"{sf_dir}/events*.parquet")
    out, checkpoint = shared_dir(spark, "stream"), shared_dir(spark, "stream-checkpoint")
    live = stream_annotation.stream_state(W.annotation_log(stream))
    stream_annotation.run_to_table(live, out, checkpoint).awaitTermination()
    stream_annotation.compact(spark, out)
    return tidy(stream_annotation.current_state(spark, out))
