"""Shapes of physical plans: what is shuffled, how often tables are read, where Python runs."""

import re

import pytest
from pyspark.sql import functions as F

from agreelens.functions import votes as VF
from agreelens.operators import metrics as M
from agreelens.operators import summary as SU
from agreelens.operators import votes as V
from agreelens.plans import catalog as C
from agreelens.plans import views as W

# Operators that run user models or tail probabilities in Python, and sinks and indexers that stage data.
PYTHON = {"batch_score", "batch_score_by_length", "correlation_leaves", "corr_pvalue", "chi2_pvalue", "correlation_report"}
STAGED = {
    "row_ids", "label_lookup_by_position", "rt_csv", "rt_json", "rt_jsonstream", "rt_jsonstream_mixed", "probe_folds", "probe_oof",
    "probe_report", "probe_final", "stream_confusion", "stream_annot", "stream_annot_compacted", "probe_gradient",
    "probe_folds_balanced", "probe_representations", "head_large", "annot_export", "annot_progress", "annot_resume", "rt_positional",
}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange hashpartitioning", plan_of(df)))


@pytest.mark.parametrize("key", sorted(set(C.QUERIES) - PYTHON - STAGED))
def test_no_python_and_no_single_partition_window(spark, sf_dir, key):
    text = plan_of(C.QUERIES[key](spark, sf_dir))
    assert "EvalPython" not in text and "MapInPandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"Window[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", text)


@pytest.mark.parametrize("policy", VF.POLICIES)
def test_vote_labels_need_no_shuffle(spark, tmp_path, policy):
    spark.createDataFrame([("1,2",)], "votes_str string").write.parquet(str(tmp_path / "v"))
    df = V.bucket_votes(V.parse_votes(spark.read.parquet(str(tmp_path / "v")), policy=policy))
    for operator in (V.label_threshold, V.label_plurality, V.label_mean_fallback):
        text = plan_of(operator(df))
        assert "Exchange" not in text
        # The string is split once, although the filter, four counts and several labels read the array.
        assert text.count("split(") == 1 + (policy == "fail")


def test_report_adds_one_small_shuffle_to_the_counts(spark, sf_dir):
    joined = C.joined(spark, sf_dir)
    counts = M.confusion_counts(joined, keys=["run", "entropy_class"])
    base = shuffles(counts)
    assert base == shuffles(joined) + 1
    assert shuffles(M.classification_report(counts, keys=["run"], strata=SU.STRATA)) == base + 1
    assert shuffles(SU.evaluation_summary(counts, keys=["run"], stratum="entropy_class")) == base + 1


@pytest.mark.parametrize("key", ["summary_json", "stratum_metrics", "f1_summary"])
def test_tables_are_read_once_per_role(spark, sf_dir, key):
    text = plan_of(C.QUERIES[key](spark, sf_dir))
    # Votes come from lineitem; orders holds both item features and responses.
    assert len(re.findall(r"FileScan parquet [^\n]*lineitem", text)) == 1
    assert len(re.findall(r"FileScan parquet [^\n]*orders", text)) == 2


def test_chi_square_reads_the_data_once(spark, sf_dir):
    df = C.chi2(spark, sf_dir)
    df.collect()
    text = plan_of(df).split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet [^\n]*documents", text)) == 1
    assert "ReusedExchange" in text


def test_scans_are_pruned(spark, sf_dir):
    text = plan_of(C.contingency(spark, sf_dir))
    documents = re.search(r"FileScan parquet[^\n]*documents[^\n]*", text).group(0)
    assert "text" not in re.search(r"ReadSchema: (.*)", documents).group(1)
    text = plan_of(W.long_votes(spark, sf_dir).filter(F.col("item_id") > 5))
    assert "GreaterThan(l_orderkey,5)" in text and "l_comment" not in text


def test_top_errors_limit_before_the_shuffle(spark):
    errors = spark.createDataFrame([("a", "x", 1)], "run string, error_type string, n bigint")
    assert "WindowGroupLimit" in plan_of(M.top_errors(errors, ["run"]))


def test_long_logits_are_filtered_without_a_join(spark, sf_dir):
    main_query = plan_of(C.label_logits(spark, sf_dir)).split("Subqueries")[0]
    assert "Join" not in main_query


def test_dense_logits_do_not_shuffle_items(spark, sf_dir):
    main_query = plan_of(C.dense_logits(spark, sf_dir)).split("Subqueries")[0]
    assert "hashpartitioning" not in main_query


def test_annotation_queries_write_no_sheet_and_sort_no_log(spark, sf_dir):
    for key in ("annot_resume", "annot_progress"):
        text = plan_of(C.QUERIES[key](spark, sf_dir))
        # The ten annotators are a range; samples are never multiplied by them.
        assert "NestedLoopJoin" not in text and "SortAggregate" not in text


def test_gold_is_deduplicated_without_sorting_rows(spark, sf_dir):
    for key in ("gold_dedupe", "annot_state", "eval_join_dup_gold", "label_lookup_repeats"):
        assert "SortAggregate" not in plan_of(C.QUERIES[key](spark, sf_dir))


def test_representations_are_not_shuffled(spark, sf_dir):
    df = C.probe_representations(spark, sf_dir)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_of(C.probe_representations(spark, sf_dir))
        side = re.search(r"FileScan parquet spark_catalog[^\n]*", text)
        assert side and "Bucketed: true" in side.group(0)
        # From the scan of the representations up to the join there is no exchange.
        lines = text.split("\n")
        at = next(i for i, line in enumerate(lines) if "spark_catalog" in line)
        above = [line for line in lines[:at] if len(line) - len(line.lstrip(" :+-")) < len(lines[at]) - len(lines[at].lstrip(" :+-"))]
        assert df.count() > 0 and not any("Exchange" in line for line in above[-3:])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
