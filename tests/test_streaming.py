import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from agreelens.operators import annotation as A
from agreelens.operators import joins as J
from agreelens.operators import metrics as M
from agreelens.operators import responses as R
from agreelens.sources import tables
from agreelens.streaming import annotation as SA
from agreelens.streaming import deltas
from agreelens.streaming import evaluation as SE


def write_responses(folder, name, rows):
    lines = [
        json.dumps({"custom_id": c, "response": {"body": {"choices": [{"message": {"content": t}}]}}}) for c, t in rows
    ]
    (folder / name).write_text("\n".join(lines) + "\n\n")


def test_stream_equals_batch_over_several_files_and_restarts(spark, tmp_path):
    inbox, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    inbox.mkdir()
    words = ["E", "neutral", "C", "", "entailment"]
    gold = spark.createDataFrame(
        [(str(i), ["entailment", "neutral", "contradiction"][i % 3]) for i in range(40)], "item_id string, gold_label string"
    )
    for part in range(3):
        # Item 1 owns a third of the rows, as exact copies.
        rows = [(f"id{i if i % 3 else 1}_run1", words[i % 5 if i % 3 else 0]) for i in range(part * 20, part * 20 + 20)]
        write_responses(inbox, f"{part}.jsonl", rows)
        if part == 1:
            continue
        SE.run_confusion(SE.response_stream(spark, str(inbox), max_files=1), gold, out, checkpoint).awaitTermination()
        SE.compact(spark, out)
    batch = R.predictions(R.flatten_responses(tables.read_json_lines(spark, str(inbox), R.RESPONSE_SCHEMA)))
    expected = M.confusion_counts(R.match_gold(batch.select("item_id", "predicted_label"), gold))
    got = SE.latest_counts(spark, out).select("gold", "pred", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert sum(r["n"] for r in got.collect()) > 30


def test_annotation_stream_equals_batch(spark, tmp_path):
    inbox, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "annotator_id string, sample_id bigint, ts bigint, action string, labels string, comments string"
    rows = [
        (f"a{i % 3}", i % 7, (i * 37) % 101, ["save", "skip", "view"][i % 3 if i % 2 else 0], f"l{i}", f" c{i} " if i % 4 else None)
        for i in range(100)
    ]
    log = spark.createDataFrame(rows, schema)
    for part in range(3):
        log.filter(F.col("ts") % 3 == part).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        SA.run_to_table(SA.stream_state(stream), out, checkpoint).awaitTermination()
    got = sorted(map(str, SA.current_state(spark, out).collect()))
    assert got == sorted(map(str, A.latest_state(log).collect()))


def test_compaction_between_batches_and_restarts(spark, tmp_path):
    inbox, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "annotator_id string, sample_id bigint, ts bigint, action string, labels string, comments string"
    rows = [(f"a{i % 3}", i % 7, (i * 37) % 101, ["save", "skip"][i % 3 == 1], f"l{i}", None) for i in range(90)]
    log = spark.createDataFrame(rows, schema)

    def arrive(part):
        log.filter(F.col("ts") % 6 == part).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        SA.run_to_table(SA.stream_state(stream), out, checkpoint).awaitTermination()
        seen = A.latest_state(spark.read.schema(schema).parquet(inbox))
        assert sorted(map(str, SA.current_state(spark, out).collect())) == sorted(map(str, seen.collect()))

    arrive(0)
    first = SA.compact(spark, out)
    assert first and SA.compact(spark, out) is None
    # Every call is a restart of the stream from its checkpoint.
    arrive(1)
    arrive(2)
    through = deltas.last_commit(spark, out)[1]
    second = SA.compact(spark, out)
    assert deltas.last_commit(spark, out)[0] == second and deltas.last_commit(spark, out)[1] > through
    assert {p.rsplit("/", 2)[-2] for p in deltas.retired(spark, out)} == {"base", "deltas"}
    arrive(3)
    # A compaction that died before its commit leaves a folder that nobody reads.
    spark.range(1).select(F.lit("junk").alias("annotator_id")).write.parquet(f"{out}/base/half")
    # A batch that is replayed after a base contains it is not read again.
    replayed = spark.createDataFrame([("a0", 0, "wrong", None)], "annotator_id string, sample_id bigint, labels string, comments string")
    deltas.write_delta(replayed, out, 0)
    # A delta that is half written has no marker yet.
    replayed.write.parquet(f"{out}/deltas/batch_id=999")
    (Path(out) / "deltas" / "batch_id=999" / "_SUCCESS").unlink()
    arrive(4)
    for folder in deltas.retired(spark, out):
        shutil.rmtree(folder)
    arrive(5)


def test_no_batch_yet(spark, tmp_path):
    with pytest.raises(ValueError, match="no batch"):
        SA.current_state(spark, str(tmp_path / "none"))


def test_hot_items_alone_are_salted(spark):
    """One item owns a third of the rows; gold is copied for it and for no other."""
    n = 30_000
    item = F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 9973).cast("string"))
    preds = spark.range(0, n, 1, 8).select(item.alias("item_id"), F.lit("E").alias("p"))
    gold = spark.range(0, 9973, 1, 4).select(F.col("id").cast("string").alias("item_id"), F.lit("g").alias("g"))
    gold = gold.unionByName(spark.createDataFrame([("hot", "g")], "item_id string, g string"))
    hot = J.hot_keys(preds, "item_id", 0.01)
    assert hot == ["hot"]
    joined = J.splittable_join(preds, gold, ["item_id"], salts=16, hot=hot)
    assert joined.count() == n
    # The right side's rows after copying: one each, and sixteen of the hot one.
    generated = J.splittable_join(gold.withColumnRenamed("g", "x"), gold, ["item_id"], salts=16, hot=hot)
    assert generated.count() == 9974
    spread = preds.withColumn("_salt", F.pmod(F.xxhash64("item_id", "p") + F.spark_partition_id(), F.lit(16)))
    assert spread.filter("item_id = 'hot'").select("_salt").distinct().count() == 8
    text = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "hot" in text and "Generate explode" in text
    assert J.hot_keys(preds.filter("item_id <> 'hot'"), "item_id", 0.01) == [] and J.hot_keys(preds.limit(0), "item_id", 0.01) == []
