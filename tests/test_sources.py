import csv
import json
import re

import pytest
from pyspark.sql import functions as F

from agreelens import session
from agreelens.functions.constants import VOTES_COLUMN
from agreelens.operators import prompts as PR
from agreelens.sources import checks, json_stream, sinks, tables
from agreelens.sources.row_index import first_rows, with_file_order, with_row_index

ROWS = [
    ["0", 'He said "no", then\nleft', "100% {sure}", "know", "3,2,1", "1.5"],
    ["1", "", "NA", "", "", "nan"],
    ["2", "comma, inside", " spaced ", "say", '"1,2"', ""],
]


@pytest.fixture()
def items_csv(tmp_path):
    path = tmp_path / "items.csv"
    with path.open("w", newline="") as f:
        csv.writer(f).writerows([["", "Context", "Target", "Verb", "Responses", "mean.noTarget"], *ROWS])
    return str(path)


def test_read_items(spark, items_csv):
    df = tables.read_items(spark, items_csv)
    assert df.columns == ["item_index", "Context", "Target", "Verb", VOTES_COLUMN, "mean.noTarget"]
    assert sorted(list(r) for r in df.collect()) == sorted(ROWS)


def test_read_by_position(spark, tmp_path):
    path = tmp_path / "p.csv"
    with path.open("w", newline="") as f:
        csv.writer(f).writerows([list("abcdefgh"), ["0", "x", "y", "z", "left", "right", "hyp", "1,1"]])
    with_header = tables.read_items_by_position(spark, str(path), include_header_row=True).collect()
    assert {(r["premise"], r["hypothesis"], r["votes_str"]) for r in with_header} == {
        ("left right", "hyp", "1,1"), ("e f", "g", "h"),
    }
    assert tables.read_items_by_position(spark, str(path)).count() == 1


def test_csv_round_trip_with_decimals(spark, items_csv, tmp_path):
    df = tables.read_items(spark, items_csv).withColumn("agreement", F.lit(2 / 3))
    out = str(tmp_path / "out")
    sinks.write_csv(df, out, decimals={"agreement": 6})
    back = tables.read_csv(spark, out)
    assert sorted(list(r)[:-1] for r in back.collect()) == sorted(ROWS)
    assert {r["agreement"] for r in back.collect()} == {"0.666667"}


def test_text_column(spark, tmp_path):
    (tmp_path / "t.csv").write_text('"one\ntwo"\nthree\n')
    assert sorted(r["text"] for r in tables.read_text_column(spark, str(tmp_path / "t.csv")).collect()) == ["one\ntwo", "three"]


def test_json_lines_partitioned(spark, tmp_path):
    df = spark.createDataFrame([("org/m", "a\n\"b\" %", None), ("org/n", "", "x")], "model string, text string, note string")
    named = df.withColumn("name", PR.request_name(F.col("model"), F.lit(0.0), F.lit(False)))
    sinks.write_json_lines(named, str(tmp_path / "j"), partition_by=["name"])
    folders = {p.name for p in (tmp_path / "j").iterdir() if p.is_dir()}
    assert folders == {"name=nli_prompt_org_m_temp0.0_no_reasoning", "name=nli_prompt_org_n_temp0.0_no_reasoning"}
    back = tables.read_json_lines(spark, str(tmp_path / "j"), "model string, text string, note string")
    assert sorted(map(str, back.drop("name").collect())) == sorted(map(str, df.collect()))


def test_json_lines_bad_rows(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n\n{broken\n')
    assert tables.read_json_lines(spark, str(tmp_path / "b.jsonl"), "a int", on_bad="drop").count() == 1
    with pytest.raises(Exception, match="[Mm]alformed"):
        tables.read_json_lines(spark, str(tmp_path / "b.jsonl"), "a int", on_bad="fail").collect()


def test_json_arrays(spark, tmp_path):
    df = spark.range(0, 10, 1, 3).withColumn("t", F.lit('x"]\n'))
    sinks.write_json_arrays(df, str(tmp_path / "a"))
    for part in (tmp_path / "a").glob("part-*"):
        assert isinstance(json.loads(part.read_text()), list)
    back = tables.read_json_array(spark, str(tmp_path / "a"), "id bigint, t string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    sinks.write_json_arrays(df.filter(F.hash("t") == F.col("id")), str(tmp_path / "empty"))
    assert all(json.loads(p.read_text()) == [] for p in (tmp_path / "empty").glob("part-*"))


def test_json_array_must_be_an_array(spark, tmp_path):
    (tmp_path / "o.json").write_text('\n  {"a": 1}\n')
    with pytest.raises(ValueError, match="JSON array"):
        tables.read_json_array(spark, str(tmp_path / "o.json"), "a int")


OBJECTS = [{"a": i, "t": "br{ace}\n}\n", "m.x": {"y": [1, 2]}} for i in range(20)]
SCHEMA = "a int, t string, `m.x` struct<y: array<int>>"


def indented(objects):
    return "".join(json.dumps(o, indent=1) + "\n" for o in objects)


@pytest.mark.parametrize("style", ["indented", "any"])
def test_json_objects(spark, tmp_path, style):
    (tmp_path / "s.jsonl").write_text(indented(OBJECTS))
    df = json_stream.read_json_objects(spark, str(tmp_path / "s.jsonl"), SCHEMA, style)
    rows = sorted(df.collect(), key=lambda r: r["a"])
    assert [r["a"] for r in rows] == list(range(20))
    assert all(r["t"] == "br{ace}\n}\n" and r["m.x"]["y"] == [1, 2] and r["_corrupt_record"] is None for r in rows)


def test_json_objects_without_final_newline_or_on_one_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(indented(OBJECTS[:2]).rstrip("\n"))
    assert json_stream.read_json_objects(spark, str(tmp_path / "a.jsonl"), SCHEMA, on_bad="fail").count() == 2
    (tmp_path / "b.jsonl").write_text('{"a": 1}{"a": 2} \n {"a":\n3}')
    got = json_stream.read_json_objects(spark, str(tmp_path / "b.jsonl"), "a int", style="any").collect()
    assert sorted(r["a"] for r in got) == [1, 2, 3]


def test_json_objects_damage(spark, tmp_path):
    good = [json.dumps({"a": i}, indent=1) for i in range(4)]
    (tmp_path / "d.jsonl").write_text("\n".join([good[0], good[1], '{\n "a": oops\n}', good[3]]) + "\n")
    (tmp_path / "e.jsonl").write_text(good[2] + "\n")
    read = lambda how, style="indented": json_stream.read_json_objects(
        spark, str(tmp_path), "a int", style, on_bad=how
    )
    assert read("null").filter("_corrupt_record is not null").count() == 1
    assert sorted(r["a"] for r in read("drop").collect()) == [0, 1, 2, 3]
    assert sorted(r["a"] for r in read("stop").collect()) == [0, 1, 2]
    assert sorted(r["a"] for r in read("stop", "any").collect()) == [0, 1, 2]
    with pytest.raises(Exception, match="damaged JSON object"):
        read("fail").collect()


def test_large_indented_file_is_split(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text(indented([{"a": i, "t": "x" * 50} for i in range(3000)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40KB")
    try:
        df = json_stream.read_json_objects(spark, str(tmp_path / "big.jsonl"), "a int, t string", on_bad="fail")
        assert df.rdd.getNumPartitions() > 3
        assert df.agg(F.count_distinct("a"), F.count("t")).head()[:] == (3000, 3000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pretty_writer_reads_back(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x\n}\ny")], "a int, t string")
    sinks.write_json_objects(df, str(tmp_path / "p"))
    back = json_stream.read_json_objects(spark, str(tmp_path / "p"), "a int, t string", on_bad="fail")
    assert sorted(tuple(r)[:2] for r in back.collect()) == [(1, None), (2, "x\n}\ny")]


def test_row_index_and_file_order(spark, tmp_path):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k"))
    assert all(r["k"] == r["row_id"] for r in with_row_index(df, ["k"]).collect())
    (tmp_path / "1.txt").write_text("".join(f"a{i}\n" for i in range(50)))
    (tmp_path / "2.txt").write_text("".join(f"b{i}\n" for i in range(500)))
    rows = with_file_order(spark.read.text(str(tmp_path))).orderBy("row_id").collect()
    assert [r["value"] for r in rows] == [f"a{i}" for i in range(50)] + [f"b{i}" for i in range(500)]
    assert [r["row_id"] for r in rows] == list(range(550))


def test_first_rows(spark):
    df = spark.range(100)
    assert first_rows(df, None, ["id"]).count() == 100
    assert [r["id"] for r in first_rows(df, 3, ["id"]).collect()] == [0, 1, 2]


def test_staged_tables_go_as_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_staged_root", lambda _: str(tmp_path / "root"))
    for purpose in ("a", "a", "b"):
        spark.range(3).write.parquet(session.shared_dir(spark, purpose))
    assert len(list((tmp_path / "root").glob("*/*"))) == 3
    assert session.remove_staged(spark) and not (tmp_path / "root").exists()
    assert not session.remove_staged(spark)


def test_json_objects_are_read_in_one_pass(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{\n  "a" : 1\n}\n{"a": 2}\r\n{"a": 3} {"a": 4}\n{\n  "a" : 5\n}\n')
    df = json_stream.read_json_objects(spark, str(tmp_path / "s.jsonl"), "a int", on_bad="fail")
    assert sorted(r["a"] for r in df.collect()) == [1, 2, 3, 4, 5]
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1


@pytest.mark.parametrize("n", [0, 1, 1500, 9_000, 10_000, 20_000])
def test_first_rows_selected_by_ranges(spark, n):
    # Half of all rows tie on the order column.
    df = spark.range(0, 10_000, 1, 8).select(F.when(F.col("id") % 2 == 0, 5000).otherwise(F.col("id")).alias("k"), F.col("id").alias("payload"))
    got = [r["k"] for r in first_rows(df, n, ["k"], in_one_task=0).collect()]
    want = sorted(5000 if i % 2 == 0 else i for i in range(10_000))[:n]
    assert sorted(got) == want


def test_first_rows_gather_no_large_part(spark):
    df = spark.range(0, 40_000, 1, 8).select(F.col("id").alias("k"))
    plan = first_rows(df, 36_000, ["k"], in_one_task=1000)
    assert plan.count() == 36_000
    limits = re.findall(r"(?:TakeOrderedAndProject|GlobalLimit|LocalLimit)\D*(\d+)", plan._jdf.queryExecution().executedPlan().toString())
    assert limits and all(int(x) < 2000 for x in limits)


def test_file_counts_and_provenance(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "b"))
    df = spark.read.parquet(str(tmp_path / "a"), str(tmp_path / "b"))
    rows = tables.file_counts(df).collect()
    assert sorted(r["row_count"] for r in rows[:2]) == [3, 5] and tuple(rows[2]) == (None, 8, 2)
    seen = tables.read_parquet(spark, str(tmp_path / "a"), provenance=True).head()["file_name"]
    assert seen.endswith(".parquet")


def test_checks(spark):
    df = spark.createDataFrame([("1", "x")], "`_c0` string, `My Responses` string")
    assert checks.resolve_column(df, "Reponses", ["reponses", "responses"]) == "My Responses"
    with pytest.raises(ValueError):
        checks.resolve_column(df, "absent", ["nothing"])
    assert checks.rename_unnamed_index(df).columns[0] == "item_index"
    with pytest.raises(ValueError, match="missing required columns: \\['b'\\]"):
        checks.require_columns(df, ["_c0", "b"])
    with pytest.raises(ValueError, match="no rows"):
        checks.require_rows(df.limit(0))
    assert checks.require_rows(df) is df
    added = checks.add_missing_columns(df, {"labels": "string", "_c0": "string"})
    assert added.columns == ["_c0", "My Responses", "labels"]


def test_prompts(spark):
    df = spark.createDataFrame([(0, "\n 50% {sure} ", " h\t"), (1, "  ", "h"), (2, None, "h")], "row_id int, premise string, hypothesis string")
    prompt = PR.add_prompt(df).filter("row_id = 0").head()["llm_prompt"]
    assert prompt.endswith("[CONTEXT]: 50% {sure}\n[HYPOTHESIS]: h\n\n[PREDICTION]:\n")
    requests = PR.chat_requests(df, "org/m", temperature=0.5, reasoning=True).collect()
    assert [r["custom_id"] for r in requests] == ["id0_run1"]
    body = requests[0]["body"].asDict(recursive=True)
    assert body["messages"][0]["content"].endswith("[CONTEXT]: \n 50% {sure} \n[HYPOTHESIS]:  h\t\n\n[PREDICTION]:")
    assert (body["model"], body["max_tokens"], body["reasoning"], body["temperature"]) == ("org/m", 100, {"enabled": True}, 0.5)
    cleaned = PR.prompt_input(spark.createDataFrame([(" a\n",), (None,)], "llm_prompt string")).collect()
    assert [r[0] for r in cleaned] == ["a", ""]


@pytest.mark.parametrize("on_bad", ["null", "fail", "stop"])
def test_default_style_loses_no_object(spark, tmp_path, on_bad):
    one_line = '{"a": 1}\n{"a": 2}\n{"a": 3}\n'
    indented = '{\n  "a": 4\n}\n{\n  "a": 5\n}\n'
    for i, text in enumerate((one_line, indented.replace("\n", "\r\n"), one_line + indented, indented + one_line)):
        path = tmp_path / f"{i}.json"
        path.write_bytes(text.encode())
        got = sorted(r["a"] for r in json_stream.read_json_objects(spark, str(path), "a int", on_bad=on_bad).collect())
        assert got == [[1, 2, 3], [4, 5], [1, 2, 3, 4, 5], [1, 2, 3, 4, 5]][i]


def test_row_index_holds_when_a_task_writes_many_files(spark):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    try:
        rows = with_row_index(spark.range(500).repartition(6), ["id"], "place").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert all(r["id"] == r["place"] for r in rows) and len(rows) == 500


def test_label_lookup_takes_the_last_of_repeated_ids(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "idx int")
    labels = spark.createDataFrame([(1, 7, "old"), (1, 9, "new"), (2, 1, "x"), (2, 2, None)], "idx int, row_id int, label string")
    got = tables.label_lookup(items, labels, order=["row_id"]).collect()
    assert sorted((r["idx"], r["label"] or "") for r in got) == [(1, "new"), (2, ""), (3, "")]


def test_objects_on_own_lines_are_told_apart_without_python(spark, tmp_path):
    texts = [
        ('{"a": 1}\n{"a": "}\\n{]"}\r\n{\n "a": [\n  {},\n  {}\n ]\n}', 3),
        ('{"a": 1}\n{\n"a": 2', None), ('{"a": 1}\n{"a": 2}] }', None), ('{"a": 1}\n{"a": 2},{} ] }', None), ('{"a": 1}\n{"a": 2} {"a": 3}', None),
        ("{\"a\": 1}\n{'a': 2}", None),
    ]
    df = spark.createDataFrame(texts, "text string, n int").withColumn("found", json_stream._on_own_lines(F.col("text")))
    for r in df.collect():
        assert (r["found"] and len(r["found"])) == r["n"], r["text"]
        assert r["found"] is None or [list(json.loads(o)) for o in r["found"]] == [["a"]] * r["n"]
    # What is left for Python does not go there in Arrow's batches of thousands of chunks.
    (tmp_path / "s.json").write_text('{"a": 1}\n{"a": 2} {"a": 3}\n{\n "a": 4\n}\n{"a": 5}\r\n{\n "a": 6\n}\n')
    read = json_stream.read_json_objects(spark, str(tmp_path / "s.json"), "a int", on_bad="fail")
    assert sorted(r["a"] for r in read.collect()) == [1, 2, 3, 4, 5, 6]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_json_arrays_leave_texts_in_arrow_buffers(spark, tmp_path, monkeypatch):
    df = spark.range(0, 700, 1, 3).select("id", F.when(F.col("id") % 5 > 0, F.repeat(F.lit("é😀,]\n"), F.col("id").cast("int"))).alias("t"))
    with_empty_task = df.filter((F.col("id") < 200) | (F.col("id") > 500))
    # No batch of texts becomes Python strings.
    monkeypatch.setattr(type(df), "mapInPandas", None)
    for name, most, source in (("a", "10000", df), ("b", "130", with_empty_task)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            sinks.write_json_arrays(source, str(tmp_path / name))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        parts = [json.loads(p.read_text()) for p in (tmp_path / name).glob("part-*")]
        assert len(parts) == 3 and sorted((r["id"], r["t"] or "") for part in parts for r in part) == sorted((r["id"], r["t"] or "") for r in source.collect())
