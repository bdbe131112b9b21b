import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from agreelens.operators import probes as P
from agreelens.operators import softmax_fit
from agreelens.sources.tables import read_csv


def reps(spark, n=60, classes=3, layers=2, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        label = i % classes
        for layer in range(layers):
            vec = (rng.normal(size=3) + np.eye(3)[label % 3] * 3 * layer).tolist()
            rows.append((f"i{i}", layer, vec, label, f"g{i % 11}"))
    return spark.createDataFrame(rows, "item_id string, layer int, vec array<float>, label int, `group` string")


def test_fold_invariants(spark):
    df = reps(spark, n=200, layers=1)
    k = P.fold_count(df)
    assert k == 5
    folded = P.with_folds(df, P.fold_table(df, k))
    assert folded.count() == 200
    assert folded.groupBy("group").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    sizes = [r["count"] for r in folded.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) <= 3 * min(sizes)
    again = P.with_folds(df, P.fold_table(df.repartition(7), k))
    assert sorted(map(str, again.select("item_id", "fold").collect())) == sorted(map(str, folded.select("item_id", "fold").collect()))


def test_fold_count_and_seed(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], "`group` string, label int")
    assert P.fold_count(df) == 3
    assert P.fold_count(df.filter("`group` = 'a'")) == 2
    many = spark.range(300).select(F.col("id").cast("string").alias("group"), (F.col("id") % 2).cast("int").alias("label"))
    one, two = (P.fold_table(many, 5, seed=s).orderBy("group").collect() for s in (1, 2))
    assert one != two
    stratified = many.join(P.fold_table(many, 5), "group").groupBy("fold", "label").count().collect()
    assert {r["count"] for r in stratified} == {30}


def test_out_of_fold_and_report(spark):
    df = reps(spark, n=90)
    oof = P.out_of_fold(P.with_folds(df, P.fold_table(df.filter("layer = 0"), 3)))
    rows = oof.collect()
    assert len(rows) == 180 and len({(r["item_id"], r["layer"]) for r in rows}) == 180
    assert all(sum(r["probabilities"]) == pytest.approx(1) and len(r["probabilities"]) == 3 for r in rows)
    assert all(r["prediction"] == int(np.argmax(r["probabilities"])) for r in rows)
    report = {r["layer"]: r for r in P.probe_report(oof, [0, 1, 2]).collect()}
    assert report[1]["accuracy"] > 0.85 > report[0]["accuracy"]


def test_missing_and_single_classes(spark):
    rows = [("a", 0, 0, 0), ("b", 0, 1, 2), ("c", 0, 1, 2), ("d", 0, 0, 0), ("e", 0, 2, 1)]
    df = spark.createDataFrame(rows, "item_id string, layer int, fold int, label int").withColumn(
        "vec", F.array(F.col("label").cast("float"), F.lit(1.0).cast("float"))
    )
    got = {r["item_id"]: r for r in P.out_of_fold(df).collect()}
    # Fold 2 holds the only item of class 1: its training rows know classes 0 and 2.
    assert got["e"]["prediction"] in (0, 2) and got["e"]["probabilities"][1] is None
    one_class = df.filter("label = 0 or fold = 1")
    got = {r["item_id"]: r for r in P.out_of_fold(one_class).collect()}
    assert got["b"]["prediction"] == 0 and got["b"]["probabilities"] == [1.0, 0.0]


def newton(x, y, k, c=1.0):
    """Multinomial logistic regression with an unpenalised intercept, by Newton steps on dense arrays."""
    n, d = x.shape
    xb = np.hstack([x, np.ones((n, 1))])
    w = np.zeros((k, d + 1))
    penalty = np.tile(np.r_[np.ones(d), 1e-9], k)
    for _ in range(60):
        z = xb @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = c * (p - np.eye(k)[y]).T @ xb + penalty.reshape(k, -1) * w
        h = np.zeros((k * (d + 1),) * 2)
        for a in range(k):
            for b in range(k):
                r = p[:, a] * ((a == b) - p[:, b])
                h[a * (d + 1) : (a + 1) * (d + 1), b * (d + 1) : (b + 1) * (d + 1)] = c * (xb * r[:, None]).T @ xb
        h += np.diag(penalty)
        w -= np.linalg.solve(h, g.ravel()).reshape(k, -1)
    return w


def test_final_probe_matches_the_dense_solution_and_saves(spark, tmp_path):
    df = reps(spark, n=60, layers=1, seed=3)
    probes = P.final_probes(df, save_to=str(tmp_path))
    local = df.orderBy("item_id").collect()
    w = newton(np.array([r["vec"] for r in local]), np.array([r["label"] for r in local]), 3)
    got = probes[0].model.coefficientMatrix.toArray()
    assert np.allclose(got - got.mean(0), (w - w.mean(0))[:, :3], atol=1e-6)
    assert np.allclose(probes[0].weights - probes[0].weights.mean(0), w - w.mean(0), atol=1e-6)
    assert LogisticRegressionModel.load(str(tmp_path / "layer_0_clf")).numClasses == 3
    table = P.probe_parameters(spark, probes).collect()
    assert [r["label"] for r in table] == [0, 1, 2] and len(table[0]["weights"]) == 3


def binary_newton(x, y, c=1.0):
    """Two classes: one row of weights, that of the second class."""
    xb = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(xb.shape[1]), np.r_[np.ones(x.shape[1]), 1e-12]
    for _ in range(60):
        p = 1 / (1 + np.exp(-xb @ w))
        w -= np.linalg.solve(c * (xb * (p * (1 - p))[:, None]).T @ xb + np.diag(penalty), c * xb.T @ (p - y) + penalty * w)
    return w


@pytest.mark.parametrize("classes, max_hessian", [(2, 1000), (3, 1000), (4, 1000), (2, 0), (3, 0)])
def test_out_of_fold_matches_dense_solutions(spark, monkeypatch, classes, max_hessian):
    """Newton steps, and the quasi-Newton steps that wide vectors take."""
    monkeypatch.setattr(softmax_fit, "MAX_HESSIAN", max_hessian)
    df = reps(spark, n=90, classes=classes, layers=2, seed=classes).withColumn("fold", (F.crc32("group") % 3).cast("int"))
    rows = df.collect()
    got = {(r["item_id"], r["layer"]): r["probabilities"] for r in P.out_of_fold(df, c=0.5).collect()}
    worst = 0.0
    for layer in (0, 1):
        own = [r for r in rows if r["layer"] == layer]
        x, y, f = np.array([r["vec"] for r in own]), np.array([r["label"] for r in own]), np.array([r["fold"] for r in own])
        for fold in set(f.tolist()):
            held = np.hstack([x[f == fold], np.ones(((f == fold).sum(), 1))])
            if classes == 2:
                z = held @ binary_newton(x[f != fold], y[f != fold], 0.5)
                want = np.stack([1 / (1 + np.exp(z)), 1 / (1 + np.exp(-z))], axis=1)
            else:
                z = held @ newton(x[f != fold], y[f != fold], classes, 0.5).T
                want = np.exp(z) / np.exp(z).sum(1, keepdims=True)
            for r, p in zip([r for r in own if r["fold"] == fold], want):
                worst = max(worst, np.abs(np.array(got[r["item_id"], layer]) - p).max())
    assert worst < (1e-6 if max_hessian else 1e-4)


def test_passes_do_not_grow_with_layers_and_folds(spark):
    passes = []
    for layers, folds in ((1, 2), (6, 5)):
        df = reps(spark, n=80, layers=layers).withColumn("fold", (F.crc32("group") % folds).cast("int")).withColumn("layer", F.col("layer").cast("int"))
        staged = P._stage(df)
        sizes, widths = P._sizes(staged)
        problems = [softmax_fit.Problem(k, f, (0, 1, 2), 1, widths[k]) for k in sizes for f in sizes[k]]
        softmax_fit.solve(staged, problems)
        assert not any(q.open for q in problems)
        passes.append(max(q.passes for q in problems))
    # Thirty problems, of which the layers far apart take longest, need no more passes than the slowest of them.
    assert passes[0] < 10 and passes[1] < 15


def test_separable_rows_converge(spark):
    rows = [(f"i{i}", 0, [float(i + 5 * (i >= 10))], int(i >= 10), i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "item_id string, layer int, vec array<double>, label int, fold int")
    got = P.out_of_fold(df, c=1e4).collect()
    assert all(r["prediction"] == r["label"] for r in got)


def test_vectors_of_unlike_width_stop_the_job(spark):
    rows = [("a", 0, [1.0, 2.0], 0, 0), ("b", 0, [1.0], 1, 0), ("c", 0, [1.0, 2.0], 1, 1)]
    df = spark.createDataFrame(rows, "item_id string, layer int, vec array<double>, label int, fold int")
    with pytest.raises(Exception, match="must all have 2 numbers"):
        P.out_of_fold(df).collect()


def shares(df, folds):
    counted = P.with_folds(df, folds).groupBy("fold", "label").count().collect()
    total = {}
    for r in counted:
        total[r["label"]] = total.get(r["label"], 0) + r["count"]
    return {(r["fold"], r["label"]): r["count"] / total[r["label"]] for r in counted}


def test_balanced_folds_with_one_group_of_a_third(spark):
    """All groups in the first round: no other fold has over an equal part of what the large group leaves, but for a group's rows."""
    df = spark.range(0, 6000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("g"), F.col("id") % 301)).alias("group"), (F.xxhash64("id") % 3 + 0).cast("int").alias("label")
    ).withColumn("label", F.pmod("label", F.lit(3)))
    folds = P.balanced_fold_table(df, 5)
    assert folds.groupBy("group").count().filter("count > 1").count() == 0
    got = shares(df, folds)
    big = P.with_folds(df, folds).filter("`group` = 'big'").head()["fold"]
    for (fold, _), share in got.items():
        assert abs(share - (1 / 3 if fold == big else 1 / 6)) < 0.02


@pytest.mark.parametrize("heavy", [6, 40])
def test_balanced_folds_in_two_rounds(spark, heavy):
    """Groups of widely unlike sizes; classes lie in some groups only."""
    size = F.when(F.col("id") < 4, 1500).when(F.col("id") < 40, 150).otherwise(1 + F.pmod(F.xxhash64("id"), F.lit(9)))
    groups = spark.range(0, 3000, 1, 4).select(F.col("id").cast("string").alias("group"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)).cast("int").alias("main"), size.cast("int").alias("n"))
    df = groups.select("group", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"), "main").select(
        "group", F.when(F.col("i") % 5 == 0, F.pmod(F.col("main") + 1, F.lit(3))).otherwise(F.col("main")).alias("label")
    )
    folds = P.balanced_fold_table(df, 5, heavy=heavy)
    assert folds.count() == 3000
    got = shares(df, folds)
    assert max(got.values()) - min(got.values()) < 0.06
    assert sorted(map(tuple, folds.collect())) == sorted(map(tuple, P.balanced_fold_table(df.repartition(9), 5, heavy=heavy).collect()))


def test_balanced_folds_with_nulls_and_few_groups(spark):
    df = spark.createDataFrame([(None, 0), (None, 1), ("a", None), ("b", 1)], "`group` string, label int")
    rows = P.balanced_fold_table(df, 5).collect()
    assert len(rows) == 3 and len({r["fold"] for r in rows}) == 3


def test_final_probe_with_one_class(spark, tmp_path):
    df = reps(spark, n=6, classes=1, layers=1)
    probes = P.final_probes(df, save_to=str(tmp_path))
    assert probes[0].kind == "majority"
    assert tuple(spark.read.parquet(str(tmp_path / "layer_0_majority")).head()) == (0, 0)
    assert P.probe_parameters(spark, probes).head()["label"] == 0


def test_probe_input(spark):
    rows = [
        (0, "ctx", "tgt", " Entailment ", "know"), (1, "c", None, "neutral", "x"), (2, "c", "t", "contradiction", None),
        (3, "c", "t", "neutral", "v"),
    ]
    df = spark.createDataFrame(rows, "row_id int, Context string, Target string, gold_label string, Verb string")
    got = [(r["row_id"], r["text"], r["label"], r["group"]) for r in P.probe_input(df, max_samples=3).orderBy("row_id").collect()]
    assert got == [(0, "ctx [SEP] tgt", 0, "know"), (2, "c [SEP] t", 2, "_NOGROUP_")]
    with pytest.raises(ValueError, match="Verb"):
        P.probe_input(df.drop("Verb"))
    bad = spark.createDataFrame([(0, "c", "t", "maybe", "v")], df.schema)
    with pytest.raises(Exception, match="unknown gold label: maybe"):
        P.probe_input(bad).collect()


def test_probe_input_empty_cells_of_a_csv_are_missing(spark, tmp_path):
    path = tmp_path / "items.csv"
    path.write_text("row_id,Context,Target,gold_label,Verb\n0,,t,neutral,v\n1,c,t,neutral,\n2,c,t,,v\n3,c,,neutral,v\n4,c,t,entailment,v\n")
    rows = P.probe_input(read_csv(spark, str(path))).select("row_id", "group").collect()
    assert sorted(tuple(r) for r in rows) == [("1", P.NO_GROUP), ("4", "v")]


def test_layer_width_comes_from_the_vector(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],)], "v array<float>")
    assert df.select(P.layer_slices(F.col("v"), 3).alias("s")).head()["s"] == [[1, 2], [3, 4], [5, 6]]
    with pytest.raises(Exception, match="not a multiple"):
        df.select(P.layer_slices(F.col("v"), 4).alias("s")).collect()
