"""Linear probes: one L2 logistic regression per representation layer, under grouped cross-validation.

Input is a table ``(item_id, layer, vec, label, group)``. It is staged once as parquet, partitioned by layer
and fold. All fits advance together: one pass over it serves every layer and every left-out fold.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import CLASS_IDS, NO_GROUP
from ..functions.text import literal_map, py_strip
from ..session import shared_dir
from ..sources.checks import require_columns
from ..sources.row_index import first_rows, with_row_index
from .joins import splittable_join
from .metrics import classification_report, confusion_counts
from .softmax_fit import NO_FOLD, Problem, matrix_of, probabilities, solve


def probe_input(
    items: DataFrame, max_samples: int | None = None, order: Sequence[str] = ("row_id",)
) -> DataFrame:
    """Items with ``text``, integer ``label`` and ``group``; an unknown label name stops the job.

    Empty cells, as CSV files have them, count as missing.
    """
    require_columns(items, ["Context", "Target", "gold_label", "Verb"])
    df = first_rows(items, max_samples, order)
    df = df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("Context", "Target", "gold_label", "Verb")})
    df = df.dropna(subset=["Context", "Target", "gold_label"])
    name = F.lower(py_strip(F.col("gold_label")))
    unknown = F.raise_error(F.concat(F.lit("unknown gold label: "), name)).cast("int")
    return (
        df.withColumn("text", F.concat("Context", F.lit(" [SEP] "), "Target"))
        .withColumn("label", F.coalesce(F.try_element_at(literal_map(CLASS_IDS), name), unknown))
        .withColumn("group", F.coalesce("Verb", F.lit(NO_GROUP)))
    )


# ---------------------------------------------------------------------------------------------- folds


def fold_count(df: DataFrame, group: str = "group") -> int:
    groups = df.agg(F.count_distinct(group)).head()[0]
    return min(5, groups) if groups >= 2 else 2


def fold_table(
    df: DataFrame,
    n_splits: int,
    seed: int = 7,
    group: str = "group",
    label: str = "label",
    order_by: str = "hash",
) -> DataFrame:
    """``group -> fold``: no group in two folds, classes spread evenly over folds.

    Groups are sorted by their dominant class and, within it, by a seeded hash (or by name with
    ``order_by="group"``), and dealt out in turn, all of it distributed.
    """
    counts = df.groupBy(F.col(group).alias("group"), F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    dominant = F.max_by("label", F.struct(F.col("n"), (-F.col("label")).alias("low")))
    groups = counts.groupBy("group").agg(dominant.alias("_class"))
    within = F.col("group") if order_by == "group" else F.xxhash64(F.col("group"), F.lit(seed))
    dealt = with_row_index(groups.withColumn("_order", within), ["_class", "_order", "group"], "_place")
    return dealt.select("group", F.pmod("_place", F.lit(n_splits)).cast("int").alias("fold"))


def balanced_fold_table(
    df: DataFrame,
    n_splits: int,
    seed: int = 7,
    group: str = "group",
    label: str = "label",
    order_by: str = "hash",
    heavy: int = 1000,
) -> DataFrame:
    """``group -> fold`` for groups of unlike size: every fold gets about the same share of each class.

    Rows are counted by group and class. Then, in two rounds:

    * The ``heavy`` largest groups (a parameter, so one task can hold them) are placed one by one, the largest first, each in the fold where it
      adds least to the sum of squared class shares, and of such the one with the fewest rows. Their loads per fold and class are a small table.
    * All other groups fill what the heavy ones left. Per class, the folds' quotas are found by raising the lowest loads to one level.
      The groups of that leading class, sorted by size, are dealt out along a low-discrepancy sequence, so every fold gets groups
      of all sizes in proportion to its quota, without a running sum over groups.

    If all groups are placed in the first round, a fold exceeds the mean by no more than the largest group; in the second, each fold's rows of a class
    differ from its quota by a few groups no larger than the smallest heavy one. Groups equally large are ordered by a seeded
    hash (or by name with ``order_by="group"``). Null groups and labels are a group and a class.
    """
    counts = df.groupBy(F.col(group).alias("group"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    within = F.col("group") if order_by == "group" else F.xxhash64(F.col("group"), F.lit(seed))
    by_class = F.map_from_entries(F.collect_list(F.struct(F.coalesce(F.col("label").cast("string"), F.lit("")).alias("k"), "n")))
    # A group has one entry per class: the map is as small as the set of classes.
    sized = counts.groupBy("group").agg(F.sum("n").alias("_size"), by_class.alias("_counts"))
    lead = F.array_max(F.transform(F.map_entries("_counts"), lambda e: F.struct(e["value"].alias("n"), e["key"].alias("k"))))["k"]
    ranked = with_row_index(sized.withColumns({"_lead": lead, "_order": within}), [F.desc("_size"), "_order", "group"], "_rank")
    totals = counts.groupBy(F.coalesce(F.col("label").cast("string"), F.lit("")).alias("k")).agg(F.sum("n").alias("n"))
    # One row per class.
    all_counts = {r["k"]: r["n"] for r in totals.collect()}
    first = ranked.filter(F.col("_rank") < heavy)
    placed = _placed_by_size(first, n_splits, all_counts)
    rest = ranked.filter(F.col("_rank") >= heavy)
    loads = placed.select("fold", F.explode("_counts").alias("k", "n")).groupBy("fold", "k").agg(F.sum("n").alias("n")).collect()
    quotas = _quotas(all_counts, loads, n_splits)
    dealt = _dealt_by_quota(rest, quotas, n_splits)
    return placed.select("group", "fold").unionByName(dealt.select("group", "fold"))


def _placed_by_size(groups: DataFrame, n_splits: int, totals: dict[str, int]) -> DataFrame:
    """The first round, in one task: its rows are bounded by the caller."""
    kinds = T.StructType([*groups.select("group", "_counts").schema.fields]).add("fold", T.IntegerType())

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by("_rank")
        loads = [dict.fromkeys(totals, 0) for _ in range(n_splits)]
        folds = []
        for counts in table["_counts"].to_pylist():
            added = [(sum(load[k] * n / totals[k] ** 2 for k, n in sorted(counts)), sum(load.values())) for load in loads]
            folds.append(added.index(min(added)))
            for k, n in counts:
                loads[folds[-1]][k] += n
        return pa.table([table["group"], table["_counts"], pa.array(folds, pa.int32())], names=kinds.names)

    return groups.select("group", "_counts", "_rank", F.lit(0).alias("_all")).groupBy("_all").applyInArrow(place, kinds)


def _quotas(totals: dict[str, int], loads: Sequence, n_splits: int) -> dict[str, list[float]]:
    """Per class, each fold's share of the rows that are left: the lowest loads are raised to one level."""
    out = {}
    for k, total in totals.items():
        load = [0] * n_splits
        for r in loads:
            if r["k"] == k:
                load[r["fold"]] = r["n"]
        left = total - sum(load)
        low = sorted(load)
        for used in range(n_splits, 0, -1):
            level = (left + sum(low[:used])) / used
            if level >= low[used - 1]:
                break
        room = [max(0.0, level - x) for x in load]
        out[k] = [x / sum(room) if sum(room) else 1.0 / n_splits for x in room]
    return out


def _dealt_by_quota(groups: DataFrame, quotas: dict[str, list[float]], n_splits: int) -> DataFrame:
    """The second round: place i of a class goes to the fold in whose part of [0, 1) the fraction of i times the golden ratio lies."""
    dealt = with_row_index(groups, ["_lead", F.desc("_size"), "_order", "group"], "_place")
    at = F.col("_place") * ((5**0.5 - 1) / 2)
    at = at - F.floor(at)
    fold = F.lit(n_splits - 1)
    for k, shares in quotas.items():
        ends = np.cumsum(shares)
        own = F.lit(max(i for i, s in enumerate(shares) if s > 0))
        for i in range(n_splits - 2, -1, -1):
            own = F.when(at < float(ends[i]), i).otherwise(own)
        fold = F.when(F.col("_lead") == k, own).otherwise(fold)
    return dealt.withColumn("fold", fold.cast("int"))


def with_folds(df: DataFrame, folds: DataFrame, group: str = "group") -> DataFrame:
    """Rows with their fold. One group may own a large share of the rows."""
    return splittable_join(df, folds.withColumnRenamed("group", group), [group])


# ---------------------------------------------------------------------------------------------- fits


@dataclass(frozen=True)
class Probe:
    """A fitted probe: classes in order and either its weights (the last column holds intercepts) or, for one class, none.

    Two classes have one row of weights, that of the second; more have a row each.
    """

    layer: int
    classes: tuple[int, ...]
    n_train: int
    weights: np.ndarray | None

    @property
    def kind(self) -> str:
        return "majority" if self.weights is None else "classifier"

    @property
    def model(self) -> LogisticRegressionModel:
        """The probe as a Spark ML model; its label indices are places in ``classes``."""
        jvm = SparkSession.active().sparkContext._jvm
        rows, width = self.weights.shape[0], self.weights.shape[1] - 1
        matrix = DenseMatrix(rows, width, self.weights[:, :-1].ravel(order="F").tolist())
        intercepts = DenseVector(self.weights[:, -1].tolist())
        kind = jvm.org.apache.spark.ml.classification.LogisticRegressionModel
        uid = f"probe_layer_{self.layer}"
        model = LogisticRegressionModel(
            kind(uid, _py2java(_context(), matrix), _py2java(_context(), intercepts), len(self.classes), rows > 1)
        )
        return model

    def save(self, path: str) -> None:
        """The fitted model in Spark ML format; a constant probe as a one-row table."""
        if self.weights is not None:
            self.model.write().overwrite().save(path)
            return
        spark = SparkSession.active()
        row = [(self.layer, self.classes[0])]
        spark.createDataFrame(row, "layer int, majority int").write.mode("overwrite").parquet(path)


def _context() -> SparkContext:
    return SparkSession.active().sparkContext


def _stage(reps: DataFrame) -> DataFrame:
    """Rows by layer and fold: every pass reads them, and a task meets few layers."""
    spark, path, by = reps.sparkSession, shared_dir(reps.sparkSession, "probes"), ["layer", "fold"]
    columns = ["item_id", F.col("label").cast("int").alias("label"), "vec", *(F.col(c).cast("int").alias(c) for c in by)]
    rows = reps.select(*columns)
    # Rebalancing gathers each layer and fold into few files and splits the large ones between tasks.
    rows.hint("rebalance", *by).write.partitionBy(*by).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _sizes(staged: DataFrame) -> tuple[dict[int, dict[int, dict[int, int]]], dict[int, int]]:
    """Rows by layer, fold and class, and the vector width of each layer: sizes for the driver's choice of problems, not data."""
    sizes: dict[int, dict[int, dict[int, int]]] = defaultdict(lambda: defaultdict(dict))
    widths: dict[int, int] = {}
    for r in staged.groupBy("layer", "fold", "label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("w")).collect():
        sizes[r["layer"]][r["fold"]][r["label"]] = r["n"]
        widths[r["layer"]] = max(r["w"], widths.get(r["layer"], 0))
    return sizes, widths


def _training_sizes(folds: dict[int, dict[int, int]], held: int) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for fold, by_label in folds.items():
        for label, n in by_label.items() if fold != held else ():
            out[label] += n
    return dict(out)


def _fit_all(staged: DataFrame, held: Callable[[dict], Sequence[int]], max_iter: int, c: float) -> tuple[dict[tuple[int, int], Probe], list[int]]:
    """A probe for each layer and left-out fold, all fitted in the same passes, and the classes that occur."""
    sizes, widths = _sizes(staged)
    trained = {(layer, h): _training_sizes(folds, h) for layer, folds in sizes.items() for h in held(folds)}
    for (layer, h), counts in trained.items():
        if not counts:
            raise ValueError(f"layer {layer} has no training rows outside fold {h}")
    problems = [
        Problem(layer, h, tuple(sorted(counts)), sum(counts.values()), widths[layer])
        for (layer, h), counts in trained.items()
        if len(counts) > 1
    ]
    solve(staged, problems, c, max_iter)
    fitted = {(q.layer, q.held): q.weights for q in problems}
    probes = {k: Probe(k[0], tuple(sorted(n)), sum(n.values()), fitted.get(k)) for k, n in trained.items()}
    return probes, sorted({label for folds in sizes.values() for n in folds.values() for label in n})


def out_of_fold(reps: DataFrame, max_iter: int = 2000, c: float = 1.0, output: str | None = None) -> DataFrame:
    """Predictions and probabilities for every row from the fit that did not see its fold.

    Input needs ``item_id, layer, fold, label, vec``. All fits advance together (``softmax_fit``): the number of jobs is that of the steps
    which the slowest fit needs, whatever the layers and folds. Results are written by layer and fold below ``output``
    (a shared work folder by default) and returned as one table. A class that the training rows lacked has a NULL
    probability; of equally probable classes the first is predicted.
    """
    spark = reps.sparkSession
    output = output or shared_dir(spark, "probe-predictions")
    staged = _stage(reps)
    probes, all_classes = _fit_all(staged, list, max_iter, c)
    shared = spark.sparkContext.broadcast({k: (p.classes, p.weights) for k, p in probes.items()})
    kinds = T.StructType([staged.schema["item_id"], staged.schema["label"]]).add("prediction", T.IntegerType())
    kinds = kinds.add("probabilities", T.ArrayType(T.DoubleType())).add("layer", T.IntegerType()).add("fold", T.IntegerType())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layers, folds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("layer", "fold"))
            for layer, fold in sorted(set(zip(layers.tolist(), folds.tolist()))):
                own = batch.take(pa.array(np.flatnonzero((layers == layer) & (folds == fold))))
                classes, weights = shared.value[layer, fold]
                known = np.ones((own.num_rows, 1))
                if weights is not None:
                    known = probabilities(matrix_of(own.column("vec"), weights.shape[1] - 1), weights)
                # Classes that no training row had: null beside a model, 0 beside a constant.
                missing = 0.0 if weights is None else np.nan
                table = np.full((own.num_rows, len(all_classes)), missing)
                table[:, [all_classes.index(k) for k in classes]] = known
                flat = pa.array(table.ravel(), mask=np.isnan(table.ravel()))
                offsets = pa.array(np.arange(own.num_rows + 1, dtype=np.int32) * len(all_classes))
                columns = [
                    own.column("item_id"),
                    own.column("label"),
                    pa.array(np.array(classes, np.int32)[known.argmax(axis=1)]),
                    pa.ListArray.from_arrays(offsets, flat),
                    own.column("layer"),
                    own.column("fold"),
                ]
                yield pa.record_batch(columns, names=kinds.names)

    scored = staged.select("item_id", "label", "vec", "layer", "fold").mapInArrow(score, kinds)
    scored.write.partitionBy("layer", "fold").parquet(output)
    return spark.read.schema(kinds).parquet(output)


def final_probes(reps: DataFrame, max_iter: int = 2000, c: float = 1.0, save_to: str | None = None) -> list[Probe]:
    """One probe per layer fitted on all rows, or a constant where the layer has one class only."""
    staged = _stage(reps.withColumn("fold", F.lit(0)))
    probes, _ = _fit_all(staged, lambda folds: [NO_FOLD], max_iter, c)
    out = [probes[k] for k in sorted(probes)]
    for p in out if save_to else ():
        p.save(f"{save_to}/layer_{p.layer}_{'majority' if p.weights is None else 'clf'}")
    return out


def probe_parameters(spark: SparkSession, probes: Sequence[Probe]) -> DataFrame:
    """Fitted parameters as a table: a row per layer and coefficient row."""
    rows = []
    for p in probes:
        if p.weights is None:
            rows.append((p.layer, p.kind, p.n_train, p.classes[0], None, None))
            continue
        owners = p.classes[1:] if len(p.classes) == 2 else p.classes
        for label, weights in zip(owners, p.weights.tolist()):
            rows.append((p.layer, p.kind, p.n_train, label, weights[:-1], weights[-1]))
    return spark.createDataFrame(
        rows, "layer int, kind string, n_train bigint, label int, weights array<double>, intercept double"
    )


def gradient_at(reps: DataFrame, parameters: DataFrame, c: float = 1.0) -> DataFrame:
    """``layer, label, place, gradient`` of the objective at given ``probe_parameters``; place -1 is the intercept.

    A check of a fit that shares no code with it: one aggregate by layer, class and place. Layers must have three classes or more, so that every class has
    its row of weights.
    """
    rows = reps.select("layer", F.col("label").alias("_label"), "vec")
    models = parameters.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("label", "weights", "intercept"))).alias("m"))
    # One row per layer, as wide as its model.
    rows = rows.join(models, "layer")
    dot = lambda w: F.aggregate(F.zip_with("vec", w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    z = F.transform("m", lambda k: F.exp(dot(k["weights"]) + k["intercept"]))
    rows = rows.withColumn("z", z).withColumn("total", F.aggregate("z", F.lit(0.0), lambda s, x: s + x))
    wrong = F.transform("m", lambda k, i: F.struct(k["label"].alias("label"), (F.get("z", i) / F.col("total") - (k["label"] == F.col("_label")).cast("double")).alias("d")))
    each = rows.select("layer", "vec", F.inline(wrong))
    places = F.concat(F.transform("vec", lambda x, i: F.struct(i.alias("place"), x.cast("double").alias("x"))), F.array(F.struct(F.lit(-1).alias("place"), F.lit(1.0).alias("x"))))
    sums = each.select("layer", "label", "d", F.inline(places)).groupBy("layer", "label", "place").agg(F.sum(F.col("d") * F.col("x")).alias("g"))
    decay = parameters.select("layer", "label", F.posexplode("weights").alias("place", "w"))
    both = sums.join(decay, ["layer", "label", "place"], "left")
    return both.select("layer", "label", "place", (c * F.col("g") + F.coalesce("w", F.lit(0.0))).alias("gradient"))


def probe_report(oof: DataFrame, classes: Sequence[int]) -> DataFrame:
    """Accuracy and macro F1 per layer over the classes that occur."""
    counts = confusion_counts(oof, gold="label", pred="prediction", keys=["layer"])
    report = classification_report(counts, labels=list(classes), keys=["layer"])
    return report.select(
        "layer",
        F.col("num_examples").alias("n"),
        F.col("accuracy_all").alias("accuracy"),
        F.col("macro_f1_present").alias("macro_f1"),
    )


def layer_slices(vector: Column, layers: int) -> Column:
    """Cut one long vector into equal layer vectors, for ``posexplode``; a length that does not divide stops the job."""
    uneven = F.raise_error(F.concat(F.lit("not a multiple of the layers: "), F.size(vector).cast("string"))).cast("double")
    width = F.when(F.size(vector) % layers == 0, F.size(vector) / layers).otherwise(uneven).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(layers - 1)), lambda i: F.slice(vector, i * width + 1, width))
