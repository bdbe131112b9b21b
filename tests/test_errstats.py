import math

import pytest
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F

from agreelens.functions import pvalues as PV
from agreelens.operators import errstats as E


def chi2_by_hand(pairs):
    values = sorted({v for v, _ in pairs})
    cells = {(v, e): sum(p == (v, e) for p in pairs) for v in values for e in (0, 1)}
    n = len(pairs)
    stat = 0.0
    for v in values:
        for e in (0, 1):
            expected = sum(cells[v, k] for k in (0, 1)) * sum(cells[w, e] for w in values) / n
            gap = abs(cells[v, e] - expected)
            if len(values) == 2:
                gap -= min(0.5, gap)
            stat += gap * gap / expected
    return stat, len(values) - 1


def v_by_hand(stat, n, r, k=2):
    phi2 = max(0, stat / n - (k - 1) * (r - 1) / (n - 1))
    rc, kc = r - (r - 1) ** 2 / (n - 1), k - (k - 1) ** 2 / (n - 1)
    return 0.0 if min(kc - 1, rc - 1) == 0 else math.sqrt(phi2 / min(kc - 1, rc - 1))


@pytest.mark.parametrize("values", [2, 3, 6])
def test_chi_square_and_v(spark, values):
    pairs = [(f"v{i * i % values}", int((i * 7 + i // 3) % 5 < 2 + (i % values == 0))) for i in range(97)]
    df = spark.createDataFrame(pairs, "f string, error_flag int")
    tests = E.with_cramers_v(E.with_chi2_p(E.chi_square(E.contingency(df, ["f"])))).head()
    stat, dof = chi2_by_hand(pairs)
    assert tests["chi2"] == pytest.approx(stat, rel=1e-12)
    assert (tests["dof"], tests["n"]) == (dof, 97)
    assert tests["cramers_v"] == pytest.approx(v_by_hand(stat, 97, dof + 1), rel=1e-12)
    assert 0 <= tests["cramers_v"] <= 1
    if dof > 1:
        indexed = StringIndexer(inputCol="f", outputCol="i").fit(df).transform(df)
        vector = VectorAssembler(inputCols=["i"], outputCol="x").transform(indexed)
        expected = ChiSquareTest.test(vector, "x", "error_flag").head()
        assert tests["chi2"] == pytest.approx(expected["statistics"][0], rel=1e-10)
        assert tests["p_value"] == pytest.approx(expected["pValues"][0], rel=1e-8)


def test_chi_square_per_key(spark):
    rows = [("a", "x", 1), ("a", "x", 0), ("a", "y", 1), ("b", "x", 0), ("b", "y", 0)]
    df = spark.createDataFrame(rows, "model string, f string, error_flag int")
    table = E.contingency(df, ["f"], keys=["model"])
    # Model b has no errors, hence no test, but still error rates.
    assert [r["model"] for r in E.chi_square(table, ["model"]).collect()] == ["a"]
    assert {r["model"] for r in E.error_rates(table, ["model"]).collect()} == {"a", "b"}


def test_not_enough_variance(spark):
    df = spark.createDataFrame([("x", 1), ("x", 0)], "f string, error_flag int")
    table = E.contingency(df, ["f"])
    assert E.chi_square(table).count() == 0
    assert E.error_rates(table).head()["error_rate"] == 0.5


def test_category_cleaning(spark):
    df = spark.createDataFrame([(" a ", 1), ("nan", 1), ("", 0), ("\n", 0), (None, 1), ("NA", 0)], "f string, error_flag int")
    assert sorted(r["value"] for r in E.contingency(df, ["f"]).collect()) == ["NA", "a"]


def test_numeric_correlations(spark):
    rows = [("1.5", 1), ("2", 0), ("abc", 1), ("nan", 0), ("4", 0), (None, 1), (" 3 ", 1)]
    df = spark.createDataFrame(rows, "`mean.noTarget` string, error_flag int")
    out = E.with_correlation_p(E.numeric_correlations(df)).collect()
    assert [r["feature"] for r in out] == ["mean.noTarget"] and out[0]["n"] == 4
    xs, ys = [1.5, 2, 4, 3], [1, 0, 0, 1]
    mx, my = sum(xs) / 4, sum(ys) / 4
    r = sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / math.sqrt(
        sum((x - mx) ** 2 for x in xs) * sum((y - my) ** 2 for y in ys)
    )
    assert out[0]["correlation"] == pytest.approx(r, rel=1e-12)
    # Two degrees of freedom have a closed form.
    t = abs(r) * math.sqrt(2 / (1 - r * r))
    assert out[0]["p_value"] == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-10)


def test_absent_features_are_skipped(spark):
    df = spark.createDataFrame([("a", 1)], "genre string, error_flag int")
    assert [r["feature"] for r in E.contingency(df).collect()] == ["genre"]
    # Without any of them the section is empty, with its columns, and so is what is built on it.
    correlations = E.with_correlation_p(E.numeric_correlations(df))
    assert correlations.columns == ["feature", "correlation", "n", "p_value"] and correlations.count() == 0
    table = E.contingency(df.drop("genre"))
    assert E.error_rates(table).count() == 0 and E.with_cramers_v(E.with_chi2_p(E.chi_square(table))).count() == 0


def test_error_flag_and_ranking(spark):
    df = spark.createDataFrame([(True, "a")] * 4 + [(False, "a")] * 2 + [(False, "b")] * 5 + [(False, "c")], "is_correct boolean, genre string")
    rates = E.error_rates(E.contingency(E.add_error_flag(df), ["genre"]))
    got = [(r["value"], r["support"]) for r in E.ranked_error_rates(rates).collect()]
    assert got == [("b", 5), ("a", 6)]
    assert E.ranked_error_rates(rates, skip=["genre"]).count() == 0


def test_p_values():
    # Known table values.
    assert PV.chi2_p(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert PV.chi2_p(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-9)
    assert PV.chi2_p(0.0, 3) == 1.0 and PV.chi2_p(1.0, 0) is None
    r = 2.228138851964939 / math.sqrt(10 + 2.228138851964939**2)
    assert PV.correlation_p(r, 12) == pytest.approx(0.05, rel=1e-9)
    assert PV.correlation_p(1.0, 10) == 0.0 and PV.correlation_p(0.3, 2) == 1.0
    assert PV.correlation_p(float("nan"), 10) is None
    # For very many pairs the t distribution is the normal one.
    n = 4e8
    z = 1.959963984540054
    assert PV.correlation_p(z / math.sqrt(n - 2 + z * z), n) == pytest.approx(0.05, rel=1e-6)


def test_tails_at_any_size():
    """Fractions and expansions agree where both hold, and the tails follow the normal one far beyond."""
    for s in (2e5, 1e6):
        for z in (-4.0, -0.5, 0.0, 0.3, 2.0, 6.0):
            x = s + z * math.sqrt(s)
            PV_LARGE, PV.LARGE = PV.LARGE, math.inf
            try:
                by_fraction = PV.gamma_upper(s, x)
            finally:
                PV.LARGE = PV_LARGE
            assert PV.gamma_upper_large(s, x) == pytest.approx(by_fraction, abs=1e-11, rel=1e-8)
    for n in (4e5, 2e6):
        for z in (0.01, 0.5, 2.0, 6.0):
            half, rest = (n - 2) / 2, z * z / n
            assert PV.beta_half_large(half, rest) == pytest.approx(PV.beta_regularized(half, 0.5, rest), abs=1e-10, rel=1e-7)
    # At 1e10 degrees of freedom Wilson and Hilferty's cube root is normal to about 1e-11.
    dof = 1e10
    for z in (-3.0, -1.0, 0.0, 1.0, 2.5):
        w = 2 / (9 * dof)
        stat = dof * (1 - w + z * math.sqrt(w)) ** 3
        assert PV.chi2_p(stat, dof) == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), abs=1e-10)
        r = abs(z) / math.sqrt(dof + z * z)
        assert PV.correlation_p(r, dof + 2) == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-9)


def test_values_that_do_not_converge_are_null(monkeypatch):
    monkeypatch.setattr(PV, "STEPS", 3)
    assert PV.chi2_p(9000.0, 9000.0) is None and PV.chi2_p(9500.0, 9000.0) is None
    assert PV.correlation_p(0.02, 9000.0) is None


def test_high_cardinality_feature_stays_distributed(spark):
    df = spark.range(0, 20_000, 1, 8).select(
        F.sha2(F.col("id").cast("string"), 256).alias("Target"), (F.col("id") % 2).cast("int").alias("error_flag")
    )
    plan = E.chi_square(E.contingency(df))
    assert plan.head()["value_count"] == 20_000
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "SinglePartition" not in text


def test_value_without_a_flag_is_left_out(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", None)], "kind string, error_flag int")
    rows = E.contingency(df, ["kind"]).collect()
    assert [(r["value"], r["errors"], r["non_errors"]) for r in rows] == [("a", 1, 1)]
