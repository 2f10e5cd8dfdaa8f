"""Edge cases: empty inputs, single class, one-sided drift data, constant columns."""

from pyspark.sql import functions as F

from retainlens.operators import evaluate as E
from retainlens.operators import profile as A
from retainlens.operators.prefix import exact_quantiles, global_prefix_sum


def test_prefix_and_quantiles_on_empty(spark):
    df = spark.createDataFrame([], "k double, v long")
    assert global_prefix_sum(df, "k", ["v"]).count() == 0
    q = exact_quantiles(df, "k", [0.5]).collect()
    assert q == [] or q[0][0] is None


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.9)], "label int, prediction int, score double")
    assert E.roc_auc(df).first()["roc_auc"] is None
    assert E.average_precision(df).first()["average_precision"] is None
    rep = E.evaluation_report(df).first()
    assert rep["tp"] == 0 and rep["f1"] == 0.0 and rep["roc_auc"] is None


def test_audit_constant_and_null_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (1, None, "b")], "c int, n string, s string")
    rows = {r["column"]: r for r in A.data_health_audit(df).collect()}
    assert rows["c"]["skewness"] == 0.0 and rows["c"]["std"] == 0.0 and rows["c"]["entropy"] == 0.0
    assert rows["n"]["fill_rate"] == 0.0 and rows["n"]["n_unique"] == 0 and rows["n"]["top_values"] == ""
    assert rows["s"]["top_values"] == "a(2), b(1)" and rows["s"]["mean"] is None


def test_contingency_missing_label(spark):
    df = spark.createDataFrame([("x", 1), (None, 0)], "f string, Churn int")
    got = {(r["category"], r["label"]): r["count"] for r in A.contingency(df, ["f"]).collect()}
    assert got == {("x", 1): 1, ("MISSING", 0): 1}
