"""Co-moments: one pass, any partitions, gaps by pairs or filled afterwards; PCA and VIF on top."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from retainlens.operators import preprocess as T
from retainlens.operators import profile as A
from retainlens.operators.comoments import CoMoments, column_comoments, comoments


def _frame(rows=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, 4)) @ rng.normal(size=(4, 4)) * [1, 10, 1e-3, 1] + [0, 1e7, 5, -3]
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf.loc[rng.random(rows) < 0.3, "b"] = np.nan
    pdf.loc[rng.random(rows) < 0.2, "d"] = np.nan
    pdf["flat"] = 0.1
    pdf["none"] = np.nan
    return pdf


@given(st.lists(st.integers(0, 60), min_size=1, max_size=6), st.integers(0, 5))
@settings(max_examples=40, deadline=None)
def test_states_merge_like_one_block(sizes, seed):
    x = _frame(max(1, sum(sizes)), seed).to_numpy()
    state, at = CoMoments.empty(x.shape[1]), 0
    for n in sizes:
        if n:
            state, at = state.merge(CoMoments.of(x[at:at + n])), at + n
    whole = CoMoments.of(x[:at]) if at else CoMoments.empty(x.shape[1])
    assert state.rows == whole.rows and (state.n == whole.n).all()
    for c in ("mean", "cross", "square"):
        assert np.allclose(getattr(state, c), getattr(whole, c), rtol=1e-9, atol=1e-7)


@pytest.mark.parametrize("parts", [1, 7])
def test_pairs_and_fill_equal_pandas(spark, parts):
    pdf = _frame()
    cols = list(pdf.columns)
    df = spark.createDataFrame(pdf).repartition(parts)  # NaN in Spark
    got = column_comoments(df, cols)
    assert got.rows == len(pdf)
    assert np.allclose(got.covariance(), pdf.cov().to_numpy(), rtol=1e-9, equal_nan=True)
    corr = got.correlation()
    assert np.isnan(corr[4]).all() and np.isnan(corr[5]).all()  # constant, empty
    assert np.allclose(corr[:4, :4], pdf[cols[:4]].corr().to_numpy(), rtol=1e-9)
    values = [None if c == "none" else float(pdf[c].median()) for c in cols]
    filled = pdf.fillna({c: v for c, v in zip(cols, values) if v is not None})
    after = got.filled(values)
    assert np.allclose(after.covariance(), filled.cov().to_numpy(), rtol=1e-9, equal_nan=True)
    assert np.isnan(after.correlation()[4]).all()
    low = {(r.feature_a, r.feature_b): r["corr"] for r in A.correlation_lower(df, cols).collect()}
    assert low[("b", "a")] == pytest.approx(filled["b"].corr(filled["a"])) and low[("none", "a")] is None and low[("flat", "a")] is None


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "a double, b double")
    s = column_comoments(empty, ["a", "b"])
    assert s.rows == 0 and np.isnan(s.covariance()).all() and np.isnan(s.means()).all()
    assert [r["corr"] for r in A.correlation_lower(empty, ["a", "b"]).collect()] == [None]
    one = spark.createDataFrame([("x", None), ("2", 5.0), ("3", float("inf"))], "a string, b double")
    s = column_comoments(one, ["a", "b"])
    assert s.n.tolist() == [[2, 2], [2, 2]] and s.covariance()[0, 0] == pytest.approx(0.5) and np.isnan(s.covariance()[0, 1])
    gone = spark.createDataFrame([(None,), ([1.0, 2.0],), ([3.0, None],)], "v array<double>")
    assert comoments(gone, F.col("v")).n.tolist() == [[2, 1], [1, 1]]


def test_pca_equals_eigenvectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 5)) * [5, 3, 2, 1, 0.1] + 100
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(5)
    feats = df.select("id", array_to_vector("v").alias("features"))
    fit = T.pca_fit(feats)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(fit.ratios, values[::-1] / values.sum()) and fit.width(2.0) == 5
    got = np.array([r["pca"].toArray() for r in T.pca_project(feats, 3, keep=["id"], fit=fit).orderBy("id").collect()])
    want = (x - x.mean(0)) @ vectors[:, ::-1][:, :3]
    assert np.allclose(np.abs(got), np.abs(want))


def test_correlation_plan_has_one_pass(spark):
    """No chain of pairwise aggregates: the rows are read into one Python stage, merged in two exchanges."""
    pdf = _frame(50)
    df = spark.createDataFrame(pdf)
    from retainlens.operators.comoments import _STATE, _fold_rows, _fold_states, numeric_array
    plan = df.select(numeric_array(df, list(pdf.columns)).alias("_x")).mapInArrow(_fold_rows, _STATE).repartition("cross")\
        .mapInArrow(_fold_states, _STATE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan
