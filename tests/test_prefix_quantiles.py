"""Distributed prefix sums and exact quantiles against numpy (incl. a hot key holding most rows)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retainlens.operators.prefix import exact_quantiles, global_prefix_sum


def test_prefix_sum_matches_numpy(spark):
    rng = np.random.default_rng(7)
    keys = rng.permutation(5000).astype(float)
    vals = rng.integers(0, 10, size=5000)
    df = spark.createDataFrame([(float(k), int(v)) for k, v in zip(keys, vals)], "k double, v long")
    out = global_prefix_sum(df, "k", ["v"], buckets=16).orderBy("k").collect()
    order = np.argsort(keys)
    assert [r["cum_v"] for r in out] == list(np.cumsum(vals[order]))
    assert out[0]["tot_v"] == int(vals.sum())
    desc = global_prefix_sum(df, "k", ["v"], descending=True, buckets=16).orderBy(F.desc("k")).collect()
    assert [r["cum_v"] for r in desc] == list(np.cumsum(vals[order[::-1]]))


def test_prefix_sum_grouped(spark):
    rows = [(g, float(k), 1) for g in ("a", "b") for k in range(100 if g == "a" else 7)]
    out = global_prefix_sum(spark.createDataFrame(rows, "g string, k double, v long"), "k", ["v"], by=["g"])
    got = {(r["g"], r["k"]): r["cum_v"] for r in out.collect()}
    assert got[("a", 99.0)] == 100 and got[("b", 6.0)] == 7 and got[("a", 0.0)] == 1


@pytest.mark.parametrize("method", ["percentile", "bucketed"])
def test_exact_quantiles_linear_interpolation(spark, method):
    rng = np.random.default_rng(3)
    hot = np.full(3000, 5.0)                       # one value holds a large share of rows
    vals = np.concatenate([rng.normal(size=4000), hot, rng.integers(0, 50, 2000).astype(float)])
    df = spark.createDataFrame([(float(v), "x" if i % 3 else "y") for i, v in enumerate(vals)], "v double, g string")
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    q = exact_quantiles(df, "v", probs, method=method).first()
    assert np.allclose([q[i] for i in range(5)], np.percentile(vals, [p * 100 for p in probs]), rtol=0, atol=1e-12)
    grouped = {r["g"]: r for r in exact_quantiles(df, "v", [0.5], by=["g"], names=["m"], method=method).collect()}
    gx = vals[[i % 3 != 0 for i in range(len(vals))]]
    assert grouped["x"]["m"] == pytest.approx(float(np.median(gx)), abs=1e-12)


def test_median_even_count(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    assert exact_quantiles(df, "v", [0.5], method="bucketed").first()[0] == 2.5


@pytest.mark.parametrize("buckets", [1, 7])
def test_null_groups_and_null_keys_are_kept(spark, buckets):
    rows = [(None if i % 3 == 0 else "ab"[i % 2], None if i % 10 == 0 else float(i), 1) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, k double, v int")
    out = global_prefix_sum(df, "k", ["v"], by=["g"], buckets=buckets).collect()
    assert len(out) == 120
    for g in (None, "a", "b"):
        got = sorted((r.k if r.k is not None else -1.0, r.cum_v) for r in out if r.g == g)
        assert [c for _, c in sorted(got, key=lambda x: (x[0], x[1]))] == list(range(1, len(got) + 1))
    q = {r.g: r.m for r in exact_quantiles(df, "k", [0.5], by=["g"], names=["m"], buckets=buckets).collect()}
    assert set(q) == {None, "a", "b"}
    for g in q:
        x = sorted(k for gg, k, _ in rows if gg == g and k is not None)
        n = len(x)
        assert q[g] == (x[(n - 1) // 2] + x[n // 2]) / 2
