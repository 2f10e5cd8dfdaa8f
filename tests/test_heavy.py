"""Exact most frequent values from bounded summaries, against plain counting."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from retainlens.operators import heavy as H
from retainlens.operators import profile as A


def _expected(values, k):
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))[:k]


def _rows():
    rng = random.Random(4)
    hot = [f"h{rng.randint(0, 5)}" if rng.random() < 0.6 else f"t{rng.randint(0, 4000)}" for _ in range(6000)]
    tied = ["a", "b", "c", "d"] * 1500
    rng.shuffle(tied)
    return [(hot[i], f"id{i:05d}", tied[i], i % 7 if i % 3 else None, None) for i in range(6000)]


@pytest.mark.parametrize("parts,capacity", [(1, 8), (9, 16), (9, 1024), (40, 64)])
def test_equals_plain_counts(spark, parts, capacity):
    rows, cols = _rows(), ["hot", "id", "tied", "num", "none"]
    df = spark.createDataFrame(rows, "hot string, id string, tied string, num int, none string").repartition(parts)
    got = {}
    for r in H.heavy_hitters(df, cols, 3, capacity).orderBy("column", "rank").collect():
        got.setdefault(r["column"], []).append((r["sval"], r["c"]))
    for i, c in enumerate(cols):
        want = _expected([None if r[i] is None else str(r[i]) for r in rows], 3)
        assert got.get(c, []) == want, c


def test_ways(spark):
    """Low cardinality ends with the sums, a long tail with few candidates, ids with their cells."""
    df = spark.createDataFrame(_rows(), "hot string, id string, tied string, num int, none string").repartition(4)
    text = df.selectExpr("hot", "id", "tied", "cast(num as string) num", "none")
    sums = text.mapInArrow(H._summaries(text.columns, 32), H._SUMMARY).groupBy("column", "sval").agg(
        F.sum("cnt").alias("c"), F.sum("lost").alias("lost"))
    ways = H.plan_columns(sums, 3)
    assert {c: w for c, (w, _) in ways.items()} == {"hot": "candidates", "id": "cells", "tied": "sums", "num": "sums", "none": "sums"}


def test_candidates_beyond_the_bound_are_counted_in_full(spark, monkeypatch):
    monkeypatch.setattr(H, "MAX_CANDIDATES", 1)
    rows = _rows()
    df = spark.createDataFrame([(r[0],) for r in rows], "hot string").repartition(5)
    got = [(r["sval"], r["c"]) for r in H.heavy_hitters(df, ["hot"], 3, 16).orderBy("rank").collect()]
    assert got == _expected([r[0] for r in rows], 3)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "a string, b int")
    assert H.heavy_hitters(empty, ["a", "b"]).count() == 0
    assert sorted(tuple(r) for r in A.top_values(empty).collect()) == [("a", ""), ("b", "")]
    long = "x" * 100_000
    odd = spark.createDataFrame([("",), (long,), (long,), (None,)], "`a b.c` string")
    assert [(r["sval"], r["c"]) for r in H.heavy_hitters(odd, ["a b.c"]).orderBy("rank").collect()] == [(long, 2), ("", 1)]
    with pytest.raises(ValueError):
        H.heavy_hitters(odd, ["a b.c"], 0)
