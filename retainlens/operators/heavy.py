"""The most frequent values of many columns, exactly, without shuffling every cell.

Each task keeps a bounded summary per column: counters of at most ``capacity`` values. When a batch
brings more, the largest count beyond the capacity is taken off all counters and added to the summary's
``lost``. So a counter is at most the value's true count and lacks at most ``lost`` of it, and a value
without a counter occurs at most ``lost`` times. Counters and losses of all tasks simply add up. With L the
k-th largest sum of a column, three cases follow, all exact:

* nothing was lost: the sums are the counts;
* ``lost`` < L: only values whose sum is at least L - ``lost`` can be among the first k. There are few;
  a second scan counts these alone;
* otherwise the column is flat (an id, say): no summary can tell its values apart, and its cells are
  counted with one shuffle, as are columns with more than ``MAX_CANDIDATES`` candidates.

Nulls don't count; ties go to the smaller string; an empty or all-null column has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

CAPACITY = 1024
#: Bound of a column's candidates, and so of the table that the second scan is joined with.
MAX_CANDIDATES = 10_000
#: Hash buckets of the first of two top-k steps.
TOPK_BUCKETS = 64
_SUMMARY = "column string, sval string, cnt long, lost long"


def _shrink(counts: pa.Table, capacity: int) -> tuple[pa.Table, int]:
    """At most ``capacity`` counters, and what was taken off each."""
    if counts.num_rows <= capacity:
        return counts, 0
    order = pc.sort_indices(counts, sort_keys=[("cnt", "descending")])
    counts = counts.take(order[:capacity + 1])
    off = counts.column("cnt")[capacity].as_py()
    left = pc.subtract(counts.column("cnt"), off)
    return counts.set_column(1, "cnt", left).filter(pc.greater(left, 0)), off


def _summaries(names: Sequence[str], capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {c: pa.table({"sval": pa.array([], pa.string()), "cnt": pa.array([], pa.int64())}) for c in names}
        lost = dict.fromkeys(names, 0)
        for batch in batches:
            for i, c in enumerate(names):
                cells = pa.table({"sval": batch.column(i).drop_null().cast(pa.string())})
                new = cells.append_column("cnt", pa.array([1] * cells.num_rows, pa.int64()))
                both = pa.concat_tables([kept[c], new]).group_by("sval").aggregate([("cnt", "sum")]).rename_columns(["sval", "cnt"])
                kept[c], off = _shrink(both, capacity)
                lost[c] += off
        for c in names:
            n = kept[c].num_rows
            # The loss of a task stands once, in a row without a value.
            yield pa.RecordBatch.from_pydict({
                "column": pa.array([c] * (n + 1), pa.string()),
                "sval": pa.concat_arrays([*kept[c].column("sval").chunks, pa.array([None], pa.string())]),
                "cnt": pa.concat_arrays([*kept[c].column("cnt").chunks, pa.array([0], pa.int64())]),
                "lost": pa.array([0] * n + [lost[c]], pa.int64())})
    return run


def first_k(counts: DataFrame, k: int) -> DataFrame:
    """The k rows of largest ``c`` per column (ties: smaller value) with their ``rank``: first inside hash
    buckets, then among the at most ``TOPK_BUCKETS`` · k rows left."""
    order = [F.desc("c"), F.asc("sval")]
    inside = Window.partitionBy("column", "_b").orderBy(*order)
    few = (counts.withColumn("_b", F.pmod(F.xxhash64("sval"), F.lit(TOPK_BUCKETS)))
           .withColumn("_rn", F.row_number().over(inside)).filter(F.col("_rn") <= k))
    last = Window.partitionBy("column").orderBy(*order)
    return few.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("column", "sval", "c", "rank")


def _cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("sval")) for c in cols]
    return df.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*").filter("sval IS NOT NULL")


def plan_columns(sums: DataFrame, k: int) -> dict[str, tuple[str, int]]:
    """Column → (way, least sum of a candidate); ways: "sums", "candidates", "cells"."""
    lost = sums.groupBy("column").agg(F.sum("lost").alias("lost"))
    bar = first_k(sums.filter("sval IS NOT NULL"), k).groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("bar"))
    known = lost.join(bar, "column", "left").collect()  # one row per column
    out = {}
    for r in known:
        if not r["lost"]:
            out[r["column"]] = ("sums", 0)
        elif r["n"] == k and r["lost"] < r["bar"]:
            out[r["column"]] = ("candidates", r["bar"] - r["lost"])
        else:
            out[r["column"]] = ("cells", 0)
    return out


def heavy_hitters(df: DataFrame, cols: Sequence[str], k: int = 3, capacity: int = CAPACITY) -> DataFrame:
    """(column, sval, c, rank): the ``k`` most frequent non-null values of each column with their exact counts."""
    if k < 1 or capacity < k:
        raise ValueError("at least one value, and as many counters")
    cols = list(cols)
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(f"_{i}") for i, c in enumerate(cols)])
    sums = cut_lineage(text.mapInArrow(_summaries(cols, capacity), _SUMMARY)
                       .groupBy("column", "sval").agg(F.sum("cnt").alias("c"), F.sum("lost").alias("lost")))
    ways = plan_columns(sums, k)
    named = lambda way: [c for c in cols if ways.get(c, ("sums",))[0] == way]
    values = sums.filter("sval IS NOT NULL")
    counts = values.filter(F.col("column").isin(named("sums"))).select("column", "sval", "c")
    flat = named("cells")
    if named("candidates"):
        least = F.create_map(*[F.lit(x) for c in named("candidates") for x in (c, ways[c][1])])
        few = values.filter(F.col("column").isin(named("candidates")) & (F.col("c") >= least[F.col("column")])).select("column", "sval")
        crowd = {r["column"] for r in few.groupBy("column").count().filter(F.col("count") > MAX_CANDIDATES).collect()}
        flat += sorted(crowd)
        again = [c for c in named("candidates") if c not in crowd]
        if again:
            asked = few.filter(F.col("column").isin(again))
            found = _cells(df, again).join(F.broadcast(asked), ["column", "sval"])  # at most MAX_CANDIDATES a column
            counts = counts.unionByName(found.groupBy("column", "sval").agg(F.count(F.lit(1)).alias("c")))
    if flat:
        counts = counts.unionByName(_cells(df, flat).groupBy("column", "sval").agg(F.count(F.lit(1)).alias("c")))
    return first_k(counts, k)
