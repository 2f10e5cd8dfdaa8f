"""Distributed prefix sums and exact quantiles.

A global ``sum() OVER (ORDER BY key)`` makes Spark move every row into one task. Here the rows are
range-partitioned by (group, key) and written, sorted, to the checkpoint folder; each row keeps the
number of its partition. A range partition holds neighbours only, so its sums per group (one row for
each group and partition that meet: at most groups + partitions) give every partition its offsets.
The offsets enter the partition as one more row in front, and a window per (partition, group) does the
rest: two shuffles, and work per row that doesn't depend on the number of partitions. Their number
follows from the size of the data (adaptive execution merges small ones); ``buckets`` sets it.

The written partition is what later stages read, so a recomputation after an executor loss can't deal
rows anew. Used by ROC/PR/AUC/average precision (ordered by score), KS (ordered by value), the exact
split and the exact quantiles behind every median / profile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import cut_lineage


def _group_cols(by: Sequence[str]) -> list[str]:
    return list(by) if by else []


def global_prefix_sum(df: DataFrame, key: str, sum_cols: Sequence[str], by: Sequence[str] = (),
                      descending: bool = False, buckets: int | None = None) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` ordered by ``key`` (within each ``by`` group).

    ``df`` should already be pre-aggregated to one row per (by, key): ties then share one row, which is
    what ROC / KS / AP need, and a hot key cannot skew the ordered stage. Null groups are groups like
    any other; null keys come first in their group.
    Output: all input columns plus ``cum_<c>`` for each c and ``tot_<c>`` (group total).
    """
    by = _group_cols(by)
    # Order on a numeric sort key: descending order = ascending on the negated key. Strings order as they are.
    text = isinstance(df.schema[key].dataType, StringType)
    if text and descending:
        raise ValueError("strings are ordered ascending only")
    work = df.withColumn("_sk", F.col(key) if text else ((-F.col(key)) if descending else F.col(key)).cast("double"))
    order = [*by, "_sk"]
    dealt = work.repartitionByRange(buckets, *order) if buckets else work.repartitionByRange(*order)
    work = cut_lineage(dealt.sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sums = work.groupBy("_part", *by).agg(*[F.sum(c).alias(f"_s_{c}") for c in sum_cols])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    # One row in front of every (partition, group): the sum up to there, and the group's total.
    front = sums.select("_part", *by, F.lit(0).alias("_row"),
                        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_v_{c}") for c in sum_cols],
                        *[F.sum(f"_s_{c}").over(whole).alias(f"_t_{c}") for c in sum_cols])
    rows = work.select("*", F.lit(1).alias("_row"), *[F.coalesce(F.col(c), F.lit(0)).alias(f"_v_{c}") for c in sum_cols])
    part = Window.partitionBy("_part", *by).orderBy("_row", "_sk")
    upto = part.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.unionByName(front, allowMissingColumns=True).select(
        *df.columns, "_row", *[F.sum(f"_v_{c}").over(upto).alias(f"cum_{c}") for c in sum_cols],
        *[F.first(f"_t_{c}").over(upto).alias(f"tot_{c}") for c in sum_cols])
    return out.filter("_row = 1").drop("_row")


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Non-null value → count per group (partial aggregation before the shuffle)."""
    by = _group_cols(by)
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("cnt"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                    names: Sequence[str] | None = None, buckets: int | None = None,
                    method: str = "bucketed") -> DataFrame:
    """Exact linear-interpolation quantiles (pandas / ``percentile`` semantics) per group.

    Distinct values are counted, ranked with :func:`global_prefix_sum` and the two ranks around
    h = (n-1)·p are picked with an array filter, so no task ever holds a whole group. With
    ``method="percentile"`` Spark's exact aggregate is used instead (for groups of few values).
    Output: ``by`` columns + one column per prob.
    """
    by = _group_cols(by)
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    if method == "percentile":
        g = df.filter(F.col(value).isNotNull())
        g = g.groupBy(*by) if by else g.groupBy()
        q = g.agg(F.percentile(F.col(value).cast("double"), [float(p) for p in probs]).alias("_q"))
        return q.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    return quantiles_from_counts(value_counts(df, value, by), value, "cnt", probs, by, names, buckets)


def quantiles_from_counts(vc: DataFrame, value: str, cnt: str, probs: Sequence[float],
                          by: Sequence[str] = (), names: Sequence[str] | None = None,
                          buckets: int | None = None) -> DataFrame:
    """Exact quantiles from a (by, value, count) table; null values must be filtered out."""
    by = _group_cols(by)
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    vc = vc.select(*by, value, F.col(cnt).alias("cnt"))
    cum = global_prefix_sum(vc, value, ["cnt"], by=by, buckets=buckets)
    n = F.col("tot_cnt")
    lo_hi = []
    for p in probs:
        h = (n - 1) * F.lit(float(p))
        lo_hi += [F.floor(h), F.ceil(h)]
    ranks = F.array_distinct(F.array(*[r.cast("long") for r in lo_hi]))
    before = F.col("cum_cnt") - F.col("cnt")
    picked = cum.select(
        *by, F.col(value).cast("double").alias("_v"), n.alias("_n"),
        F.explode(F.filter(ranks, lambda r: (r >= before) & (r < F.col("cum_cnt")))).alias("_r"),
    )
    # At most 2·len(probs) entries per group reach the collect.
    grouped = (picked.groupBy(*by) if by else picked.groupBy()).agg(
        F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_m"), F.first("_n").alias("_n"))
    outs = []
    for p, name in zip(probs, names):
        h = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.floor(h).cast("long"), F.ceil(h).cast("long")
        vlo, vhi = F.element_at("_m", lo), F.element_at("_m", hi)
        outs.append((vlo + (h - lo) * (vhi - vlo)).alias(name))
    return grouped.select(*by, *outs)


def exact_quantile_scalars(df: DataFrame, value: str, probs: Sequence[float]) -> list[float | None]:
    """Driver-side scalars (a handful of numbers that become literals in a fitted transform)."""
    row = exact_quantiles(df, value, probs).first()
    if row is None:
        return [None] * len(probs)
    return [row[i] for i in range(len(probs))]
