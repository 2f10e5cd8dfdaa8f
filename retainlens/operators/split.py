"""Sampling and splitting.

Exact stratified split and folds rank rows by a seeded md5 key inside each class. The rank comes
from the range-bucketed prefix sum, so a class holding most rows is still spread over many tasks
(a ``row_number() OVER (PARTITION BY label)`` would put a whole class in one task). The hash
mode needs no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import global_prefix_sum


def hash_key(id_col: str, seed: int = 42) -> Column:
    """52-bit integer from md5(seed | id): exact in a double, stable across engines."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long")


def stratified_split(df: DataFrame, label: str = "Churn", id_col: str = "customerID",
                     test_size: float = 0.2, seed: int = 42, stratify: bool = True, folds: int | None = 5,
                     method: str = "exact") -> DataFrame:
    """X1 (+ X2): adds ``split`` ('train' / 'test') and, for the exact method, ``fold``.

    exact: per class the round(n_c · test_size) rows with the smallest key are test; the training
    rows' rank gives the fold ((rank − 1) mod k). hash: test iff key mod 10⁶ < test_size · 10⁶.
    """
    key = hash_key(id_col, seed)
    if method == "hash":
        return df.withColumn("split", F.when(F.pmod(key, F.lit(1_000_000)) < int(test_size * 1_000_000),
                                             F.lit("test")).otherwise(F.lit("train")))
    by = [label] if stratify else []
    keyed = df.withColumn("_key", key).withColumn("_one", F.lit(1))
    ranked = global_prefix_sum(keyed, "_key", ["_one"], by=by)
    quota = F.floor(F.col("tot__one") * test_size + 0.5)
    rank = F.col("cum__one")
    out = ranked.withColumn("split", F.when(rank <= quota, F.lit("test")).otherwise(F.lit("train")))
    if folds:
        out = out.withColumn("fold", ((rank - 1) % folds).cast("int"))
    return out.drop("_key", "_one", "cum__one", "tot__one")


def class_weights(df: DataFrame, label: str = "Churn") -> DataFrame:
    """Balanced weights n / (2 · n_c) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    # The per-class table has one row per class: a window over it is tiny.
    n = F.sum("n_class").over(Window.partitionBy())
    return counts.select(label, "n_class", (n / (F.lit(2.0) * F.col("n_class"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str = "Churn", positive_weight: float | None = None,
                       weight_col: str = "weight") -> DataFrame:
    """Weight column: balanced weights (one row per class — a bounded broadcast), or
    ``positive_weight`` for class 1 and 1 for class 0 (boosted variant)."""
    if positive_weight is not None:
        return df.withColumn(weight_col, F.when(F.col(label) == 1, F.lit(float(positive_weight)))
                             .otherwise(F.lit(1.0)))
    w = class_weights(df, label).select(label, F.col("weight").alias(weight_col))
    return df.join(F.broadcast(w), label, "left")


def reference_sample(df: DataFrame, col: str, n: int | None = None, seed: int = 42, id_col: str | None = None
                     ) -> DataFrame:
    """The values kept as KS reference. Default (n=None) keeps every value — exact KS;
    with n, the n rows of smallest seeded hash (a sampling operator)."""
    vals = df.filter(F.col(col).isNotNull())
    if n is None:
        return vals.select(col)
    # Deterministic seeded order (stable under recomputation); top-n is a TakeOrderedAndProject.
    key = hash_key(id_col, seed) if id_col else F.xxhash64(F.lit(seed), F.col(col))
    return vals.select(col, key.alias("_h")).orderBy("_h").limit(n).select(col)


def sample_rows(df: DataFrame, n: int, id_col: str = "customerID", seed: int = 42) -> DataFrame:
    """X3 on rows: the n rows with the smallest seeded md5 key (a sampling operator; top-n per
    partition, then merge — no global sort)."""
    return df.withColumn("_h", hash_key(id_col, seed)).orderBy("_h", id_col).limit(n).drop("_h")
