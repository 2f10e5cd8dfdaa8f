"""Statistical tests (H1–H4): chi-square with Yates, Welch t, VIF.

Counts and moments are single distributed aggregates; only per-feature rows (a report) reach
the p-value UDFs, and only a k×k correlation matrix reaches the driver (VIF).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pvalues import chi2_sf_udf, t_pvalue_udf
from .profile import _numeric_value, filled_comoments


def chi_square_stats(df: DataFrame, cols: Sequence[str], label: str = "Churn",
                     max_unique: int = 200) -> DataFrame:
    """H1: chi², dof and n_unique per categorical feature vs a binary target.

    Contingency rows are (feature, category, n0, n1) — the label is pivoted to fixed values, so
    every cell of the r×2 table exists. Yates' correction applies when dof = 1. Features with more
    than ``max_unique`` non-null values, or fewer than two rows / columns, are skipped.
    """
    cells = [F.struct(F.lit(c).alias("feature"),
                      F.coalesce(F.col(c).cast("string"), F.lit("MISSING")).alias("category"),
                      F.col(c).cast("string").alias("raw")) for c in cols]
    lv = df.select(F.col(label).cast("int").alias("_y"), F.explode(F.array(*cells)).alias("_c"))\
        .select("_c.*", "_y")
    tab = lv.groupBy("feature", "category").agg(
        F.count_if(F.col("_y") == 0).alias("n0"), F.count_if(F.col("_y") == 1).alias("n1"),
        F.max(F.col("raw").isNotNull().cast("int")).alias("nonnull"))
    # Marginals per feature (one row each) joined back — no window over a feature's categories.
    marg = tab.groupBy("feature").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"),
                                      F.count(F.lit(1)).alias("r"))
    t = tab.join(F.broadcast(marg), "feature")
    n = F.col("c0") + F.col("c1")
    row = F.col("n0") + F.col("n1")
    ncols = (F.col("c0") > 0).cast("int") + (F.col("c1") > 0).cast("int")
    dof = (F.col("r") - 1) * (ncols - 1)

    def term(o, colsum):
        e = row * F.col(colsum) / n
        d = F.abs(F.col(o) - e)
        d = F.when(dof == 1, d - F.least(F.lit(0.5), d)).otherwise(d)
        return F.when(e > 0, d * d / e).otherwise(F.lit(0.0))

    contrib = t.select("feature", "r", dof.alias("dof"), "nonnull",
                       (term("n0", "c0") + term("n1", "c1")).alias("x"))
    out = contrib.groupBy("feature").agg(
        F.sum("x").alias("chi2"), F.first("dof").alias("dof"),
        F.sum("nonnull").cast("long").alias("n_unique"), F.first("r").alias("r"))
    return out.filter((F.col("n_unique") <= max_unique) & (F.col("r") >= 2) & (F.col("dof") >= 1))\
              .select("feature", F.lit("chi_square").alias("test"), "chi2",
                      F.col("dof").cast("int").alias("dof"), "n_unique")


def chi_square_tests(df: DataFrame, cols: Sequence[str], label: str = "Churn",
                     max_unique: int = 200) -> DataFrame:
    """H1 + H2: with the upper-tail p-value, sorted by p."""
    s = chi_square_stats(df, cols, label, max_unique)
    return s.withColumn("p_value", chi2_sf_udf("chi2", "dof")).orderBy("p_value", "feature")


def welch_stats(df: DataFrame, cols: Sequence[str], label: str = "Churn", min_per_class: int = 10
                ) -> DataFrame:
    """H3: Welch t, Satterthwaite dof and class means per numeric feature (one aggregate)."""
    cells = [F.struct(F.lit(c).alias("feature"), _numeric_value(df, c).alias("v")) for c in cols]
    lv = df.select(F.col(label).cast("int").alias("_y"), F.explode(F.array(*cells)).alias("_c"))\
        .select("_c.*", "_y").filter(F.col("v").isNotNull())
    g = lv.groupBy("feature").agg(
        F.count_if(F.col("_y") == 1).alias("n1"), F.count_if(F.col("_y") == 0).alias("n0"),
        F.avg(F.when(F.col("_y") == 1, F.col("v"))).alias("m1"),
        F.avg(F.when(F.col("_y") == 0, F.col("v"))).alias("m0"),
        F.var_samp(F.when(F.col("_y") == 1, F.col("v"))).alias("v1"),
        F.var_samp(F.when(F.col("_y") == 0, F.col("v"))).alias("v0"))
    s1, s0 = F.try_divide(F.col("v1"), F.col("n1")), F.try_divide(F.col("v0"), F.col("n0"))
    se2 = s1 + s0
    t = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(se2))
    dof = F.try_divide(se2 * se2, F.try_divide(s1 * s1, F.col("n1") - 1) + F.try_divide(s0 * s0, F.col("n0") - 1))
    return g.filter((F.col("n1") >= min_per_class) & (F.col("n0") >= min_per_class)).select(
        "feature", F.lit("welch_ttest").alias("test"), t.alias("t_stat"), dof.alias("dof"),
        F.col("m1").alias("mean_churn1"), F.col("m0").alias("mean_churn0"),
        (F.col("m1") - F.col("m0")).alias("diff_mean"))


def welch_tests(df: DataFrame, cols: Sequence[str], label: str = "Churn", min_per_class: int = 10
                ) -> DataFrame:
    """H3 with the two-sided p-value, sorted by p."""
    s = welch_stats(df, cols, label, min_per_class)
    return s.withColumn("p_value", t_pvalue_udf("t_stat", "dof")).orderBy("p_value", "feature")


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """H4: VIF_i = [R⁻¹]_ii of the median-filled correlation matrix; singular → inf.

    R comes from one pass of co-moments, the diagonal from its Cholesky factor: R = L·Lᵀ, so
    [R⁻¹]_ii is the squared length of column i of L⁻¹.
    """
    m = filled_comoments(df, cols).correlation()
    try:
        if not np.all(np.isfinite(m)) or np.linalg.cond(m) > 1e15:
            raise np.linalg.LinAlgError
        diag = (np.linalg.solve(np.linalg.cholesky(m), np.eye(len(cols))) ** 2).sum(0)
    except np.linalg.LinAlgError:
        diag = np.full(len(cols), np.inf)
    rows = [(c, float(v)) for c, v in zip(cols, diag)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double").orderBy(F.desc("vif"))
