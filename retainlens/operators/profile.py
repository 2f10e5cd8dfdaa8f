"""Aggregations and data profiling.

Everything is a DataFrame aggregate; multi-column reports unpivot once to
``(column, value)`` and aggregate in one job instead of one job per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DoubleType, FloatType, IntegralType, NumericType,
                               StringType)

from ..functions.expressions import safe_double
from ..session import cut_lineage
from .comoments import CoMoments, column_comoments
from .heavy import first_k, heavy_hitters
from .prefix import exact_quantiles, quantiles_from_counts


def pandas_dtype(dt) -> str:
    """Name of the pandas dtype the reference would report."""
    if isinstance(dt, BooleanType):
        return "bool"
    if isinstance(dt, IntegralType):
        return "int64"
    if isinstance(dt, (DoubleType, FloatType)) or isinstance(dt, NumericType):
        return "float64"
    return "object"


def _numeric_value(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    return safe_double(c, dt)


def long_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Unpivot to (column, sval, nval): string form and coerced number of every cell."""
    cells = [F.struct(F.lit(c).alias("column"),
                      F.col(c).cast("string").alias("sval"),
                      _numeric_value(df, c).alias("nval")) for c in cols]
    return df.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


# ---------------------------------------------------------------- A1 – A4
def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A1: (column, value, count) including the null value, for each column."""
    return (long_values(df, cols).groupBy("column", "sval")
            .agg(F.count(F.lit(1)).alias("count")).withColumnRenamed("sval", "value"))


def frequencies(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A2: normalised frequencies per column, nulls excluded."""
    vc = value_counts(df, cols).filter(F.col("value").isNotNull())
    return vc.join(F.broadcast(column_totals(vc, "count", "_tot")), "column").select(
        "column", "value", "count", (F.col("count") / F.col("_tot")).alias("freq"))


def column_totals(vc: DataFrame, cnt: str, name: str, key: str = "column") -> DataFrame:
    """One total per column — joined back instead of a window partitioned by column, which
    would put every distinct value of a high-cardinality column into one task."""
    return vc.groupBy(key).agg(F.sum(cnt).alias(name))


def positive_rate(df: DataFrame, label: str = "Churn") -> DataFrame:
    """A3: n, positives, positive rate."""
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.col(label)).cast("long").alias("positives"),
                  F.avg(F.col(label).cast("double")).alias("positive_rate"))


def positive_rate_by(df: DataFrame, by: str, label: str = "Churn") -> DataFrame:
    """A4: positive rate per category, sorted descending."""
    return (df.groupBy(by).agg(F.count(F.lit(1)).alias("n"),
                               F.avg(F.col(label).cast("double")).alias("positive_rate"))
            .orderBy(F.desc("positive_rate"), F.asc(by)))


# ---------------------------------------------------------------- A5 / A6
def numeric_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A5: per numeric column: count, mean, sample std, min, max, q25, median, q75."""
    lv = long_values(df, cols).select("column", F.col("nval").alias("value"))\
        .filter(F.col("value").isNotNull())
    moments = lv.groupBy("column").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    qs = exact_quantiles(lv, "value", [0.25, 0.5, 0.75], by=["column"], names=["q25", "median", "q75"])
    return moments.join(qs, "column", "left").withColumnRenamed("column", "feature")


def categorical_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per (feature, category incl. null): count, frequency among non-null, non-null total."""
    vc = value_counts(df, cols)
    tot = vc.groupBy("column").agg(F.sum(F.when(F.col("value").isNotNull(), F.col("count"))).alias("n_nonnull"))
    j = vc.join(F.broadcast(tot), "column")  # one row per column
    return j.select(F.col("column").alias("feature"), F.col("value").alias("category"), "count",
                    F.when(F.col("value").isNotNull(), F.col("count") / F.col("n_nonnull")).alias("freq"),
                    "n_nonnull")


# ---------------------------------------------------------------- A7 – A12
def _value_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, sval, nval, cnt): the distinct-value table behind the audit (one shuffle)."""
    return long_values(df, cols).groupBy("column", "sval", "nval").agg(F.count(F.lit(1)).alias("cnt"))


def entropy_from_counts(vt: DataFrame, string_cols: Sequence[str]) -> DataFrame:
    """Shannon entropy (log2). String columns drop nulls; other columns keep null
    as its own class (the reference stringifies them first)."""
    is_str = F.col("column").isin(*string_cols) if string_cols else F.lit(False)
    keep = vt.filter(F.col("sval").isNotNull() | ~is_str)
    per_value = keep.groupBy("column", "sval").agg(F.sum("cnt").alias("c"))
    # H = log2(N) − Σ c·log2(c) / N per column: one aggregate, no window over the values.
    g = per_value.groupBy("column").agg(F.sum("c").alias("n"),
                                        F.sum(F.col("c") * F.log2(F.col("c"))).alias("s"))
    return g.select("column", (F.log2(F.col("n")) - F.col("s") / F.col("n")).alias("entropy"))


def top_values_from_counts(vt: DataFrame, k: int = 3) -> DataFrame:
    """A11: "v(count), …" of the k most frequent non-null values (tie → smaller string first).

    Two-phase top-k: top-k inside hash buckets of the value (parallel), then top-k of the
    ≤ buckets·k candidates per column — exact, and no task sorts a whole column.
    """
    per_value = vt.filter(F.col("sval").isNotNull()).groupBy("column", "sval").agg(F.sum("cnt").alias("c"))
    return _listed(first_k(per_value, k))


def _listed(top: DataFrame) -> DataFrame:
    """(column, top_values): the ranked values of each column as one text."""
    return top.groupBy("column").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", F.concat(F.col("sval"), F.lit("("),
                                                                    F.col("c").cast("string"), F.lit(")"))
                                                   .alias("s")))),
            lambda x: x["s"]), ", ").alias("top_values"))


def g1_skewness(c: Column, n: Column) -> Column:
    """Bias-corrected G1 from Spark's population skewness; n < 3 → null, constant → 0."""
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(F.var_pop(c) == 0, F.lit(0.0))
            .otherwise(F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)))


def weighted_moments(num: DataFrame) -> DataFrame:
    """Count, mean, sample std and G1 skewness per column from a (column, nval, cnt) table:
    two passes (means, then central moments) — numerically stable, no per-row data."""
    m1 = num.groupBy("column").agg(F.sum("cnt").alias("n_num"),
                                   (F.sum(F.col("cnt") * F.col("nval")) / F.sum("cnt")).alias("mean"))
    d = F.col("nval") - F.col("mean")
    # m1 has one row per column — a bounded broadcast.
    m2 = num.join(F.broadcast(m1), "column").groupBy("column", "n_num", "mean").agg(
        F.sum(F.col("cnt") * d * d).alias("m2"), F.sum(F.col("cnt") * d * d * d).alias("m3"))
    n = F.col("n_num").cast("double")
    g1 = F.sqrt(n) * F.col("m3") / F.pow(F.col("m2"), 1.5)
    return m2.select(
        "column", "n_num", "mean",
        F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))).alias("std"),
        F.when(n < 3, F.lit(None).cast("double")).when(F.col("m2") == 0, F.lit(0.0))
         .otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"))


def weighted_quantiles(num: DataFrame, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Exact quantiles per column from a (column, nval, cnt) table, by ranks."""
    per_value = num.groupBy("column", "nval").agg(F.sum("cnt").alias("cnt"))
    return quantiles_from_counts(per_value, "nval", "cnt", probs, by=["column"], names=names)


def data_health_audit(df: DataFrame, target: str | None = None, digits: int = 4) -> DataFrame:
    """Per column dtype, nulls, fill rate, distinct, entropy, G1 skew, mean, std, p01, p99,
    top-3 values; rounded and sorted by fill rate ascending.

    The source is scanned once: the distinct-value table (column, string value, coerced number,
    count) is built with one partial aggregation, checkpointed, and every statistic derives from it.
    """
    cols = [c for c in df.columns if c != target]
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    string_cols = [c for c in cols if isinstance(dtypes[c], StringType)]
    vt = cut_lineage(_value_table(df, cols))
    counts = vt.groupBy("column").agg(
        F.sum("cnt").alias("_rows"),
        F.sum(F.when(F.col("sval").isNull(), F.col("cnt")).otherwise(0)).alias("null_count"),
        F.count(F.col("sval")).alias("n_unique"))
    num = vt.filter(F.col("nval").isNotNull()).select("column", "nval", "cnt")
    moments = weighted_moments(num)
    ent = entropy_from_counts(vt, string_cols)
    top = top_values_from_counts(vt)
    qs = weighted_quantiles(num, [0.01, 0.99], ["p01", "p99"])
    dtype_map = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(pandas_dtype(dtypes[c])))])
    r = lambda c: F.round(c, digits)
    out = (counts.join(moments, "column", "left").join(ent, "column", "left").join(top, "column", "left")
           .join(qs, "column", "left"))
    return out.select(
        "column",
        dtype_map[F.col("column")].alias("dtype"),
        F.col("null_count").cast("long").alias("null_count"),
        r(1 - F.col("null_count") / F.col("_rows")).alias("fill_rate"),
        F.col("n_unique").cast("long").alias("n_unique"),
        r(F.col("n_unique") / F.col("_rows")).alias("unique_rate"),
        r(F.coalesce(F.col("entropy"), F.lit(0.0))).alias("entropy"),
        r(F.col("skewness")).alias("skewness"),
        r(F.col("mean")).alias("mean"),
        r(F.col("std")).alias("std"),
        r(F.col("p01")).alias("p01"),
        r(F.col("p99")).alias("p99"),
        F.coalesce(F.col("top_values"), F.lit("")).alias("top_values"),
    ).orderBy("fill_rate", "column")


def fill_unique(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count, fill rate, n_unique, unique rate per column."""
    cols = list(cols or df.columns)
    a = data_health_audit(df.select(*cols))
    return a.select("column", "null_count", "fill_rate", "n_unique", "unique_rate")


# ---------------------------------------------------------------- A13, A14, A17
def contingency(df: DataFrame, cols: Sequence[str], label: str = "Churn") -> DataFrame:
    """(feature, category, label, count); null category → 'MISSING'."""
    cells = [F.struct(F.lit(c).alias("feature"),
                      F.coalesce(F.col(c).cast("string"), F.lit("MISSING")).alias("category"))
             for c in cols]
    lv = df.select(F.col(label).alias("label"), F.explode(F.array(*cells)).alias("_c"))\
        .select("_c.*", "label")
    return lv.groupBy("feature", "category", "label").agg(F.count(F.lit(1)).alias("count"))


def class_quartiles(df: DataFrame, cols: Sequence[str], label: str = "Churn") -> DataFrame:
    """Quartiles per (feature, class) — the data behind a violin plot."""
    cells = [F.struct(F.lit(c).alias("feature"), _numeric_value(df, c).alias("value")) for c in cols]
    lv = df.select(F.col(label).alias("label"), F.explode(F.array(*cells)).alias("_c"))\
        .select("_c.*", "label").filter(F.col("value").isNotNull())
    return exact_quantiles(lv, "value", [0.25, 0.5, 0.75], by=["feature", "label"],
                           names=["q25", "median", "q75"])


def column_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact median of the coerced numbers of each column (none for a column without numbers)."""
    lv = long_values(df, cols).select("column", F.col("nval").alias("value"))\
        .filter(F.col("value").isNotNull())
    return {r["column"]: r["median"] for r in
            exact_quantiles(lv, "value", [0.5], by=["column"], names=["median"]).collect()}


def filled_comoments(df: DataFrame, cols: Sequence[str]) -> CoMoments:
    """Co-moments of the median-filled columns: one pass over the rows as they are, filled afterwards."""
    medians = column_medians(df, cols)
    return column_comoments(df, cols).filled([medians.get(c) for c in cols])


def correlation_lower(df: DataFrame, cols: Sequence[str], fill: bool = True) -> DataFrame:
    """Pearson correlation (median-filled, else of complete pairs), strict lower triangle, from one
    pass of co-moments; null where a side doesn't vary."""
    m = (filled_comoments(df, cols) if fill else column_comoments(df, cols)).correlation()
    rows = [(a, b, None if m[i, j] != m[i, j] else float(m[i, j]))
            for i, a in enumerate(cols) for j, b in enumerate(cols) if i > j]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, corr double")


def pair_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with both, sample covariance and correlation of every pair (a ≥ b) of complete pairs."""
    s = column_comoments(df, cols)
    cov, corr = s.covariance(), s.correlation()
    null = lambda v: None if v != v else float(v)
    rows = [(a, b, int(s.n[i, j]), null(cov[i, j]), null(corr[i, j]))
            for i, a in enumerate(cols) for j, b in enumerate(cols) if i >= j]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, n long, cov double, corr double")


# ---------------------------------------------------------------- single components of the audit
def entropy(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A8 per column."""
    cols = list(cols or df.columns)
    strings = [c for c in cols if isinstance(df.schema[c].dataType, StringType)]
    return entropy_from_counts(_value_table(df, cols), strings)


def top_values(df: DataFrame, cols: Sequence[str] | None = None, k: int = 3) -> DataFrame:
    """A11 per column, from bounded summaries; columns with no non-null value have an empty text."""
    cols = list(cols or df.columns)
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    listed = _listed(heavy_hitters(df, cols, k))
    return names.join(listed, "column", "left").select("column", F.coalesce("top_values", F.lit("")).alias("top_values"))


def numeric_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A9 + A10 on the coerced numbers: n, mean, sample std, G1 skewness, p01, p99."""
    lv = long_values(df, cols).select("column", F.col("nval").alias("value"))
    mom = lv.groupBy("column").agg(
        F.count("value").alias("n_num"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        g1_skewness(F.col("value"), F.count("value")).alias("skewness"))
    qs = exact_quantiles(lv.filter(F.col("value").isNotNull()), "value", [0.01, 0.99], by=["column"],
                         names=["p01", "p99"])
    return mom.join(qs, "column", "left")
