"""Query catalogue: Spark callables ``(spark, sf_dir) -> DataFrame`` and their DuckDB oracle SQL.

Each query runs an operator over the full views of the driver tables. Output columns are aliased
identically on both sides; doubles that come out of floating-point reductions are rounded to 6
decimals on both sides so engine summation order cannot change the value hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import categories as CAT
from ..operators import cleaning as C
from ..operators import profile as A
from ..operators.heavy import heavy_hitters
from ..sources.tables import table
from . import views as V
from .eda import EDA_CATEGORICAL, EDA_NUMERIC, SUBSCRIBER_CATEGORICAL, eda_frame
from .oracle_views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


# ------------------------------------------------------------------ cleaning (C*)
@register("q_positive_rate_by_contract", with_views("""
SELECT Contract, count(*) AS n, round(avg(CAST(Churn AS DOUBLE)), 6) AS positive_rate
FROM subs_l GROUP BY Contract"""))
def q_positive_rate_by_contract(spark, sf):
    """A4 — flagship: churn rate per contract type, descending."""
    subs = C.target_lenient(V.subscribers(spark, sf))
    return A.positive_rate_by(subs, "Contract").select("Contract", "n", r6(F.col("positive_rate")).alias("positive_rate"))


@register("q_target_strict", with_views("""
SELECT customerID, CASE WHEN Churn = 'Yes' THEN 1 WHEN Churn = 'No' THEN 0
                        ELSE CAST(error('invalid target value') AS INTEGER) END AS Churn
FROM subscribers"""))
def q_target_strict(spark, sf):
    """C1."""
    return C.target_strict(V.subscribers(spark, sf)).select("customerID", "Churn")


@register("q_target_lenient", with_views("SELECT customerID, Churn FROM subs_l"))
def q_target_lenient(spark, sf):
    """C2."""
    return C.target_lenient(V.subscribers(spark, sf)).select("customerID", "Churn")


@register("q_clean_charges", with_views("""
SELECT customerID, CAST(tenure AS DOUBLE) AS tenure, MonthlyCharges, round(TotalCharges, 6) AS TotalCharges
FROM cleaned"""))
def q_clean_charges(spark, sf):
    """Coercion + business imputation of TotalCharges (median fitted after rule 1)."""
    df = C.clean_total_charges(V.subscribers(spark, sf))
    return df.select("customerID", F.col("tenure").cast("double").alias("tenure"), "MonthlyCharges",
                     r6(F.col("TotalCharges")).alias("TotalCharges"))


_DEFAULTS_SQL = ", ".join(
    [f"{k}" if k in ("customerID", "tenure", "MonthlyCharges", "Contract", "PaymentMethod")
     else (f"'{v}' AS {k}" if isinstance(v, str) else f"CAST({v} AS {'DOUBLE' if isinstance(v, float) else 'INTEGER'}) AS {k}")
     for k, v in C.RECORD_DEFAULTS.items()])


@register("q_defaults_projection", with_views(f"SELECT {_DEFAULTS_SQL} FROM subscribers"))
def q_defaults_projection(spark, sf):
    """Records carrying a few known fields plus an unknown one → full record with defaults."""
    partial = V.subscribers(spark, sf).select(
        "customerID", "tenure", "MonthlyCharges", "Contract", "PaymentMethod",
        F.lit("ignored").alias("unknown_field"))
    return C.project_defaults(partial)


@register("q_validate_rows", with_views("""
SELECT customerID,
  concat_ws(',',
    CASE WHEN tenure <> floor(tenure) THEN 'tenure_integer' END,
    CASE WHEN tenure < 0 OR tenure > 72 THEN 'tenure_range' END,
    CASE WHEN MonthlyCharges < 0 THEN 'MonthlyCharges_negative' END,
    CASE WHEN trim(TotalCharges) <> '' AND TRY_CAST(TotalCharges AS DOUBLE) IS NULL THEN 'TotalCharges_type' END,
    CASE WHEN TRY_CAST(TotalCharges AS DOUBLE) < 0 THEN 'TotalCharges_negative' END,
    CASE WHEN SeniorCitizen NOT IN (0, 1) THEN 'SeniorCitizen_domain' END) AS violations,
  (tenure BETWEEN 0 AND 72 AND coalesce(MonthlyCharges, 0) >= 0
   AND coalesce(TRY_CAST(TotalCharges AS DOUBLE), 0) >= 0 AND SeniorCitizen IN (0, 1)) AS is_valid
FROM subscribers"""))
def q_validate_rows(spark, sf):
    """Per-row rule violations (quarantine split flag)."""
    v = C.validate_rows(V.subscribers(spark, sf))
    return v.select("customerID", F.array_join("violations", ",").alias("violations"), "is_valid")


# ------------------------------------------------------------------ features (F*)
_FEATS = ["LoyaltyIndex", "TotalAddOnServices", "UnitCost", "AvgPaidPerMonth", "ChargeGap",
          "RiskScope_Fiber_NoSupport_NoSec", "IsMonthToMonth", "IsPaperless", "IsElectronicCheck",
          "TenureBucket"]
# Divisions are bit-identical in both engines (no rounding needed; rounding ties differ between
# engines); log1p may differ in the last bit, so it is rounded.
_FEAT_ROUND = {"LoyaltyIndex"}


@register("q_add_features", with_views("SELECT customerID, " + ", ".join(
    f"round({c}, 6) AS {c}" if c in _FEAT_ROUND else c for c in _FEATS) + " FROM eda"))
def q_add_features(spark, sf):
    """F0–F11 on the cleaned subscribers."""
    df = eda_frame(V.subscribers(spark, sf))
    return df.select("customerID", *[r6(F.col(c)).alias(c) if c in _FEAT_ROUND else F.col(c)
                                     for c in _FEATS])


# ------------------------------------------------------------------ aggregations (A1–A4)
def _unpivot_sql(cols, select_expr, source, where=""):
    parts = [f"SELECT '{c}' AS \"column\", {select_expr.format(c=c)} FROM {source} {where.format(c=c)}"
             for c in cols]
    return "\nUNION ALL\n".join(parts)


_VC_SQL = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS count FROM subscribers GROUP BY {c}"
    for c in SUBSCRIBER_CATEGORICAL)


@register("q_value_counts", with_views(_VC_SQL))
def q_value_counts(spark, sf):
    """A1: value counts (incl. null) of every categorical column."""
    return A.value_counts(V.subscribers(spark, sf), SUBSCRIBER_CATEGORICAL)


@register("q_frequencies", with_views(f"""
SELECT "column", value, count, round(count / sum(count) OVER (PARTITION BY "column"), 6) AS freq
FROM ({_VC_SQL}) WHERE value IS NOT NULL"""))
def q_frequencies(spark, sf):
    """A2: normalised frequencies (nulls excluded)."""
    f = A.frequencies(V.subscribers(spark, sf), SUBSCRIBER_CATEGORICAL)
    return f.select("column", "value", "count", r6(F.col("freq")).alias("freq"))


@register("q_positive_rate", with_views("""
SELECT count(*) AS n, CAST(sum(Churn) AS BIGINT) AS positives, round(avg(CAST(Churn AS DOUBLE)), 6) AS positive_rate
FROM subs_l"""))
def q_positive_rate(spark, sf):
    """A3."""
    p = A.positive_rate(C.target_lenient(V.subscribers(spark, sf)))
    return p.select("n", "positives", r6(F.col("positive_rate")).alias("positive_rate"))


# ------------------------------------------------------------------ profiles and audit
_PROFILE_NUMERIC = ["o_totalprice"]
_PROFILE_CATEGORICAL = ["o_orderpriority", "o_orderstatus"]


@register("q_numeric_profile", with_views("\nUNION ALL\n".join(f"""
SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(quantile_cont({c}, 0.25), 6) AS q25,
       round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q75
FROM orders""" for c in _PROFILE_NUMERIC)))
def q_numeric_profile(spark, sf):
    """A5 over all orders."""
    p = A.numeric_profile(table(spark, sf, "orders"), _PROFILE_NUMERIC)
    return p.select("feature", "count", *[r6(F.col(c)).alias(c) for c in
                                          ("mean", "std", "min", "max", "q25", "median", "q75")])


@register("q_categorical_profile", with_views("\nUNION ALL\n".join(f"""
SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS category, count(*) AS count,
       round(CASE WHEN {c} IS NOT NULL THEN count(*) / sum(count(*) FILTER (WHERE {c} IS NOT NULL)) OVER () END, 6) AS freq,
       CAST(sum(count(*) FILTER (WHERE {c} IS NOT NULL)) OVER () AS BIGINT) AS n_nonnull
FROM orders GROUP BY {c}""" for c in _PROFILE_CATEGORICAL)))
def q_categorical_profile(spark, sf):
    """A6 over all orders."""
    p = A.categorical_profile(table(spark, sf, "orders"), _PROFILE_CATEGORICAL)
    return p.select("feature", "category", "count", r6(F.col("freq")).alias("freq"),
                    F.col("n_nonnull").cast("long").alias("n_nonnull"))


_SUBS_COLS = V.SUBSCRIBER_COLUMNS
_SUBS_TYPES = {"SeniorCitizen": "int64", "tenure": "int64", "MonthlyCharges": "float64", "Churn": "int64"}


def _num_sql(c):
    return f"CAST({c} AS DOUBLE)" if c in _SUBS_TYPES else f"TRY_CAST({c} AS DOUBLE)"


def _entropy_sql(c, src="subs_l"):
    where = "" if c in _SUBS_TYPES else f"WHERE {c} IS NOT NULL"
    return (f"(SELECT coalesce(-sum(p * log2(p)), 0) FROM (SELECT count(*) / sum(count(*)) OVER () AS p "
            f"FROM {src} {where} GROUP BY {c}))")


def _top_sql(c, src="subs_l"):
    return (f"(SELECT coalesce(string_agg(v || '(' || cnt || ')', ', ' ORDER BY cnt DESC, v), '') FROM "
            f"(SELECT CAST({c} AS VARCHAR) AS v, count(*) AS cnt FROM {src} WHERE {c} IS NOT NULL "
            f"GROUP BY 1 ORDER BY cnt DESC, v LIMIT 3))")


def _skew_sql(x):
    return f"CASE WHEN count({x}) < 3 THEN NULL WHEN var_pop({x}) = 0 THEN 0 ELSE skewness({x}) END"


def _audit_row_sql(c):
    x = _num_sql(c)
    return f"""
SELECT '{c}' AS "column", '{_SUBS_TYPES.get(c, 'object')}' AS dtype,
  count(*) - count({c}) AS null_count,
  round(1 - (count(*) - count({c})) / count(*), 4) AS fill_rate,
  count(DISTINCT {c}) AS n_unique,
  round(count(DISTINCT {c}) / count(*), 4) AS unique_rate,
  round({_entropy_sql(c)}, 4) AS entropy,
  round({_skew_sql(x)}, 4) AS skewness,
  round(avg({x}), 4) AS mean, round(stddev_samp({x}), 4) AS std,
  round(quantile_cont({x}, 0.01), 4) AS p01, round(quantile_cont({x}, 0.99), 4) AS p99,
  {_top_sql(c)} AS top_values
FROM subs_l"""


_AUDIT_SQL = "\nUNION ALL\n".join(_audit_row_sql(c) for c in _SUBS_COLS)


def _audited(spark, sf):
    return A.data_health_audit(C.target_lenient(V.subscribers(spark, sf)))


@register("q_audit", with_views(_AUDIT_SQL))
def q_audit(spark, sf):
    """The data-health audit of every subscriber column."""
    return _audited(spark, sf)


@register("q_fill_unique", with_views(
    f'SELECT "column", null_count, fill_rate, n_unique, unique_rate FROM ({_AUDIT_SQL})'))
def q_fill_unique(spark, sf):
    """A7."""
    return A.fill_unique(C.target_lenient(V.subscribers(spark, sf)))


@register("q_entropy", with_views("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", round({_entropy_sql(c)}, 6) AS entropy" for c in _SUBS_COLS)))
def q_entropy(spark, sf):
    """A8."""
    e = A.entropy(C.target_lenient(V.subscribers(spark, sf)))
    return e.select("column", r6(F.col("entropy")).alias("entropy"))


_NUMERIC_LIKE = ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges", "Churn"]


@register("q_skewness", with_views("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", round({_skew_sql(_num_sql(c))}, 6) AS skewness FROM subs_l"
    for c in _NUMERIC_LIKE)))
def q_skewness(spark, sf):
    """Bias-corrected G1 on the coerced numbers."""
    s = A.numeric_summary(C.target_lenient(V.subscribers(spark, sf)), _NUMERIC_LIKE)
    return s.select("column", r6(F.col("skewness")).alias("skewness"))


@register("q_percentiles", with_views("\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", round(quantile_cont({_num_sql(c)}, 0.01), 6) AS p01,
       round(quantile_cont({_num_sql(c)}, 0.99), 6) AS p99, round(avg({_num_sql(c)}), 6) AS mean,
       round(stddev_samp({_num_sql(c)}), 6) AS std FROM subs_l""" for c in _NUMERIC_LIKE)))
def q_percentiles(spark, sf):
    """A10."""
    s = A.numeric_summary(C.target_lenient(V.subscribers(spark, sf)), _NUMERIC_LIKE)
    return s.select("column", *[r6(F.col(c)).alias(c) for c in ("p01", "p99", "mean", "std")])


@register("q_top_values", with_views("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", {_top_sql(c)} AS top_values" for c in _SUBS_COLS)))
def q_top_values(spark, sf):
    """Top-3 values with counts (ties → smaller value first)."""
    return A.top_values(C.target_lenient(V.subscribers(spark, sf)))


@register("q_frequent_words", """
SELECT 'word' AS "column", word AS sval, count(*) AS c FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents)
WHERE word IS NOT NULL GROUP BY word ORDER BY c DESC, word LIMIT 25""")
def q_frequent_words(spark, sf):
    """A11 on a long tail: the 25 most frequent words of all documents (a top-k report), exact."""
    words = table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("word"))
    return heavy_hitters(words, ["word"], 25).select("column", "sval", "c")


@register("q_audit_top10", with_views(
    f'SELECT "column", fill_rate FROM ({_AUDIT_SQL}) ORDER BY fill_rate, "column" LIMIT 10'))
def q_audit_top10(spark, sf):
    """L2: the ten least-filled columns of the audit (a top-k report)."""
    return _audited(spark, sf).select("column", "fill_rate").orderBy("fill_rate", "column").limit(10)


# ------------------------------------------------------------------ A13, A14, A17
@register("q_contingency", with_views("\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), 'MISSING') AS category, Churn AS label, "
    f"count(*) AS count FROM eda GROUP BY 2, 3" for c in EDA_CATEGORICAL)))
def q_contingency(spark, sf):
    """Feature × target counts for every categorical column."""
    return A.contingency(eda_frame(V.subscribers(spark, sf)), EDA_CATEGORICAL)


_VIOLIN = ["tenure", "MonthlyCharges", "TotalCharges", "LoyaltyIndex", "UnitCost", "ChargeGap"]


@register("q_class_quartiles", with_views("\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, Churn AS label, round(quantile_cont({c}, 0.25), 6) AS q25, "
    f"round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q75 "
    f"FROM eda WHERE {c} IS NOT NULL GROUP BY Churn" for c in _VIOLIN)))
def q_class_quartiles(spark, sf):
    """Quartiles per class (the data behind the violin plots)."""
    q = A.class_quartiles(eda_frame(V.subscribers(spark, sf)), _VIOLIN)
    return q.select("feature", "label", *[r6(F.col(c)).alias(c) for c in ("q25", "median", "q75")])


def _filled_sql(cols, src="eda"):
    return ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM {src})) AS {c}"
                     for c in cols)


@register("q_correlation_lower", with_views(
    "\nUNION ALL\n".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) + 0.0 AS corr FROM filled"
        for i, a in enumerate(EDA_NUMERIC) for j, b in enumerate(EDA_NUMERIC) if i > j),
    extra_ctes=f"filled AS (SELECT {_filled_sql(EDA_NUMERIC)} FROM eda)"))
def q_correlation_lower(spark, sf):
    """Pearson correlations of the median-filled numerics, strict lower triangle."""
    c = A.correlation_lower(eda_frame(V.subscribers(spark, sf)), EDA_NUMERIC)
    return c.select("feature_a", "feature_b", r6(F.col("corr")).alias("corr"))


_PAIRED = ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"]


@register("q_pair_moments", with_views("\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, count(*) AS n, round(covar_samp({_num_sql(a)}, {_num_sql(b)}), 3) + 0.0 AS cov, "
    f"round(corr({_num_sql(a)}, {_num_sql(b)}), 6) + 0.0 AS corr FROM subs_l WHERE {_num_sql(a)} IS NOT NULL AND {_num_sql(b)} IS NOT NULL"
    for i, a in enumerate(_PAIRED) for j, b in enumerate(_PAIRED) if i >= j)))
def q_pair_moments(spark, sf):
    """Rows, covariance and correlation of every pair of raw numerics, gaps left out pairwise."""
    m = A.pair_moments(C.target_lenient(V.subscribers(spark, sf)), _PAIRED)
    return m.select("feature_a", "feature_b", "n", F.round("cov", 3).alias("cov"), r6(F.col("corr")).alias("corr"))


# ------------------------------------------------------------------ evaluation
from ..operators import evaluate as E  # noqa: E402

_SCORES_CTE = """
s AS (SELECT score, CAST(sum(label) AS BIGINT) AS tp, CAST(count(*) - sum(label) AS BIGINT) AS fp
      FROM scored_lineitem WHERE score IS NOT NULL GROUP BY score),
c AS (SELECT score, tp, fp, sum(tp) OVER (ORDER BY score DESC) AS cum_tp,
             sum(fp) OVER (ORDER BY score DESC) AS cum_fp,
             sum(tp) OVER () AS tot_tp, sum(fp) OVER () AS tot_fp FROM s)"""

_CM_SQL = """
SELECT tn, fp, fn, tp, total,
  round(tn / total, 4) AS tn_rate, round(fp / total, 4) AS fp_rate,
  round(fn / total, 4) AS fn_rate, round(tp / total, 4) AS tp_rate,
  tp + fn AS actual_positive, tn + fp AS actual_negative,
  tp + fp AS predicted_positive, tn + fn AS predicted_negative
FROM (SELECT count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
             count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
             count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
             count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
             count(*) AS total FROM scored_lineitem)"""


@register("q_confusion", with_views(_CM_SQL))
def q_confusion(spark, sf):
    """E1."""
    return E.confusion(V.scored_lineitem(spark, sf))


@register("q_metrics", with_views(f"""
SELECT round(CASE WHEN total = 0 THEN 0 ELSE (tp + tn) / total END, 4) AS accuracy,
       round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 4) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 4) AS recall,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 4) AS f1
FROM ({_CM_SQL})"""))
def q_metrics(spark, sf):
    """E2."""
    return E.metrics(V.scored_lineitem(spark, sf))


@register("q_roc_auc", with_views(
    "SELECT round(sum(CAST(fp AS DOUBLE) * CAST(2 * cum_tp - tp AS DOUBLE)) / "
    "(2.0 * max(tot_tp) * max(tot_fp)), 6) AS roc_auc FROM c", extra_ctes=_SCORES_CTE))
def q_roc_auc(spark, sf):
    """Exact ROC-AUC (ties count half)."""
    return E.roc_auc(V.scored_lineitem(spark, sf)).select(r6(F.col("roc_auc")).alias("roc_auc"))


@register("q_avg_precision", with_views(
    "SELECT round(sum((tp / tot_tp) * (cum_tp / (cum_tp + cum_fp))), 6) AS average_precision FROM c",
    extra_ctes=_SCORES_CTE))
def q_avg_precision(spark, sf):
    """Average precision (step sum)."""
    return E.average_precision(V.scored_lineitem(spark, sf)).select(
        r6(F.col("average_precision")).alias("average_precision"))


@register("q_roc_curve", with_views("""
SELECT round(score, 6) AS threshold, round(cum_fp / tot_fp, 6) AS fpr, round(cum_tp / tot_tp, 6) AS tpr FROM c
UNION ALL SELECT NULL, 0.0, 0.0""", extra_ctes=_SCORES_CTE))
def q_roc_curve(spark, sf):
    """E5."""
    c = E.roc_curve(V.scored_lineitem(spark, sf))
    return c.select(*[r6(F.col(x)).alias(x) for x in ("threshold", "fpr", "tpr")])


@register("q_roc_turning_points", with_views("""
SELECT flag, threshold, CASE WHEN nn = 0 THEN 0 ELSE cf / nn END AS fpr, CASE WHEN np = 0 THEN 0 ELSE ct / np END AS tpr
FROM (SELECT *, lead(tp) OVER w AS ntp, lead(fp) OVER w AS nfp, row_number() OVER w AS k, sum(tp) OVER w AS ct, sum(fp) OVER w AS cf,
             sum(tp) OVER (PARTITION BY flag) AS np, sum(fp) OVER (PARTITION BY flag) AS nn, count(*) OVER (PARTITION BY flag) AS m
      FROM (SELECT l_linestatus AS flag, l_extendedprice AS threshold, count(*) FILTER (WHERE l_returnflag = 'R') AS tp,
                   count(*) FILTER (WHERE l_returnflag <> 'R') AS fp FROM lineitem GROUP BY ALL)
      WINDOW w AS (PARTITION BY flag ORDER BY threshold DESC))
WHERE k = 1 OR k = m OR tp <> ntp OR fp <> nfp
UNION ALL SELECT DISTINCT l_linestatus, NULL, 0, 0 FROM lineitem"""))
def q_roc_turning_points(spark, sf):
    """E5 without the points of straight runs, by line status: returned lines ranked by price."""
    li = V.table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("flag"), F.col("l_extendedprice").alias("score"),
                                               (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return E.roc_curve(li, by=["flag"], drop_intermediate=True)


@register("q_pr_curve", with_views("""
SELECT round(score, 6) AS threshold, round(cum_tp / (cum_tp + cum_fp), 6) AS precision,
       round(cum_tp / tot_tp, 6) AS recall FROM c
UNION ALL SELECT NULL, 1.0, 0.0""", extra_ctes=_SCORES_CTE))
def q_pr_curve(spark, sf):
    """E6."""
    c = E.pr_curve(V.scored_lineitem(spark, sf))
    return c.select(*[r6(F.col(x)).alias(x) for x in ("threshold", "precision", "recall")])


_PER_CTE = f"""
per AS (
  SELECT '0' AS class, CASE WHEN tn + fn = 0 THEN 0 ELSE tn / (tn + fn) END AS precision,
         CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END AS recall,
         CASE WHEN 2 * tn + fn + fp = 0 THEN 0 ELSE 2 * tn / (2 * tn + fn + fp) END AS f1,
         tn + fp AS support, (tp + tn) / total AS acc FROM ({_CM_SQL})
  UNION ALL
  SELECT '1', CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END,
         CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END,
         tp + fn, (tp + tn) / total FROM ({_CM_SQL}))"""


@register("q_class_report", with_views("""
SELECT class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1,
       CAST(support AS BIGINT) AS support FROM per
UNION ALL SELECT 'accuracy', round(max(acc), 4), round(max(acc), 4), round(max(acc), 4), CAST(sum(support) AS BIGINT) FROM per
UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), CAST(sum(support) AS BIGINT) FROM per
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 4),
       round(sum(recall * support) / sum(support), 4), round(sum(f1 * support) / sum(support), 4),
       CAST(sum(support) AS BIGINT) FROM per""", extra_ctes=_PER_CTE))
def q_class_report(spark, sf):
    """E7."""
    return E.class_report(V.scored_lineitem(spark, sf))


@register("q_evaluation_report", with_views(f"""
SELECT cm.*, round(CASE WHEN total = 0 THEN 0 ELSE (tp + tn) / total END, 4) AS accuracy,
       round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 4) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 4) AS recall,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 4) AS f1,
       (SELECT round(sum(CAST(fp AS DOUBLE) * CAST(2 * cum_tp - tp AS DOUBLE)) / (2.0 * max(tot_tp) * max(tot_fp)), 4) FROM c)
         AS roc_auc,
       (SELECT round(sum((tp / tot_tp) * (cum_tp / (cum_tp + cum_fp))), 4) FROM c) AS average_precision
FROM ({_CM_SQL}) cm""", extra_ctes=_SCORES_CTE))
def q_evaluation_report(spark, sf):
    """The labelled-outcome evaluation job (confusion + metrics + AUC + AP) in one table."""
    return E.evaluation_report(V.scored_lineitem(spark, sf))


# ------------------------------------------------------------------ statistical tests (H1–H4)
from ..operators import drift as D  # noqa: E402
from ..operators import stats as S  # noqa: E402

_CHI_TAB = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), 'MISSING') AS category, "
    f"count(*) FILTER (WHERE Churn = 0) AS n0, count(*) FILTER (WHERE Churn = 1) AS n1, "
    f"max(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END) AS nonnull FROM eda GROUP BY 2"
    for c in EDA_CATEGORICAL)
_CHI_CTES = f"""
chi_tab AS ({_CHI_TAB}),
chi_t AS (SELECT *, sum(n0) OVER w AS c0, sum(n1) OVER w AS c1, count(*) OVER w AS r
          FROM chi_tab WINDOW w AS (PARTITION BY feature)),
chi_x AS (SELECT feature, r, nonnull, (r - 1) * (CAST(c0 > 0 AS INTEGER) + CAST(c1 > 0 AS INTEGER) - 1) AS dof,
                 n0, n1, (n0 + n1) * c0 / (c0 + c1) AS e0, (n0 + n1) * c1 / (c0 + c1) AS e1 FROM chi_t),
chi_d AS (SELECT *, CASE WHEN dof = 1 THEN abs(n0 - e0) - least(0.5, abs(n0 - e0)) ELSE abs(n0 - e0) END AS d0,
                    CASE WHEN dof = 1 THEN abs(n1 - e1) - least(0.5, abs(n1 - e1)) ELSE abs(n1 - e1) END AS d1
          FROM chi_x)"""


@register("q_chi_square", with_views("""
SELECT feature, 'chi_square' AS test,
       round(sum(CASE WHEN e0 > 0 THEN d0 * d0 / e0 ELSE 0 END + CASE WHEN e1 > 0 THEN d1 * d1 / e1 ELSE 0 END), 6) AS chi2,
       CAST(max(dof) AS INTEGER) AS dof, CAST(sum(nonnull) AS BIGINT) AS n_unique
FROM chi_d GROUP BY feature HAVING sum(nonnull) <= 200 AND max(r) >= 2 AND max(dof) >= 1""",
                                     extra_ctes=_CHI_CTES))
def q_chi_square(spark, sf):
    """H1: chi-square statistic (Yates for dof 1), dof and n_unique per categorical feature."""
    s = S.chi_square_stats(eda_frame(V.subscribers(spark, sf)), EDA_CATEGORICAL)
    return s.select("feature", "test", r6(F.col("chi2")).alias("chi2"), "dof", "n_unique")


@register("q_chi_square_pvalues")
def q_chi_square_pvalues(spark, sf):
    """H1 + H2: with upper-tail p-values (closed form; checked against published values in tests)."""
    return S.chi_square_tests(eda_frame(V.subscribers(spark, sf)), EDA_CATEGORICAL)


@register("q_welch", with_views("\nUNION ALL\n".join(f"""
SELECT '{c}' AS feature, 'welch_ttest' AS test,
  round((avg(v) FILTER (WHERE y = 1) - avg(v) FILTER (WHERE y = 0))
        / sqrt(var_samp(v) FILTER (WHERE y = 1) / count(v) FILTER (WHERE y = 1)
               + var_samp(v) FILTER (WHERE y = 0) / count(v) FILTER (WHERE y = 0)), 6) AS t_stat,
  round(avg(v) FILTER (WHERE y = 1), 6) AS mean_churn1, round(avg(v) FILTER (WHERE y = 0), 6) AS mean_churn0,
  round(avg(v) FILTER (WHERE y = 1) - avg(v) FILTER (WHERE y = 0), 6) AS diff_mean
FROM (SELECT CAST({c} AS DOUBLE) AS v, Churn AS y FROM eda WHERE {c} IS NOT NULL)
HAVING count(v) FILTER (WHERE y = 1) >= 10 AND count(v) FILTER (WHERE y = 0) >= 10""" for c in EDA_NUMERIC)))
def q_welch(spark, sf):
    """H3: Welch t and class means per numeric feature (≥ 10 rows per class)."""
    s = S.welch_stats(eda_frame(V.subscribers(spark, sf)), EDA_NUMERIC)
    return s.select("feature", "test", *[r6(F.col(c)).alias(c) for c in
                                         ("t_stat", "mean_churn1", "mean_churn0", "diff_mean")])


@register("q_welch_pvalues")
def q_welch_pvalues(spark, sf):
    """H3 with Satterthwaite dof and two-sided p-values (regularised incomplete beta)."""
    return S.welch_tests(eda_frame(V.subscribers(spark, sf)), EDA_NUMERIC)


@register("q_vif")
def q_vif(spark, sf):
    """H4: VIF = diag(inverse correlation) of the median-filled numerics (numpy-checked in tests)."""
    return S.vif(eda_frame(V.subscribers(spark, sf)), EDA_NUMERIC)


# ------------------------------------------------------------------ drift
_DRIFT_NUM = ["o_totalprice"]
_DRIFT_CAT = ["o_orderpriority", "o_orderstatus"]
_DRIFT_CFG = __import__("retainlens.config", fromlist=["DriftConfig"]).DriftConfig(
    numeric_features=tuple(_DRIFT_NUM), categorical_features=tuple(_DRIFT_CAT))

# P(D >= d) by the lattice-path recursion, cell by cell along the diagonals.
_KS_EXACT = """{name}({key}, n, m, h, s, i, q) AS (
  SELECT {key}, n_ref, n_cur, CAST(round(d * n_ref * n_cur) AS BIGINT) AS h, CAST(0 AS BIGINT), CAST(0 AS BIGINT),
         CASE WHEN round(d * n_ref * n_cur) <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  FROM {src} WHERE {where}
  UNION ALL
  SELECT {key}, n, m, h, s1, i1, CASE WHEN abs(i1 * m - (s1 - i1) * n) >= h THEN 1.0::DOUBLE ELSE sum(part) END
  FROM (SELECT {key}, n, m, h, s + 1 AS s1, i + e AS i1, q * (CASE WHEN e = 1 THEN i + 1 ELSE s + 1 - i END) / (s + 1) AS part
        FROM {name}, (VALUES (0), (1)) AS t(e) WHERE (e = 1 AND i < n) OR (e = 0 AND s - i < m))
  GROUP BY {key}, n, m, h, s1, i1),
{name}_p AS (SELECT {key}, least(1.0, q) AS p FROM {name} WHERE s = n + m)"""

_TAG_CTE = "tag AS (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, {side} AS side FROM {src} WHERE {c} IS NOT NULL"
    for c in _DRIFT_NUM for side, src in ((0, "drift_ref"), (1, "drift_cur"))) + ")"
_KS_CTES = _TAG_CTE + """,
ks_cnt AS (SELECT feature, value, count(*) FILTER (WHERE side = 0) AS r, count(*) FILTER (WHERE side = 1) AS c
           FROM tag GROUP BY 1, 2),
ks_cum AS (SELECT feature, sum(r) OVER w AS cr, sum(c) OVER w AS cc,
                  sum(r) OVER (PARTITION BY feature) AS tr, sum(c) OVER (PARTITION BY feature) AS tc
           FROM ks_cnt WINDOW w AS (PARTITION BY feature ORDER BY value)),
ks_d AS (SELECT feature, max(abs(cr / tr - cc / tc)) AS d, CAST(max(tr) AS BIGINT) AS n_ref,
                CAST(max(tc) AS BIGINT) AS n_cur FROM ks_cum GROUP BY 1),
""" + _KS_EXACT.format(src="ks_d", name="ks_x", key="feature", where="greatest(n_ref, n_cur) <= 10000") + """,
ks_l AS (SELECT *, sqrt(n_ref * n_cur / (n_ref + n_cur)) * d AS lam FROM ks_d),
ks_p AS (SELECT l.*, coalesce(x.p, CASE WHEN lam < 0.05 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(range(1, 101),
           lambda j: 2 * (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * lam * lam))))) END) AS p
         FROM ks_l l LEFT JOIN ks_x_p x USING (feature)),
ks_m AS (SELECT feature, avg(value) FILTER (WHERE side = 0) AS ref_mean, avg(value) FILTER (WHERE side = 1) AS cur_mean,
                stddev_samp(value) FILTER (WHERE side = 0) AS ref_std, stddev_pop(value) FILTER (WHERE side = 1) AS cur_std
         FROM tag GROUP BY 1),
ks AS (SELECT p.feature, d, p, n_ref, n_cur, ref_mean, cur_mean, ref_std, cur_std FROM ks_p p JOIN ks_m USING (feature))"""


@register("q_ks", with_views("""
SELECT feature, round(d, 6) AS ks_statistic, round(p, 6) AS p_value, p < 0.05 AS drift_detected,
       round(ref_mean, 6) AS ref_mean, round(cur_mean, 6) AS cur_mean, round(ref_std, 6) AS ref_std,
       round(cur_std, 6) AS cur_std, n_ref, n_cur FROM ks""", extra_ctes=_KS_CTES))
def q_ks(spark, sf):
    """H5: exact two-sample KS over the full reference and current windows."""
    k = D.ks_test(V.drift_ref(spark, sf), V.drift_cur(spark, sf), _DRIFT_NUM)
    return k.select("feature", *[r6(F.col(c)).alias(c) for c in ("ks_statistic", "p_value")],
                    "drift_detected", *[r6(F.col(c)).alias(c) for c in ("ref_mean", "cur_mean", "ref_std", "cur_std")],
                    F.col("n_ref").cast("long").alias("n_ref"), F.col("n_cur").cast("long").alias("n_cur"))


@register("q_psi_numeric", with_views("""
SELECT feature, round(sum(((c + 1) / (nc + 10) - (r + 1) / (nr + 10)) * ln(((c + 1) / (nc + 10)) / ((r + 1) / (nr + 10)))), 6) AS psi
FROM ph JOIN (SELECT feature, sum(r) AS nr, sum(c) AS nc FROM ph GROUP BY 1) USING (feature) GROUP BY feature""",
    extra_ctes=_TAG_CTE + """,
rng AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM tag GROUP BY 1),
binned AS (SELECT t.feature, t.side, CASE WHEN hi = lo THEN 0
                  ELSE CAST(least(floor((value - lo) / (hi - lo) * 10), 9) AS INTEGER) END AS bin
           FROM tag t JOIN rng USING (feature)),
grid AS (SELECT feature, CAST(b AS INTEGER) AS bin FROM rng, range(0, 10) AS _r(b)),
ph AS (SELECT g.feature, g.bin, count(side) FILTER (WHERE side = 0) AS r, count(side) FILTER (WHERE side = 1) AS c
       FROM grid g LEFT JOIN binned b ON g.feature = b.feature AND g.bin = b.bin GROUP BY 1, 2)"""))
def q_psi_numeric(spark, sf):
    """H6: numeric PSI (10 equal-width bins, Laplace smoothing)."""
    return D.psi_numeric(V.drift_ref(spark, sf), V.drift_cur(spark, sf), _DRIFT_NUM)


def _freq_sql(src):
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS category, count(*) / sum(count(*)) OVER () AS freq "
        f"FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}" for c in _DRIFT_CAT)


_PSI_CAT_CTES = f"""
rf AS ({_freq_sql('drift_ref')}),
cf AS ({_freq_sql('drift_cur')}),
psi_pc AS (SELECT coalesce(rf.feature, cf.feature) AS feature,
              greatest(coalesce(rf.freq, 1e-6), 1e-6) AS r, greatest(coalesce(cf.freq, 1e-6), 1e-6) AS c
       FROM rf FULL OUTER JOIN cf ON rf.feature = cf.feature AND rf.category = cf.category),
psi_cat AS (SELECT feature, round(abs(sum((c - r) * ln(c / r))), 6) AS psi FROM psi_pc GROUP BY 1)"""


@register("q_psi_categorical", with_views(
    "SELECT feature, psi, psi > 0.2 AS drift_detected, CAST(0.2 AS DOUBLE) AS threshold FROM psi_cat", extra_ctes=_PSI_CAT_CTES))
def q_psi_categorical(spark, sf):
    """H7 + H8: categorical PSI over the union of categories, drift flag at PSI > 0.2."""
    return D.psi_categorical(V.drift_ref(spark, sf), V.drift_cur(spark, sf), _DRIFT_CAT)


@register("q_drift_report", with_views("""
SELECT (ratio >= 0.3) AS drift_detected, n_drifted, total_features_checked, round(ratio, 4) AS drift_ratio,
       CASE WHEN ratio = 0 THEN 'none' WHEN ratio < 0.3 THEN 'warning' ELSE 'critical' END AS alert_level,
       (SELECT count(*) FROM drift_cur) AS sample_size, 'ok' AS status, drifted_features
FROM (SELECT count(*) FILTER (WHERE drift) AS n_drifted, count(*) AS total_features_checked,
             CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE drift) / count(*) ELSE 0.0 END AS ratio,
             coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (WHERE drift), '') AS drifted_features
      FROM (SELECT feature, p < 0.05 AS drift FROM ks UNION ALL SELECT feature, psi > 0.2 FROM psi_cat))""",
    extra_ctes=_KS_CTES + "," + _PSI_CAT_CTES))
def q_drift_report(spark, sf):
    """H9: KS + PSI drift flags rolled up into the drift decision."""
    return D.drift_report(V.drift_ref(spark, sf), V.drift_cur(spark, sf), _DRIFT_CFG)


@register("q_drift_from_profile", with_views("""
SELECT feature, 'ks' AS kind, round(d, 6) AS statistic, round(p, 6) AS p_value, p < 0.05 AS drift_detected, round(ref_mean, 6) AS ref_mean,
       round(cur_mean, 6) AS cur_mean, round(ref_std, 6) AS ref_std, round(cur_std, 6) AS cur_std FROM ks
UNION ALL SELECT feature, 'psi', psi, NULL, psi > 0.2, NULL, NULL, NULL, NULL FROM psi_cat""", extra_ctes=_KS_CTES + "," + _PSI_CAT_CTES))
def q_drift_from_profile(spark, sf):
    """KS and PSI against a stored reference, written as one half and an increment of the other."""
    ref, folder = V.drift_ref(spark, sf), f"{Z.stream_dir(spark, 'reference')}"
    even = F.col("o_orderkey") % 2 == 0
    D.save_profile(D.profile(ref.filter(even), _DRIFT_CFG), folder)
    D.save_profile(D.profile(ref.filter(~even), _DRIFT_CFG), folder, increment=True)
    f = D.features_from_profiles(D.load_profile(spark, folder), D.profile(V.drift_cur(spark, sf), _DRIFT_CFG), _DRIFT_CFG)
    return f.select("feature", "kind", "drift_detected", *[r6(F.col(c)).alias(c) for c in ("statistic", "p_value", "ref_mean", "cur_mean", "ref_std", "cur_std")])


@register("q_category_shares", with_views("""
SELECT coalesce(rf.feature, cf.feature) AS feature, coalesce(rf.category, cf.category) AS category,
       round(coalesce(rf.freq, 0), 6) AS ref_freq, round(coalesce(cf.freq, 0), 6) AS cur_freq
FROM rf FULL OUTER JOIN cf ON rf.feature = cf.feature AND rf.category = cf.category""", extra_ctes=_PSI_CAT_CTES))
def q_category_shares(spark, sf):
    """H8: reference and current distribution of every categorical feature."""
    s = D.category_shares(D.category_counts(V.drift_ref(spark, sf), _DRIFT_CAT), D.category_counts(V.drift_cur(spark, sf), _DRIFT_CAT))
    return s.select("feature", "category", r6(F.col("ref_freq")).alias("ref_freq"), r6(F.col("cur_freq")).alias("cur_freq"))


# A third of the customers share one group; the others form up to 500 small ones.
_GROUP_SQL = "CASE WHEN o_custkey % 3 = 0 THEN 'hot' ELSE 'g' || CAST(o_custkey % 500 AS VARCHAR) END"


@register("q_drift_by", with_views("""
SELECT g.grp, 'o_totalprice' AS feature, round(d, 6) AS ks_statistic, n_ref, n_cur, round(p, 6) AS p_small, psi
FROM gd g LEFT JOIN gx_p USING (grp) LEFT JOIN gpsi USING (grp)""", extra_ctes=f"""
gt AS (SELECT {_GROUP_SQL} AS grp, CAST(o_totalprice AS DOUBLE) AS v, 0 AS side FROM drift_ref UNION ALL SELECT {_GROUP_SQL}, CAST(o_totalprice AS DOUBLE), 1 FROM drift_cur),
gn AS (SELECT grp, v, count(*) FILTER (WHERE side = 0) AS r, count(*) FILTER (WHERE side = 1) AS c FROM gt GROUP BY 1, 2),
gc AS (SELECT grp, sum(r) OVER w AS cr, sum(c) OVER w AS cc, sum(r) OVER (PARTITION BY grp) AS tr, sum(c) OVER (PARTITION BY grp) AS tc
       FROM gn WINDOW w AS (PARTITION BY grp ORDER BY v)),
gd AS (SELECT grp, max(abs(cr / nullif(tr, 0) - cc / nullif(tc, 0))) AS d, CAST(max(tr) AS BIGINT) AS n_ref, CAST(max(tc) AS BIGINT) AS n_cur FROM gc GROUP BY 1),
""" + _KS_EXACT.format(src="gd", name="gx", key="grp", where="n_ref > 0 AND n_cur > 0 AND n_ref * n_cur <= 300") + """,
gr AS (SELECT grp, min(v) AS lo, max(v) AS hi FROM gt GROUP BY 1),
gb AS (SELECT grp, CASE WHEN hi = lo THEN 0 ELSE CAST(least(floor((v - lo) / (hi - lo) * 10), 9) AS INTEGER) END AS bin, side FROM gt JOIN gr USING (grp)),
gh AS (SELECT gr.grp, b.b AS bin, count(side) FILTER (WHERE side = 0) AS r, count(side) FILTER (WHERE side = 1) AS c
       FROM gr CROSS JOIN (SELECT unnest(range(10)) AS b) b LEFT JOIN gb ON gb.grp = gr.grp AND gb.bin = b.b GROUP BY 1, 2),
gpsi AS (SELECT grp, round(sum(((c + 1) / (nc + 10) - (r + 1) / (nr + 10)) * ln(((c + 1) / (nc + 10)) / ((r + 1) / (nr + 10)))), 6) AS psi
         FROM gh JOIN (SELECT grp, sum(r) AS nr, sum(c) AS nc FROM gh GROUP BY 1) USING (grp) GROUP BY grp)"""))
def q_drift_by(spark, sf):
    """H5, H6 by group: one hot group and many small ones (p where n_ref * n_cur <= 300, where the oracle can follow)."""
    grp = F.when(F.col("o_custkey") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("o_custkey") % 500).cast("string"))).alias("grp")
    ref, cur = (v(spark, sf).select(grp, "o_totalprice") for v in (V.drift_ref, V.drift_cur))
    a, b = D.number_counts(ref, _DRIFT_NUM, ["grp"]), D.number_counts(cur, _DRIFT_NUM, ["grp"])
    k = D.ks_from_counts(a, b, ["grp"]).join(D.psi_numeric_from_counts(a, b, by=["grp"]), ["grp", "feature"])
    small = (F.col("n_ref") > 0) & (F.col("n_cur") > 0) & (F.col("n_ref") * F.col("n_cur") <= 300)
    return k.select("grp", "feature", r6(F.col("ks_statistic")).alias("ks_statistic"), "n_ref", "n_cur", F.when(small, r6(F.col("p_value"))).alias("p_small"), "psi")


_REF_NUM = ["tenure", "MonthlyCharges", "TotalCharges"]
_REF_CAT = ["Contract", "InternetService", "PaymentMethod"]


@register("q_reference_profile", with_views("\nUNION ALL\n".join(f"""
SELECT '{c}' AS feature, count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std,
       round(min(x), 6) AS min, round(max(x), 6) AS max, round(quantile_cont(x, 0.25), 6) AS q25,
       round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q75
FROM (SELECT TRY_CAST({c} AS DOUBLE) AS x FROM subscribers) WHERE x IS NOT NULL""" for c in _REF_NUM)))
def q_reference_profile(spark, sf):
    """H10 (numeric part): profile of coerced tenure / MonthlyCharges / TotalCharges."""
    cfg = _DRIFT_CFG.__class__()
    num, _ = D.reference_profile(V.subscribers(spark, sf), cfg)
    return num.select("feature", "count", *[r6(F.col(c)).alias(c) for c in
                                            ("mean", "std", "min", "max", "q25", "median", "q75")])


@register("q_reference_frequencies", with_views("\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS category, round(count(*) / sum(count(*)) OVER (), 6) AS freq "
    f"FROM subscribers WHERE {c} IS NOT NULL GROUP BY {c}" for c in _REF_CAT)))
def q_reference_frequencies(spark, sf):
    """H10 (categorical part): category frequencies of Contract / InternetService / PaymentMethod."""
    _, cat = D.reference_profile(V.subscribers(spark, sf))
    return cat.select("feature", "category", r6(F.col("freq")).alias("freq"))


# ------------------------------------------------------------------ prediction log
from ..functions.expressions import risk_band  # noqa: E402
from ..operators import monitor as O  # noqa: E402
from ..operators.rows import combine_rows  # noqa: E402
from ..sources import prediction_log as LG  # noqa: E402

AS_OF = V.LOG_AS_OF
_RISK_SQL = ("CASE WHEN churn_probability < CAST(0.3 AS DOUBLE) THEN 'Low' "
             "WHEN churn_probability < CAST(0.6 AS DOUBLE) THEN 'Medium' ELSE 'High' END")
_WINDOW_7 = f"log_date > DATE '{AS_OF}' - INTERVAL 7 DAY AND log_date <= DATE '{AS_OF}'"


@register("q_risk_band", with_views(f"SELECT event_id, churn_probability, {_RISK_SQL} AS risk_level FROM prediction_log"))
def q_risk_band(spark, sf):
    """risk band of every logged probability."""
    log = V.prediction_log(spark, sf)
    return log.select("event_id", "churn_probability", risk_band("churn_probability").alias("risk_level"))


_STATS_SELECT = """count(*) AS total_predictions, count(*) FILTER (WHERE prediction = 1) AS churn_count,
  count(*) FILTER (WHERE prediction <> 1 OR prediction IS NULL) AS non_churn_count,
  round(CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE prediction = 1) * 100 / count(*) END, 2) AS churn_rate,
  round(avg(churn_probability), 4) AS avg_churn_probability,
  count(*) FILTER (WHERE risk_level = 'Low') AS n_low, count(*) FILTER (WHERE risk_level = 'Medium') AS n_medium,
  count(*) FILTER (WHERE risk_level = 'High') AS n_high"""


@register("q_prediction_stats", with_views(f"SELECT {_STATS_SELECT} FROM prediction_log WHERE {_WINDOW_7}"))
def q_prediction_stats(spark, sf):
    """A15 over the last 7 calendar days (as_of inclusive), no row cap."""
    log = LG.day_window(V.prediction_log(spark, sf), AS_OF, 7)
    return O.prediction_stats(log)


@register("q_prediction_stats_daily", with_views(
    f"SELECT log_date, {_STATS_SELECT} FROM prediction_log GROUP BY log_date"))
def q_prediction_stats_daily(spark, sf):
    """A15 per day for the whole log (one job for every day)."""
    return O.prediction_stats(V.prediction_log(spark, sf), by=["log_date"])


@register("q_batch_summary", with_views("""
SELECT count(*) AS total, count(*) FILTER (WHERE prediction = 1) AS churn_count,
       round(CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE prediction = 1) * 100 / count(*) END, 2) AS churn_rate
FROM prediction_log"""))
def q_batch_summary(spark, sf):
    """A16 over the whole scored batch."""
    return O.batch_summary(V.prediction_log(spark, sf))


@register("q_latest_predictions", with_views(f"""
SELECT event_id, customerID, churn_probability, risk_level FROM prediction_log WHERE {_WINDOW_7}
ORDER BY ts DESC, event_id DESC LIMIT 100"""))
def q_latest_predictions(spark, sf):
    """L1: the 100 newest log rows of the last 7 days (a top-n report), newest first."""
    log = LG.day_window(V.prediction_log(spark, sf), AS_OF, 7)
    return O.latest(log, 100).select("event_id", "customerID", "churn_probability", "risk_level")


@register("q_log_features", with_views(
    "SELECT event_id, customerID, prediction, CAST(json_extract(input_features, '$.k') AS INTEGER) AS k "
    "FROM prediction_log"))
def q_log_features(spark, sf):
    """The JSON input features of every log row as flat columns."""
    flat = LG.log_features(V.prediction_log(spark, sf), "k INT")
    return flat.select("event_id", "customerID", "prediction", "k")


@register("q_retention_split", with_views(f"""
SELECT CASE WHEN log_date < DATE '{AS_OF}' - INTERVAL 14 DAY THEN 'expired' ELSE 'live' END AS retention,
       count(*) AS n_rows, count(DISTINCT log_date) AS n_days
FROM prediction_log GROUP BY 1"""))
def q_retention_split(spark, sf):
    """Live vs expired rows for a 14-day retention at as_of (whole day partitions)."""
    tagged = LG.retention_split(V.prediction_log(spark, sf), AS_OF, 14)
    return tagged.groupBy("retention").agg(F.count(F.lit(1)).alias("n_rows"),
                                           F.count_distinct("log_date").alias("n_days"))


# ------------------------------------------------------------------ monitoring
_BASELINE_BEFORE = 1998
_PERIOD_CTES = f"""
pm AS (SELECT CASE WHEN ship_year < {_BASELINE_BEFORE} THEN 0 ELSE ship_year END AS period, label, prediction, score
       FROM scored_lineitem),
pcm AS (SELECT period, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
               count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
               count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn FROM pm GROUP BY 1),
pmet AS (SELECT period, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 4) AS f1,
                round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 4) AS recall,
                round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 4) AS precision FROM pcm),
ps AS (SELECT period, score, sum(label) AS tp, count(*) - sum(label) AS fp FROM pm GROUP BY 1, 2),
pc AS (SELECT period, tp, fp, sum(tp) OVER (PARTITION BY period ORDER BY score DESC) AS cum_tp,
              sum(tp) OVER (PARTITION BY period) AS tot_tp, sum(fp) OVER (PARTITION BY period) AS tot_fp FROM ps),
pauc AS (SELECT period, round(sum(CAST(fp AS DOUBLE) * CAST(2 * cum_tp - tp AS DOUBLE)) / (2.0 * max(tot_tp) * max(tot_fp)), 4)
                AS roc_auc FROM pc GROUP BY 1),
plong AS (SELECT period, 'f1' AS metric, f1 AS value FROM pmet UNION ALL SELECT period, 'recall', recall FROM pmet
          UNION ALL SELECT period, 'precision', precision FROM pmet UNION ALL SELECT period, 'roc_auc', roc_auc FROM pauc),
th AS (SELECT metric, CAST(threshold AS DOUBLE) AS threshold
       FROM (VALUES ('f1', 0.10), ('recall', 0.15), ('precision', 0.10), ('roc_auc', 0.05)) AS t(metric, threshold)),
deg AS (SELECT c.period AS ship_year, c.metric, b.value AS baseline, c.value AS current,
               CASE WHEN b.value > 0 THEN (b.value - c.value) / b.value ELSE 0 END AS drop, th.threshold
        FROM plong c JOIN plong b ON b.period = 0 AND c.metric = b.metric JOIN th ON th.metric = c.metric
        WHERE c.period <> 0),
degr AS (SELECT ship_year, metric, round(baseline, 4) AS baseline, round(current, 4) AS current,
                round(drop * 100, 2) AS drop_pct, round(threshold * 100, 2) AS threshold_pct, drop > threshold AS degraded
         FROM deg)"""


def _period_metrics(spark, sf, by_year: bool = True):
    """Baseline metrics (ship years before 1998, long form) and current metrics per later year."""
    sl = V.scored_lineitem(spark, sf)
    period = F.when(F.col("ship_year") < _BASELINE_BEFORE, F.lit(0)).otherwise(
        F.col("ship_year") if by_year else F.lit(1))
    pm = sl.withColumn("period", period)
    met = E.metrics(pm, by=["period"]).join(E.roc_auc(pm, by=["period"]), "period")\
        .withColumn("roc_auc", F.round("roc_auc", 4))
    long = O.metrics_long(met, ["f1", "recall", "precision", "roc_auc"], by=["period"])
    base = long.filter(F.col("period") == 0).drop("period")
    cur = long.filter(F.col("period") != 0)
    return base, cur


@register("q_degradation", with_views("SELECT * FROM degr", extra_ctes=_PERIOD_CTES))
def q_degradation(spark, sf):
    """O1: per ship year ≥ 1998, metric drops against the pre-1998 baseline."""
    base, cur = _period_metrics(spark, sf)
    d = O.degradation(base, cur.withColumnRenamed("period", "ship_year"), by=["ship_year"])
    return d


@register("q_performance_status", with_views("""
SELECT ship_year, count(*) FILTER (WHERE degraded) = 0 AS performance_ok, count(*) FILTER (WHERE degraded) AS n_degraded,
       count(*) AS total_checked, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE degraded), '') AS degraded_metrics,
       CASE WHEN count(*) FILTER (WHERE degraded) = 0 THEN 'healthy' WHEN count(*) FILTER (WHERE degraded) <= 1 THEN 'degraded'
            ELSE 'critical' END AS status
FROM degr GROUP BY ship_year""", extra_ctes=_PERIOD_CTES))
def q_performance_status(spark, sf):
    """O1 roll-up per ship year: healthy / degraded / critical."""
    base, cur = _period_metrics(spark, sf)
    d = O.degradation(base, cur.withColumnRenamed("period", "ship_year"), by=["ship_year"])
    return O.performance_status(d, by=["ship_year"])


def _signals(spark, sf):
    """One row: drift flag (orders windows) + performance flag (lineitem windows) + cooldown."""
    drift = D.drift_report(V.drift_ref(spark, sf), V.drift_cur(spark, sf), _DRIFT_CFG).select("drift_detected")
    base, cur = _period_metrics(spark, sf, by_year=False)
    perf = O.performance_status(O.degradation(base, cur, by=["period"]), by=["period"]).select("performance_ok")
    return combine_rows(drift, perf)


_FULL_CTES = _KS_CTES + "," + _PSI_CAT_CTES + "," + _PERIOD_CTES.replace(
    "ELSE ship_year END AS period", "ELSE 1 END AS period") + """,
sig AS (SELECT
  (SELECT (CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE drift) / count(*) ELSE 0.0 END) >= 0.3
   FROM (SELECT feature, p < 0.05 AS drift FROM ks UNION ALL SELECT feature, psi > 0.2 FROM psi_cat)) AS drift_detected,
  (SELECT count(*) FILTER (WHERE degraded) = 0 FROM degr) AS performance_ok),
fc AS (SELECT drift_detected, performance_ok,
  CASE WHEN drift_detected AND NOT performance_ok THEN 'retrain_needed' WHEN NOT performance_ok THEN 'degraded'
       WHEN drift_detected THEN 'drift_warning' ELSE 'stable' END AS decision,
  NOT performance_ok AS retrain_recommended,
  concat_ws(';', CASE WHEN drift_detected THEN 'data_drift' END,
                 CASE WHEN NOT performance_ok THEN 'performance_degradation' END) AS reasons FROM sig)"""


@register("q_full_check", with_views("SELECT * FROM fc", extra_ctes=_FULL_CTES))
def q_full_check(spark, sf):
    """O2: drift × performance → stable / drift_warning / degraded / retrain_needed."""
    return O.full_check(_signals(spark, sf))


_COOL_AS_OF = "2024-01-31 00:00:00"


@register("q_cooldown", with_views(f"""
SELECT user_id, round(date_diff('microsecond', max(ts), TIMESTAMP '{_COOL_AS_OF}') / 3.6e9, 4) AS hours_since_last,
       date_diff('microsecond', max(ts), TIMESTAMP '{_COOL_AS_OF}') / 3.6e9 >= 24 AS cooldown_ok
FROM events GROUP BY user_id"""))
def q_cooldown(spark, sf):
    """O3: per key, hours since the last event at as_of and whether a 24 h cooldown has passed."""
    ev = V.table(spark, sf, "events")
    return O.cooldown(ev, _COOL_AS_OF, 24.0, by=["user_id"]).drop("last_event")


@register("q_retrain_gate", with_views(f"""
SELECT f.decision, f.retrain_recommended, c.cooldown_ok,
  CASE WHEN NOT f.retrain_recommended THEN false WHEN NOT c.cooldown_ok THEN false ELSE true END AS should_retrain,
  CASE WHEN NOT f.retrain_recommended THEN 'not needed' WHEN NOT c.cooldown_ok THEN 'cooldown active'
       ELSE 'retrain approved' END AS gate_reason
FROM fc f, (SELECT last_event IS NULL OR date_diff('microsecond', last_event, TIMESTAMP '{_COOL_AS_OF}') / 3.6e9 >= 24 AS cooldown_ok
            FROM (SELECT max(ts) AS last_event FROM events)) c""", extra_ctes=_FULL_CTES))
def q_retrain_gate(spark, sf):
    """The ordered retrain gate over the full check and the pipeline-run cooldown."""
    fc = O.full_check(_signals(spark, sf))
    cool = O.cooldown(V.table(spark, sf, "events"), _COOL_AS_OF, 24.0).select("cooldown_ok")
    g = O.retrain_gate(combine_rows(fc, cool))
    return g.select("decision", "retrain_recommended", "cooldown_ok", "should_retrain", "gate_reason")


# ------------------------------------------------------------------ preprocessing, splitting (T*, X*)
from ..operators import preprocess as T  # noqa: E402
from ..operators import split as X  # noqa: E402


@register("q_stratified_split", with_views("""
SELECT customerID, Churn AS label, CASE WHEN rn <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split,
       CAST((rn - 1) % 5 AS INTEGER) AS fold
FROM (SELECT customerID, Churn, row_number() OVER (PARTITION BY Churn ORDER BY md5('42|' || customerID)) AS rn,
             count(*) OVER (PARTITION BY Churn) AS n FROM subs_l)"""))
def q_stratified_split(spark, sf):
    """X1 + X2: exact stratified 80/20 split and 5 stratified folds (seeded md5 order)."""
    s = X.stratified_split(C.target_lenient(V.subscribers(spark, sf)), "Churn", "customerID", 0.2, 42)
    return s.select("customerID", F.col("Churn").alias("label"), "split", "fold")


@register("q_class_weights", with_views("""
SELECT Churn, count(*) AS n_class, round((SELECT count(*) FROM subs_l) / (2.0 * count(*)), 6) AS weight
FROM subs_l GROUP BY Churn"""))
def q_class_weights(spark, sf):
    """Balanced class weights n / (2 n_c)."""
    w = X.class_weights(C.target_lenient(V.subscribers(spark, sf)))
    return w.select("Churn", "n_class", r6(F.col("weight")).alias("weight"))


def _mode_sql(c, src="eda"):
    return (f"(SELECT v FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {src} WHERE {c} IS NOT NULL "
            f"GROUP BY 1) ORDER BY n DESC, v LIMIT 1)")


@register("q_impute", with_views("\nUNION ALL\n".join(
    [f"SELECT '{c}' AS \"column\", round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median, "
     f"CAST(NULL AS VARCHAR) AS mode FROM eda" for c in EDA_NUMERIC]
    + [f"SELECT '{c}' AS \"column\", CAST(NULL AS DOUBLE) AS median, {_mode_sql(c)} AS mode" for c in EDA_CATEGORICAL])))
def q_impute(spark, sf):
    """T1 + T2: fitted median per numeric column and most-frequent value per categorical column."""
    df = eda_frame(V.subscribers(spark, sf))
    meds, modes = T.fit_medians(df, EDA_NUMERIC), T.fit_modes(df, EDA_CATEGORICAL)
    rows = [(c, None if meds[c] is None else round(meds[c], 6), None) for c in EDA_NUMERIC]
    rows += [(c, None, modes[c]) for c in EDA_CATEGORICAL]
    return spark.createDataFrame(rows, "column string, median double, mode string")


@register("q_scale", with_views("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM filled"
    for c in EDA_NUMERIC), extra_ctes=f"filled AS (SELECT {_filled_sql(EDA_NUMERIC)} FROM eda)"))
def q_scale(spark, sf):
    """Standard-scaler parameters (population std) of the median-filled numerics."""
    pre = T.fit_preprocessor(eda_frame(V.subscribers(spark, sf)), EDA_NUMERIC, [])
    rows = [(c, mean, std) for c, _, _, mean, std in pre._retainlens_spec["num"]]
    return spark.createDataFrame(rows, "column string, mean double, std double").select("column", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@register("q_onehot", with_views("""
SELECT "column", category, row_number() OVER (PARTITION BY "column" ORDER BY category) - 1 AS slot FROM (""" +
    "\nUNION\n".join(f"SELECT DISTINCT '{c}' AS \"column\", coalesce(CAST({c} AS VARCHAR), {_mode_sql(c)}) AS category "
                     f"FROM eda" for c in EDA_CATEGORICAL) + ")"))
def q_onehot(spark, sf):
    """T4: one-hot slots per category (alphabetical, no drop; unknown → all zeros)."""
    return CAT.fit_dictionary(eda_frame(V.subscribers(spark, sf)), EDA_CATEGORICAL).select("column", "category", "slot")


_ID_LIKE = ["o_orderkey", "o_custkey", "o_orderpriority"]


@register("q_category_dictionary", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", category, count, row_number() OVER (ORDER BY category) - 1 AS slot, count(*) OVER () AS n,
    round(CASE WHEN p < 1 THEN 1 / sqrt(p * (1 - p)) ELSE 1 END, 6) AS scale
    FROM (SELECT CAST({c} AS VARCHAR) AS category, count(*) AS count, count(*) / (SELECT count(*) FROM orders) AS p FROM orders GROUP BY 1)"""
    for c in _ID_LIKE))
def q_category_dictionary(spark, sf):
    """T4, T5 on id-like columns: slot, frequency and scale of every category of the orders table."""
    got = CAT.fit_dictionary(table(spark, sf, "orders"), _ID_LIKE)
    return got.withColumn("scale", r6(F.col("scale")))


def _eda_features(spark, sf):
    df = eda_frame(V.subscribers(spark, sf))
    pre = T.fit_preprocessor(df, EDA_NUMERIC, EDA_CATEGORICAL, scale_onehot=False)
    return pre.transform(df).select("customerID", "features", "Churn")


@register("q_pca_variance")
def q_pca_variance(spark, sf):
    """EDA preprocessing, centred PCA; explained-variance ratio and cumulative per component."""
    ratios, k90, k95, d = T.pca_variance(_eda_features(spark, sf))
    rows, cum = [], 0.0
    for i, r in enumerate(ratios, start=1):
        cum += r
        rows.append((i, round(r, 6), round(cum, 6), k90, k95, d))
    return spark.createDataFrame(rows, "component int, explained_variance_ratio double, cumulative double, "
                                       "k90 int, k95 int, n_features int")


@register("q_pca_projection")
def q_pca_projection(spark, sf):
    """Every customer projected onto the k95 components (S10 layout: id, vector, label)."""
    feats = _eda_features(spark, sf)
    fit = T.pca_fit(feats)
    return T.pca_project(feats, fit.width(0.95), keep=["customerID", "Churn"], fit=fit)


# ------------------------------------------------------------------ training and scoring (M*, P*)
from . import jobs as J  # noqa: E402
from ..config import TrainConfig  # noqa: E402
from ..operators.score import score as _score  # noqa: E402


@register("q_model_comparison")
def q_model_comparison(spark, sf):
    """Stratified CV grid search of four model families over the reference's 42 combinations,
    test report, winner marked, verdict of the default F1 gate."""
    return J.model_comparison(V.subscribers(spark, sf))


# Three fixed "models" over the scored table: one score, three decision thresholds.
_THREE = {"eager": 0.3, "even": 0.5, "strict": 0.8}


@register("q_model_reports", with_views("""
SELECT *, row_number() OVER (ORDER BY f1 DESC, model) = 1 AS is_best, f1 >= 0.5 AS accepted FROM (
  SELECT model, round(2 * tp / (2 * tp + fp + fn), 4) AS f1, round(tp / (tp + fn), 4) AS recall, round(tp / (tp + fp), 4) AS precision,
         round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy, round(auc, 4) AS roc_auc
  FROM (SELECT model, count(*) FILTER (WHERE label = 1 AND score >= cut) AS tp, count(*) FILTER (WHERE label = 0 AND score >= cut) AS fp,
               count(*) FILTER (WHERE label = 1 AND score < cut) AS fn, count(*) FILTER (WHERE label = 0 AND score < cut) AS tn
        FROM scored_lineitem, (VALUES ('eager', 0.3), ('even', 0.5), ('strict', 0.8)) AS m(model, cut) GROUP BY model),
       (SELECT sum(CASE WHEN label = 1 THEN rk ELSE 0 END) AS s, sum(label) AS p, count(*) - sum(label) AS n,
               (s - p * (p + 1) / 2) / (p * n) AS auc
        FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM scored_lineitem)))"""))
def q_model_reports(spark, sf):
    """M6, M7, M10 over fixed predictions: test report of each model, winner, gate's verdict."""
    from ..operators import train as M
    scored = V.scored_lineitem(spark, sf)
    rows = scored.select("label", "score", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (F.col("score") >= c).cast("int").alias("prediction"))
                                                               for m, c in _THREE.items()])).alias("m")).select("label", "score", "m.*")
    table = M.test_reports(rows)
    return M.comparison(table, M.best_model(table.orderBy("model"))["model"])


@register("q_score_batch")
def q_score_batch(spark, sf):
    """A logistic model trained on the training split scores every subscriber."""
    from ..operators import train as M
    raw = V.subscribers(spark, sf)
    train_f, _, tc_med, mc_med = J.prepare_training_frame(raw, TrainConfig())
    num, cat = C.resolve_roles(train_f)
    pre = T.fit_preprocessor(train_f, num, cat)
    tr = J.training_partitions(pre.transform(train_f).select("features", F.col("Churn").cast("double").alias("label")))
    n = tr.count()
    fitted = M.logistic(n).fit(M.balanced(tr, "label"))
    from pyspark.ml import PipelineModel
    from ..operators.score import ChurnModel
    model = ChurnModel(PipelineModel(stages=list(pre.stages) + [fitted]), tc_med, mc_med, num, cat,
                       "LogisticRegression", spec=getattr(pre, "_retainlens_spec", None))
    return _score(model, raw)


# ------------------------------------------------------------------ streaming
from ..streaming import jobs as Z  # noqa: E402

_STREAM_STATS = """count(*) AS total_predictions, count(*) FILTER (WHERE prediction = 1) AS churn_count,
  round(count(*) FILTER (WHERE prediction = 1) * 100 / count(*), 2) AS churn_rate,
  round(avg(churn_probability), 4) AS avg_churn_probability, count(*) FILTER (WHERE risk_level = 'High') AS n_high"""


@register("q_stream_daily_stats", with_views(f"""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start,
       strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d') AS window_end, {_STREAM_STATS}
FROM prediction_log GROUP BY date_trunc('day', ts)"""))
def q_stream_daily_stats(spark, sf):
    """The events table as a file stream, daily tumbling-window stats (watermark, update mode)."""
    s = Z.daily_stats_stream(Z.file_stream(spark, f"{sf}/events.parquet"))
    return Z.run_available_now(s, "daily_stats", "update", keys=["window_start", "window_end"])


@register("q_stream_sliding", with_views(f"""
SELECT strftime(ws, '%Y-%m-%d') AS window_start, strftime(ws + INTERVAL 7 DAY, '%Y-%m-%d') AS window_end, {_STREAM_STATS}
FROM (SELECT *, date_trunc('day', ts) - k * INTERVAL 1 DAY AS ws FROM prediction_log, range(0, 7) AS _k(k))
GROUP BY ws"""))
def q_stream_sliding(spark, sf):
    """Z3: rolling 7-day windows sliding by one day over the event stream."""
    s = Z.sliding_stats_stream(Z.file_stream(spark, f"{sf}/events.parquet"))
    return Z.run_available_now(s, "sliding_stats", "update", keys=["window_start", "window_end"])


@register("q_stream_dedup", with_views("""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT event_id) AS n_events FROM prediction_log GROUP BY 1"""))
def q_stream_dedup(spark, sf):
    """De-duplicate the log stream on event_id within the watermark, then count per day."""
    s = Z.dedup_stream(Z.file_stream(spark, f"{sf}/events.parquet"))
    rows = Z.run_available_now(s, "dedup", "append")
    return rows.groupBy(Z.utc_day("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n_events"))


@register("q_stream_drift", with_views("""
SELECT strftime(w, '%Y-%m-%d') AS window_start, CAST(sum(n) AS BIGINT) AS sample_size, round(max(ks), 6) AS ks_k, round(abs(sum((cf - rf) * ln(cf / rf))), 6) AS psi_risk
FROM (SELECT w, risk_level, greatest(coalesce(count(l.risk_level) / max(nw), 0), 1e-6) AS cf, greatest(max(r.f), 1e-6) AS rf, count(l.risk_level) AS n
      FROM (SELECT DISTINCT w, nw FROM sd_n) CROSS JOIN sd_risk r LEFT JOIN sd_log l USING (w, risk_level) GROUP BY w, risk_level)
JOIN sd_ks USING (w) GROUP BY w""", extra_ctes="""
sd_ev AS (SELECT ts, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
                 CASE WHEN floor(least(value / 200, 1.0) * 10000) / 10000 < CAST(0.3 AS DOUBLE) THEN 'Low'
                      WHEN floor(least(value / 200, 1.0) * 10000) / 10000 < CAST(0.6 AS DOUBLE) THEN 'Medium' ELSE 'High' END AS risk_level FROM events),
sd_ref AS (SELECT * FROM sd_ev WHERE ts < TIMESTAMP '2024-01-08'),
sd_log AS (SELECT *, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '2024-01-08') AS w FROM sd_ev WHERE ts >= TIMESTAMP '2024-01-08'
           AND time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '2024-01-08') + INTERVAL 7 DAY <= (SELECT max(ts) FROM sd_ev) - INTERVAL 1 DAY),
sd_n AS (SELECT w, count(*) AS nw FROM sd_log GROUP BY w),
sd_risk AS (SELECT risk_level, count(*) / sum(count(*)) OVER () AS f FROM sd_ref GROUP BY 1),
sd_cnt AS (SELECT w, k, count(*) FILTER (WHERE side = 0) AS r, count(*) FILTER (WHERE side = 1) AS c
           FROM (SELECT w, s.k, 0 AS side FROM sd_ref s, (SELECT DISTINCT w FROM sd_log) UNION ALL SELECT w, k, 1 FROM sd_log) WHERE k IS NOT NULL GROUP BY 1, 2),
sd_cum AS (SELECT w, sum(r) OVER o / sum(r) OVER (PARTITION BY w) AS fr, sum(c) OVER o / sum(c) OVER (PARTITION BY w) AS fc
           FROM sd_cnt WINDOW o AS (PARTITION BY w ORDER BY k)),
sd_ks AS (SELECT w, max(abs(fr - fc)) AS ks FROM sd_cum GROUP BY w)"""))
def q_stream_drift(spark, sf):
    """Drift of every closed 7-day window of the stream after the first week, which is the reference."""
    from ..config import DriftConfig
    cfg = DriftConfig(numeric_features=("k",), categorical_features=("risk_level",))
    week = F.lit("2024-01-08")
    ref = D.profile(LG.log_features(V.prediction_log(spark, sf).filter(F.col("log_date") < week.cast("date")), "k INT"), cfg)
    ev = Z.prediction_events(Z.file_stream(spark, f"{sf}/events.parquet")).filter(F.to_utc_timestamp(F.col("ts"), "UTC") >= F.lit("2024-01-08T00:00:00Z").cast("timestamp"))
    feats = ev.select("*", F.from_json("input_features", "k INT").alias("_f")).select("*", "_f.k").drop("_f")
    found = Z.drift_windows(feats, ref, cfg)
    rows = found.features.groupBy("window_start").agg(F.max(F.when(F.col("kind") == "ks", r6(F.col("statistic")))).alias("ks_k"),
                                                      F.max(F.when(F.col("kind") == "psi", F.col("statistic"))).alias("psi_risk"))
    return found.report.select("window_start", "sample_size").join(rows, "window_start")


@register("q_folds", with_views("""
SELECT label, fold, count(*) AS n FROM (
  SELECT Churn AS label, CAST((row_number() OVER (PARTITION BY Churn ORDER BY md5('42|' || customerID)) - 1) % 5 AS INTEGER) AS fold
  FROM subs_l) GROUP BY label, fold"""))
def q_folds(spark, sf):
    """Stratified 5-fold assignment — rows per (class, fold)."""
    s = X.stratified_split(C.target_lenient(V.subscribers(spark, sf)), "Churn", "customerID", 0.2, 42)
    return s.groupBy(F.col("Churn").alias("label"), "fold").agg(F.count(F.lit(1)).alias("n"))


@register("q_prefix_many_buckets", with_views("""
SELECT l_returnflag, l_extendedprice, n, sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS cum_n, sum(n) OVER (PARTITION BY l_returnflag) AS tot_n
FROM (SELECT l_returnflag, l_extendedprice, count(*) AS n FROM lineitem GROUP BY ALL)"""))
def q_prefix_many_buckets(spark, sf):
    """W1 over 97 range partitions: running number of lines by price within each return flag."""
    from ..operators.prefix import global_prefix_sum
    n = V.table(spark, sf, "lineitem").groupBy("l_returnflag", "l_extendedprice").agg(F.count(F.lit(1)).alias("n"))
    return global_prefix_sum(n, "l_extendedprice", ["n"], by=["l_returnflag"], buckets=97)


@register("q_reference_sample", with_views("""
SELECT customerID, tenure, MonthlyCharges, TRY_CAST(TotalCharges AS DOUBLE) AS TotalCharges
FROM subscribers ORDER BY md5('42|' || customerID), customerID LIMIT 1000"""))
def q_reference_sample(spark, sf):
    """The 1,000-row seeded reference sample kept for KS (a sampling operator)."""
    s = X.sample_rows(V.subscribers(spark, sf), 1000)
    return s.select("customerID", "tenure", "MonthlyCharges",
                    F.col("TotalCharges").try_cast("double").alias("TotalCharges"))
