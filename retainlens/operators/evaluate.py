"""Classification evaluation (E1–E8): confusion matrix, metrics, exact ROC-AUC / average precision
and curves.

Curves and areas are computed on the score-ordered table of distinct scores (ties pre-aggregated,
map-side) with :func:`global_prefix_sum`, so they stay exact and distributed — MLlib's
``BinaryClassificationEvaluator`` bins scores (``numBins``) and its ``areaUnderPR`` is a trapezoid,
not average precision.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import safe_div
from ..session import cut_lineage
from .prefix import global_prefix_sum
from .rows import combine_rows, null_safe_join


def _by(by):
    return list(by) if by else []


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction",
              by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """Always 2×2 — tn, fp, fn, tp, their rates over the total, actual / predicted totals."""
    y, p = F.col(label), F.col(prediction)
    g = df.groupBy(*_by(by))
    m = g.agg(F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
              F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"),
              F.count(F.lit(1)).alias("total"))
    tot = F.col("total")
    return m.select(*_by(by), "tn", "fp", "fn", "tp", "total",
                    *[F.round(safe_div(c, tot), digits).alias(f"{c}_rate") for c in ("tn", "fp", "fn", "tp")],
                    (F.col("tp") + F.col("fn")).alias("actual_positive"),
                    (F.col("tn") + F.col("fp")).alias("actual_negative"),
                    (F.col("tp") + F.col("fp")).alias("predicted_positive"),
                    (F.col("tn") + F.col("fn")).alias("predicted_negative"))


def metrics_from_confusion(cm: DataFrame, by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """Accuracy, precision, recall, F1 of class 1 (zero denominators → 0)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec = safe_div(tp, tp + fp)
    rec = safe_div(tp, tp + fn)
    f1 = safe_div(2 * tp, 2 * tp + fp + fn)
    acc = safe_div(tp + tn, tp + tn + fp + fn)
    return cm.select(*_by(by), F.round(acc, digits).alias("accuracy"), F.round(prec, digits).alias("precision"),
                     F.round(rec, digits).alias("recall"), F.round(f1, digits).alias("f1"))


def metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
            by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    return metrics_from_confusion(confusion(df, label, prediction, by, digits), by, digits)


def score_table(df: DataFrame, label: str = "label", score: str = "score",
                by: Sequence[str] = ()) -> DataFrame:
    """Distinct scores (descending) with tp / fp at the score and cumulative cum_tp / cum_fp,
    plus group totals tot_tp (= P) and tot_fp (= N)."""
    return global_prefix_sum(_distinct_scores(df, label, score, _by(by)), "score", ["tp", "fp"], by=_by(by), descending=True)


def _distinct_scores(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    return (df.filter(F.col(score).isNotNull())
           .groupBy(*by, F.col(score).alias("score"))
           .agg(F.sum(F.col(label).cast("long")).alias("tp"),
                F.sum((1 - F.col(label)).cast("long")).alias("fp")))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()
            ) -> DataFrame:
    """Exact ROC-AUC with ties counted half (trapezoid over distinct thresholds)."""
    st = score_table(df, label, score, by)
    num = F.sum(F.col("fp").cast("double") * (2 * F.col("cum_tp") - F.col("tp")).cast("double"))
    den = 2.0 * F.max("tot_tp").cast("double") * F.max("tot_fp").cast("double")
    return st.groupBy(*_by(by)).agg(F.when(den > 0, num / den).alias("roc_auc"))


def average_precision(df: DataFrame, label: str = "label", score: str = "score",
                      by: Sequence[str] = ()) -> DataFrame:
    """AP = Σ (R_k − R_{k−1}) · P_k over distinct thresholds (step sum, not trapezoid)."""
    st = score_table(df, label, score, by)
    term = (F.try_divide(F.col("tp"), F.col("tot_tp"))
            * F.try_divide(F.col("cum_tp"), F.col("cum_tp") + F.col("cum_fp")))
    return st.groupBy(*_by(by)).agg(F.when(F.max("tot_tp") > 0, F.sum(term)).alias("average_precision"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (), drop_intermediate: bool = False
              ) -> DataFrame:
    """E5: (threshold, fpr, tpr) at every distinct score, plus the (0, 0) start (threshold null).

    With ``drop_intermediate`` (the reference's curve) only the first and the last score and the turning points are
    kept: a point lies within a straight run if the next score brings as many positives and negatives as it did. The
    next score is found by rank, from the same prefix sums, so runs go on over the borders of partitions.
    """
    by = _by(by)
    if drop_intermediate:
        st = cut_lineage(global_prefix_sum(_distinct_scores(df, label, score, by).withColumn("one", F.lit(1)), "score", ["tp", "fp", "one"], by=by, descending=True))
        after = st.select(*by, (F.col("cum_one") - 1).alias("cum_one"), F.col("tp").alias("_tp"), F.col("fp").alias("_fp"))
        ends = (F.col("cum_one") == 1) | (F.col("cum_one") == F.col("tot_one"))
        st = null_safe_join(st, after, [*by, "cum_one"], "left").filter(ends | (F.col("tp") != F.col("_tp")) | (F.col("fp") != F.col("_fp")))
    else:
        st = score_table(df, label, score, by)
    pts = st.select(*by, F.col("score").alias("threshold"),
                    safe_div("cum_fp", "tot_fp").alias("fpr"), safe_div("cum_tp", "tot_tp").alias("tpr"))
    start = st.select(*by).distinct().select(*by, F.lit(None).cast("double").alias("threshold"),
                                             F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def pr_curve(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()
             ) -> DataFrame:
    """(threshold, precision, recall) per distinct score, plus the (precision 1, recall 0) end."""
    by = _by(by)
    st = score_table(df, label, score, by)
    pts = st.select(*by, F.col("score").alias("threshold"),
                    safe_div("cum_tp", F.col("cum_tp") + F.col("cum_fp")).alias("precision"),
                    F.when(F.col("tot_tp") == 0, F.lit(1.0))
                     .otherwise(F.col("cum_tp") / F.col("tot_tp")).alias("recall"))
    end = st.select(*by).distinct().select(*by, F.lit(None).cast("double").alias("threshold"),
                                           F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                 digits: int = 4) -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and weighted averages."""
    cm = confusion(df, label, prediction)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    per = cm.select(F.explode(F.array(
        F.struct(F.lit("0").alias("class"), safe_div(tn, tn + fn).alias("precision"),
                 safe_div(tn, tn + fp).alias("recall"), safe_div(2 * tn, 2 * tn + fn + fp).alias("f1"),
                 (tn + fp).alias("support")),
        F.struct(F.lit("1").alias("class"), safe_div(tp, tp + fp).alias("precision"),
                 safe_div(tp, tp + fn).alias("recall"), safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
                 (tp + fn).alias("support")),
    )).alias("r"), safe_div(tp + tn, F.col("total")).alias("acc"), F.col("total")).select("r.*", "acc", "total")
    n = F.sum("support")
    summary = per.agg(
        F.first("acc").alias("acc"), n.alias("n"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / n).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / n).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("wf"))
    rows = summary.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("class"), F.col("acc").alias("precision"), F.col("acc").alias("recall"),
                 F.col("acc").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                 F.col("wf").alias("f1"), F.col("n").alias("support")),
    )).alias("r")).select("r.*")
    out = per.select("class", "precision", "recall", "f1", "support").unionByName(rows)
    return out.select("class", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")],
                      F.col("support").cast("long").alias("support"))


def evaluation_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                      score: str = "score", by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """One row per group with the confusion counts, metrics, ROC-AUC and average precision."""
    by = _by(by)
    cm = confusion(df, label, prediction, by, digits)
    met = metrics_from_confusion(cm, by, digits)
    auc = roc_auc(df, label, score, by)
    ap = average_precision(df, label, score, by)
    if by:
        out = cm
        for part, how in ((met, "inner"), (auc, "left"), (ap, "left")):
            out = null_safe_join(out, part, by, how)
    else:  # four one-row frames: combined without a join
        out = combine_rows(cm, met, auc, ap)
    return out.withColumn("roc_auc", F.round("roc_auc", digits))\
              .withColumn("average_precision", F.round("average_precision", digits))
