"""Monitoring and retrain decisions.

Every decision is a column expression over small report tables; with a ``by`` key one job
decides for many models / periods at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MonitorConfig
from ..functions.expressions import safe_div


def prediction_stats(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total, churn / non-churn counts, churn rate % (2 dp), mean probability (4 dp),
    risk distribution."""
    by = list(by)
    total = F.count(F.lit(1))
    churn = F.count_if(F.col("prediction") == 1)
    return log.groupBy(*by).agg(
        total.alias("total_predictions"), churn.alias("churn_count"),
        (total - churn).alias("non_churn_count"),
        F.round(safe_div(churn * 100, total), 2).alias("churn_rate"),
        F.round(F.avg("churn_probability"), 4).alias("avg_churn_probability"),
        F.count_if(F.col("risk_level") == "Low").alias("n_low"),
        F.count_if(F.col("risk_level") == "Medium").alias("n_medium"),
        F.count_if(F.col("risk_level") == "High").alias("n_high"))


def batch_summary(scored: DataFrame) -> DataFrame:
    """Total, churn_count, churn_rate % (2 dp); an empty batch gives 0 / 0 / 0.0."""
    total = F.count(F.lit(1))
    churn = F.count_if(F.col("prediction") == 1)
    return scored.agg(total.alias("total"), churn.alias("churn_count"),
                      F.round(safe_div(churn * 100, total), 2).alias("churn_rate"))


def latest(df: DataFrame, n: int, order_col: str = "ts", tie: str = "event_id") -> DataFrame:
    """L1: the n newest rows, newest first (a top-n: ``TakeOrderedAndProject``)."""
    keys = [F.desc(order_col)] + ([F.desc(tie)] if tie in df.columns else [])
    return df.orderBy(*keys).limit(n)


def metrics_long(metrics: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Wide metric row(s) → (by..., metric, value)."""
    return metrics.select(*by, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names
    ])).alias("m")).select(*by, "m.*")


def degradation(baseline: DataFrame, current: DataFrame, cfg: MonitorConfig = MonitorConfig(),
                by: Sequence[str] = ()) -> DataFrame:
    """O1: per (by, metric): drop = (base − cur) / base (0 if base ≤ 0), degraded if drop > threshold.

    ``baseline`` is long (metric, value); ``current`` is long (by..., metric, value). Metrics missing
    on either side or without a threshold are skipped (inner joins). The threshold table is a
    handful of literal rows — broadcast."""
    spark = SparkSession.getActiveSession() or current.sparkSession
    th = spark.createDataFrame(list(cfg.thresholds), "metric string, threshold double")
    j = (current.withColumnRenamed("value", "current")
         .join(F.broadcast(baseline.withColumnRenamed("value", "baseline")), "metric")
         .join(F.broadcast(th), "metric"))
    j = j.filter(F.col("baseline").isNotNull() & F.col("current").isNotNull())
    drop = F.when(F.col("baseline") > 0, (F.col("baseline") - F.col("current")) / F.col("baseline")
                  ).otherwise(F.lit(0.0))
    return j.select(*by, "metric", F.round("baseline", 4).alias("baseline"),
                    F.round("current", 4).alias("current"), F.round(drop * 100, 2).alias("drop_pct"),
                    F.round(F.col("threshold") * 100, 2).alias("threshold_pct"),
                    (drop > F.col("threshold")).alias("degraded"))


def performance_status(deg: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """O1 roll-up: healthy (0 degraded) / degraded (1) / critical (≥ 2)."""
    n = F.count_if("degraded")
    g = deg.groupBy(*by) if by else deg.groupBy()
    return g.agg(n.alias("n_degraded"), F.count(F.lit(1)).alias("total_checked"),
                 F.array_join(F.array_sort(F.collect_list(F.when(F.col("degraded"), F.col("metric")))), ",")
                 .alias("degraded_metrics")).select(
        *by, (F.col("n_degraded") == 0).alias("performance_ok"), "n_degraded", "total_checked",
        "degraded_metrics",
        F.when(F.col("n_degraded") == 0, F.lit("healthy")).when(F.col("n_degraded") <= 1, F.lit("degraded"))
         .otherwise(F.lit("critical")).alias("status"))


def full_check(signals: DataFrame, drift_col: str = "drift_detected", perf_ok_col: str = "performance_ok"
               ) -> DataFrame:
    """O2: drift ∧ perf → retrain_needed (retrain); perf → degraded (retrain, as the code does);
    drift → drift_warning (no retrain); none → stable."""
    drift, bad = F.col(drift_col), ~F.col(perf_ok_col)
    decision = (F.when(drift & bad, F.lit("retrain_needed")).when(bad, F.lit("degraded"))
                .when(drift, F.lit("drift_warning")).otherwise(F.lit("stable")))
    reasons = F.concat_ws(";", F.when(drift, F.lit("data_drift")), F.when(bad, F.lit("performance_degradation")))
    return signals.withColumn("decision", decision)\
                  .withColumn("retrain_recommended", bad)\
                  .withColumn("reasons", reasons)


def cooldown(history: DataFrame, as_of: str, hours: float = 24.0, ts_col: str = "ts",
             by: Sequence[str] = ()) -> DataFrame:
    """O3: hours since the last event (per key) at ``as_of``; allowed when ≥ ``hours``."""
    g = history.groupBy(*by) if by else history.groupBy()
    last = g.agg(F.max(F.col(ts_col)).alias("last_event"))
    since = (F.unix_micros(F.lit(as_of).cast("timestamp"))
             - F.unix_micros(F.col("last_event").cast("timestamp"))) / 3.6e9
    return last.select(*by, F.col("last_event"), F.round(since, 4).alias("hours_since_last"),
                       (F.col("last_event").isNull() | (since >= hours)).alias("cooldown_ok"))


def retrain_gate(signals: DataFrame, force: bool = False, enabled: bool = True, auto: bool = True,
                 reason: str = "drift", needed_col: str = "retrain_recommended",
                 cooldown_col: str = "cooldown_ok") -> DataFrame:
    """O4, in the reference's order: force → go; disabled → no; not auto ∧ reason ≠ manual → no;
    report says no need → no; cooldown not passed → no; else go."""
    needed, cool = F.col(needed_col), F.col(cooldown_col)
    go = (F.when(F.lit(force), F.lit(True)).when(~F.lit(enabled), F.lit(False))
          .when(~F.lit(auto) & (F.lit(reason) != "manual"), F.lit(False))
          .when(~needed, F.lit(False)).when(~cool, F.lit(False)).otherwise(F.lit(True)))
    why = (F.when(F.lit(force), F.lit("forced")).when(~F.lit(enabled), F.lit("retraining disabled"))
           .when(~F.lit(auto) & (F.lit(reason) != "manual"), F.lit("auto retrain off"))
           .when(~needed, F.lit("not needed")).when(~cool, F.lit("cooldown active"))
           .otherwise(F.lit("retrain approved")))
    return signals.withColumn("should_retrain", go).withColumn("gate_reason", why)
