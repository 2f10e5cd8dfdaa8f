"""Views that re-express the driver tables in the attrition data model.

* ``subscribers``     — one row per customer with the 21 telco-style columns (raw: TotalCharges
                        is a string, Churn is Yes/No).
* ``prediction_log``  — one row per event, shaped like the prediction-log record.
* ``scored_lineitem`` — label / score / prediction triples for the evaluation operators.
* ``drift_ref`` / ``drift_cur`` — reference and current windows of ``orders`` for drift.

The column rules are fixed values shared with the DuckDB oracle (see ``plans/oracle.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table  # noqa: F401  (re-exported for the catalogue)

# Fixed values of the view rules.
ADDON_MODULI = {"OnlineSecurity": 7, "OnlineBackup": 11, "DeviceProtection": 13,
                "TechSupport": 17, "StreamingTV": 19, "StreamingMovies": 23}
CHURN_CUTOFF = "2000-11-04 00:00:00"
DRIFT_SPLIT = "1998-05-01 00:00:00"
LOG_AS_OF = "2024-01-30"

SUBSCRIBER_COLUMNS = [
    "customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure", "PhoneService",
    "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
    "TechSupport", "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling",
    "PaymentMethod", "MonthlyCharges", "TotalCharges", "Churn",
]


def _yes(cond):
    return F.when(cond, F.lit("Yes")).otherwise(F.lit("No"))


def order_aggregate(orders: DataFrame) -> DataFrame:
    """Per-customer order count, last order date and total (money summed as decimal).

    A partial (map-side) hash aggregate on ``o_custkey``: a hot customer holding a third of all
    orders collapses to one row per map task before the shuffle."""
    return (orders.groupBy("o_custkey")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.max("o_orderdate").alias("l"),
                 F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("t")))


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer ⟕ per-customer order aggregate.

    The aggregate's output is hash-partitioned on the join key, so a sort-merge join only
    shuffles ``customer``; when the planner's size check allows, the aggregate is broadcast.
    """
    cust = table(spark, sf_dir, "customer")
    return subscriber_rows(cust, order_aggregate(table(spark, sf_dir, "orders")))


def subscriber_rows(customers: DataFrame, per_cust: DataFrame) -> DataFrame:
    """The 21 subscriber columns from customers (batch or stream) ⟕ the order aggregate."""
    cust = customers.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    j = cust.join(per_cust, cust.c_custkey == per_cust.o_custkey, "left")
    k, nk, seg = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_mktsegment")
    n = F.coalesce(F.col("n"), F.lit(0))
    t = F.col("t")
    addons = {
        name: F.when(seg == "MACHINERY", F.lit("No internet service"))
               .otherwise(_yes((k % p) < (p // 2)))
        for name, p in ADDON_MODULI.items()
    }
    cols = {
        "customerID": F.col("c_name"),
        "gender": F.when(k % 2 == 0, F.lit("Female")).otherwise(F.lit("Male")),
        "SeniorCitizen": F.when(k % 6 == 0, F.lit(1)).otherwise(F.lit(0)),
        "Partner": _yes(nk % 2 == 0),
        "Dependents": _yes(nk % 3 == 0),
        "tenure": ((k * 7919) % 81).cast("int"),
        "PhoneService": _yes(k % 10 < 9),
        "MultipleLines": F.when(k % 10 == 9, F.lit("No phone service")).otherwise(_yes(k % 3 == 0)),
        "InternetService": F.when(seg.isin("AUTOMOBILE", "BUILDING"), F.lit("Fiber optic"))
                            .when(seg.isin("FURNITURE", "HOUSEHOLD"), F.lit("DSL"))
                            .otherwise(F.lit("No")),
        **addons,
        "Contract": F.when(n < 8, F.lit("Month-to-month")).when(n < 12, F.lit("One year"))
                     .otherwise(F.lit("Two year")),
        "PaperlessBilling": _yes(k % 5 < 3),
        "PaymentMethod": F.element_at(
            F.array(F.lit("Electronic check"), F.lit("Mailed check"),
                    F.lit("Bank transfer (automatic)"), F.lit("Credit card (automatic)")),
            (nk % 4 + 1).cast("int")),
        "MonthlyCharges": F.when(n > 0, F.floor(t / n / 2500 * 100) / 100),
        "TotalCharges": F.when((n == 0) | (k % 50 == 0), F.lit(" ")).otherwise(
            (F.floor(t / 25) / 100).cast("decimal(18,2)").cast("string")),
        "Churn": _yes(F.col("l").isNull() | (F.col("l") < F.lit(CHURN_CUTOFF).cast("timestamp_ntz"))),
    }
    return j.select(*[c.alias(name) for name, c in cols.items()])


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` shaped as prediction-log records (ts kept as timestamp_ntz, plus ``log_date``)."""
    ev = table(spark, sf_dir, "events")
    prob = F.floor(F.least(F.col("value") / 200, F.lit(1.0)) * 10000) / 10000
    return ev.select(
        "event_id",
        "ts",
        F.concat(F.lit("CUST-"), F.col("user_id").cast("string")).alias("customerID"),
        F.when(F.col("value") >= 60, F.lit(1)).otherwise(F.lit(0)).alias("prediction"),
        prob.alias("churn_probability"),
        F.when(prob < 0.3, F.lit("Low")).when(prob < 0.6, F.lit("Medium"))
         .otherwise(F.lit("High")).alias("risk_level"),
        F.lit("v1").alias("model_version"),
        F.col("props").alias("input_features"),
        F.to_date("ts").alias("log_date"),
    )


def scored_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label = returned, score = 10 × discount (11 distinct values, heavy ties)."""
    li = table(spark, sf_dir, "lineitem")
    score = F.col("l_discount") * 10
    return li.select(
        F.col("l_orderkey"), F.col("l_linenumber"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("prediction"),
        F.year("l_shipdate").alias("ship_year"),
    )


def drift_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.filter(F.col("o_orderdate") < F.lit(DRIFT_SPLIT).cast("timestamp_ntz"))


def drift_cur(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.filter(~(F.col("o_orderdate") < F.lit(DRIFT_SPLIT).cast("timestamp_ntz")))
