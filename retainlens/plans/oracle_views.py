"""DuckDB SQL for the views of ``plans/views.py`` (the correctness oracle's side).

Same fixed rules, written independently in SQL, so each query is checked end to end.
"""

# The view rules (see FIXTURES.md, part B).
SUBSCRIBERS_SQL = """
per_cust AS (
  SELECT o_custkey, count(*) AS n, max(o_orderdate) AS l,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS t
  FROM orders GROUP BY o_custkey),
subs_base AS (
  SELECT c.c_custkey, c.c_name, c.c_nationkey, c.c_mktsegment,
         coalesce(p.n, 0) AS n, p.l, p.t
  FROM customer c LEFT JOIN per_cust p ON c.c_custkey = p.o_custkey),
subscribers AS (
  SELECT
    c_name AS customerID,
    CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
    CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS SeniorCitizen,
    CASE WHEN c_nationkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS Partner,
    CASE WHEN c_nationkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS Dependents,
    CAST((c_custkey * 7919) % 81 AS INTEGER) AS tenure,
    CASE WHEN c_custkey % 10 < 9 THEN 'Yes' ELSE 'No' END AS PhoneService,
    CASE WHEN c_custkey % 10 = 9 THEN 'No phone service'
         WHEN c_custkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS MultipleLines,
    CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'Fiber optic'
         WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'DSL' ELSE 'No' END AS InternetService,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'No internet service'
         WHEN c_custkey % 7 < 3 THEN 'Yes' ELSE 'No' END AS OnlineSecurity,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'No internet service'
         WHEN c_custkey % 11 < 5 THEN 'Yes' ELSE 'No' END AS OnlineBackup,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'No internet service'
         WHEN c_custkey % 13 < 6 THEN 'Yes' ELSE 'No' END AS DeviceProtection,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'No internet service'
         WHEN c_custkey % 17 < 8 THEN 'Yes' ELSE 'No' END AS TechSupport,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'No internet service'
         WHEN c_custkey % 19 < 9 THEN 'Yes' ELSE 'No' END AS StreamingTV,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'No internet service'
         WHEN c_custkey % 23 < 11 THEN 'Yes' ELSE 'No' END AS StreamingMovies,
    CASE WHEN n < 8 THEN 'Month-to-month' WHEN n < 12 THEN 'One year' ELSE 'Two year' END AS Contract,
    CASE WHEN c_custkey % 5 < 3 THEN 'Yes' ELSE 'No' END AS PaperlessBilling,
    CASE c_nationkey % 4 WHEN 0 THEN 'Electronic check' WHEN 1 THEN 'Mailed check'
         WHEN 2 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END AS PaymentMethod,
    CASE WHEN n > 0 THEN floor(t / n / 2500 * 100) / 100 END AS MonthlyCharges,
    CASE WHEN n = 0 OR c_custkey % 50 = 0 THEN ' '
         ELSE CAST(CAST(floor(t / 25) / 100 AS DECIMAL(18,2)) AS VARCHAR) END AS TotalCharges,
    CASE WHEN l IS NULL OR l < TIMESTAMP '2000-11-04 00:00:00' THEN 'Yes' ELSE 'No' END AS Churn
  FROM subs_base)"""

PREDICTION_LOG_SQL = """
prediction_log AS (
  SELECT event_id, ts, 'CUST-' || CAST(user_id AS VARCHAR) AS customerID,
         CASE WHEN value >= 60 THEN 1 ELSE 0 END AS prediction,
         floor(least(value / 200, 1.0) * 10000) / 10000 AS churn_probability,
         CASE WHEN floor(least(value / 200, 1.0) * 10000) / 10000 < CAST(0.3 AS DOUBLE) THEN 'Low'
              WHEN floor(least(value / 200, 1.0) * 10000) / 10000 < CAST(0.6 AS DOUBLE) THEN 'Medium'
              ELSE 'High' END AS risk_level,
         'v1' AS model_version, props AS input_features, CAST(ts AS DATE) AS log_date
  FROM events)"""

SCORED_LINEITEM_SQL = """
scored_lineitem AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
         l_discount * 10 AS score,
         CASE WHEN l_discount * 10 >= 0.5 THEN 1 ELSE 0 END AS prediction,
         CAST(year(l_shipdate) AS INTEGER) AS ship_year
  FROM lineitem)"""

DRIFT_SQL = """
drift_ref AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-05-01 00:00:00'),
drift_cur AS (SELECT * FROM orders WHERE o_orderdate IS NULL OR o_orderdate >= TIMESTAMP '1998-05-01 00:00:00')"""

# EDA frame: lenient target → TotalCharges imputation → the ten engineered features.
EDA_SQL = """
subs_l AS (
  SELECT * REPLACE (CASE WHEN Churn IN ('Yes', '1') THEN 1 ELSE 0 END AS Churn) FROM subscribers),
tc_rule1 AS (
  SELECT *, CASE WHEN TRY_CAST(TotalCharges AS DOUBLE) IS NULL AND coalesce(CAST(tenure AS DOUBLE), 0) = 0
                 THEN 0.0 ELSE TRY_CAST(TotalCharges AS DOUBLE) END AS tc1
  FROM subs_l),
cleaned AS (
  SELECT * EXCLUDE (tc1) REPLACE (
           coalesce(tc1, MonthlyCharges * CAST(tenure AS DOUBLE),
                    (SELECT quantile_cont(tc1, 0.5) FROM tc_rule1)) AS TotalCharges)
  FROM tc_rule1),
feat_base AS (
  SELECT * REPLACE (CAST(tenure AS DOUBLE) AS tenure),
         (CASE WHEN lower(trim(OnlineSecurity)) = 'yes' THEN 1 ELSE 0 END
          + CASE WHEN lower(trim(OnlineBackup)) = 'yes' THEN 1 ELSE 0 END
          + CASE WHEN lower(trim(DeviceProtection)) = 'yes' THEN 1 ELSE 0 END
          + CASE WHEN lower(trim(TechSupport)) = 'yes' THEN 1 ELSE 0 END
          + CASE WHEN lower(trim(StreamingTV)) = 'yes' THEN 1 ELSE 0 END
          + CASE WHEN lower(trim(StreamingMovies)) = 'yes' THEN 1 ELSE 0 END) AS TotalAddOnServices
  FROM cleaned),
eda AS (
  SELECT *,
    ln(1 + coalesce(tenure, 0)) AS LoyaltyIndex,
    coalesce(MonthlyCharges, (SELECT quantile_cont(MonthlyCharges, 0.5) FROM cleaned))
      / (TotalAddOnServices + 1) AS UnitCost,
    TotalCharges / (coalesce(tenure, 0) + 1) AS AvgPaidPerMonth,
    abs(MonthlyCharges - TotalCharges / (coalesce(tenure, 0) + 1)) AS ChargeGap,
    CASE WHEN coalesce(contains(lower(InternetService), 'fiber'), false)
              AND lower(coalesce(TechSupport, 'No')) = 'no'
              AND lower(coalesce(OnlineSecurity, 'No')) = 'no' THEN 1 ELSE 0 END
      AS RiskScope_Fiber_NoSupport_NoSec,
    CASE WHEN coalesce(contains(lower(Contract), 'month'), false) THEN 1 ELSE 0 END AS IsMonthToMonth,
    CASE WHEN lower(trim(PaperlessBilling)) = 'yes' THEN 1 ELSE 0 END AS IsPaperless,
    CASE WHEN coalesce(contains(lower(PaymentMethod), 'electronic'), false) THEN 1 ELSE 0 END
      AS IsElectronicCheck,
    CASE WHEN coalesce(tenure, 0) <= -1 THEN 'nan'
         WHEN coalesce(tenure, 0) <= 6 THEN '0-6' WHEN coalesce(tenure, 0) <= 12 THEN '7-12'
         WHEN coalesce(tenure, 0) <= 24 THEN '13-24' WHEN coalesce(tenure, 0) <= 48 THEN '25-48'
         WHEN coalesce(tenure, 0) <= 72 THEN '49-72' WHEN coalesce(tenure, 0) <= 1000000000 THEN '72+'
         ELSE 'nan' END AS TenureBucket
  FROM feat_base)"""

ALL_VIEWS = ",".join([SUBSCRIBERS_SQL, PREDICTION_LOG_SQL, SCORED_LINEITEM_SQL, DRIFT_SQL, EDA_SQL])


def with_views(select_sql: str, extra_ctes: str = "") -> str:
    """Prefix a query with the view CTEs (DuckDB only evaluates the ones it references)."""
    ctes = ALL_VIEWS + ("," + extra_ctes if extra_ctes else "")
    return "WITH RECURSIVE " + ctes + "\n" + select_sql
