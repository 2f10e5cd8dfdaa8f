"""C* and F* operators: property, boundary and rule tests (reference model: transformation tests)."""

import pytest
from pyspark.sql import functions as F

from retainlens.functions.expressions import risk_band, tenure_bucket
from retainlens.operators import cleaning as C
from retainlens.operators.features import FEATURE_NAMES, add_features
from retainlens.plans import views as V


def _raw(spark):
    rows = [("a", 0, 20.0, " ", "Yes"), ("b", 10, 30.0, " ", "No"), ("c", 5, None, " ", "No"),
            ("d", 3, 10.0, "30.5", "Yes"), ("e", 8, 12.0, "100", "No")]
    return spark.createDataFrame(rows, "customerID string, tenure int, MonthlyCharges double, "
                                       "TotalCharges string, Churn string")


def test_total_charges_rules(spark):
    out = {r["customerID"]: r["TotalCharges"] for r in C.clean_total_charges(_raw(spark)).collect()}
    assert out["a"] == 0.0                      # rule 1: tenure 0
    assert out["b"] == 300.0                    # rule 2: MonthlyCharges × tenure
    # rule 3: median after rule 1 over {0.0, 30.5, 100.0} = 30.5
    assert out["c"] == 30.5
    assert out["d"] == 30.5 and out["e"] == 100.0
    assert all(v is not None for v in out.values())


def test_total_charges_without_tenure_uses_plain_median(spark):
    df = _raw(spark).drop("tenure")
    out = [r["TotalCharges"] for r in C.clean_total_charges(df).collect()]
    assert sorted(out) == sorted([65.25, 65.25, 65.25, 30.5, 100.0])


def test_target_strict_and_lenient(spark):
    df = spark.createDataFrame([("Yes",), ("No",), ("1",), ("maybe",)], "Churn string")
    assert [r[0] for r in C.target_lenient(df).collect()] == [1, 0, 1, 0]
    with pytest.raises(Exception):
        C.target_strict(df).collect()
    ok = C.target_strict(df.filter(F.col("Churn").isin("Yes", "No"))).collect()
    assert [r[0] for r in ok] == [1, 0]


def test_validate_rows(spark):
    df = spark.createDataFrame([("1", 24, 10.0, "5", 0), ("2", -5, 10.0, "5", 0), ("3", 80, -1.0, "x", 2)],
                               "customerID string, tenure int, MonthlyCharges double, TotalCharges string, "
                               "SeniorCitizen int")
    good, bad = C.split_valid(df)
    assert [r["customerID"] for r in good.collect()] == ["1"]
    v = {r["customerID"]: set(r["violations"]) for r in bad.collect()}
    assert v["2"] == {"tenure_range"}
    assert v["3"] == {"tenure_range", "MonthlyCharges_negative", "TotalCharges_type", "SeniorCitizen_domain"}


def test_project_defaults_keeps_known_fields_only(spark):
    df = spark.createDataFrame([(36, 99.0, "x")], "tenure int, MonthlyCharges double, unknown_field string")
    out = C.project_defaults(df).first().asDict()
    assert out["tenure"] == 36 and out["MonthlyCharges"] == 99.0
    assert "unknown_field" not in out and out["Contract"] == "Month-to-month"
    assert out["customerID"] == "PREDICT_USER" and out["TotalCharges"] == 0.0


@pytest.mark.parametrize("t,label", [(0, "0-6"), (6, "0-6"), (7, "7-12"), (12, "7-12"), (13, "13-24"),
                                     (48, "25-48"), (72, "49-72"), (73, "72+"), (None, "0-6"), (-5, "nan")])
def test_tenure_bucket_right_closed(spark, t, label):
    df = spark.createDataFrame([(t,)], "tenure int")
    assert df.select(tenure_bucket("tenure")).first()[0] == label


@pytest.mark.parametrize("p,band", [(0.0, "Low"), (0.15, "Low"), (0.29, "Low"), (0.3, "Medium"), (0.45, "Medium"),
                                    (0.59, "Medium"), (0.6, "High"), (0.85, "High"), (1.0, "High")])
def test_risk_bands(spark, p, band):
    assert spark.createDataFrame([(p,)], "p double").select(risk_band("p")).first()[0] == band


def test_add_features_properties(spark, sf):
    subs = C.clean_total_charges(C.target_lenient(V.subscribers(spark, sf)))
    out = add_features(subs)
    assert set(FEATURE_NAMES) <= set(out.columns)
    assert len(out.columns) == len(subs.columns) + 10
    rows = out.collect()
    assert all(0 <= r["TotalAddOnServices"] <= 6 for r in rows)
    assert {r["TenureBucket"] for r in rows} <= {"0-6", "7-12", "13-24", "25-48", "49-72", "72+"}
    assert all(r["TotalCharges"] is not None for r in rows)
    fiber = [r for r in rows if r["InternetService"] == "Fiber optic" and r["TechSupport"] == "No"
             and r["OnlineSecurity"] == "No"]
    assert all(r["RiskScope_Fiber_NoSupport_NoSec"] == 1 for r in fiber)
    assert all(r["RiskScope_Fiber_NoSupport_NoSec"] == 0 for r in rows if r["InternetService"] == "DSL")


def test_features_absent_inputs(spark):
    df = spark.createDataFrame([(1,)], "x int")
    out = add_features(df).first().asDict()
    assert out["TotalAddOnServices"] == 0 and out["IsMonthToMonth"] == 0 and out["IsPaperless"] == 0
    assert "LoyaltyIndex" not in out and "TenureBucket" not in out
