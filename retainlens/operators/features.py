"""Feature engineering (F0–F11): one ``withColumns`` projection → a single codegen stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ColumnRoles
from ..functions.expressions import contains_ci, safe_double, tenure_bucket, yes_no_flag
from .prefix import exact_quantile_scalars

FEATURE_NAMES = ("LoyaltyIndex", "TotalAddOnServices", "UnitCost", "AvgPaidPerMonth", "ChargeGap",
                 "RiskScope_Fiber_NoSupport_NoSec", "IsMonthToMonth", "IsPaperless",
                 "IsElectronicCheck", "TenureBucket")


def fit_monthly_median(df: DataFrame) -> float | None:
    """Median of MonthlyCharges — the F3 fill value, fitted once (exact, distributed)."""
    if "MonthlyCharges" not in df.columns:
        return None
    dt = df.schema["MonthlyCharges"].dataType
    return exact_quantile_scalars(df.select(safe_double("MonthlyCharges", dt).alias("_m")), "_m", [0.5])[0]


def add_features(df: DataFrame, monthly_median: float | None = None, fit: bool = True,
                 addons: Sequence[str] = ColumnRoles().addons) -> DataFrame:
    """the ten engineered columns in dependency order; original columns kept.

    Absent inputs: LoyaltyIndex / UnitCost / AvgPaidPerMonth / ChargeGap / TenureBucket are
    skipped; the flag features become 0.
    """
    if monthly_median is None and fit and "MonthlyCharges" in df.columns:
        monthly_median = fit_monthly_median(df)
    coerce, new = feature_exprs({f.name: f.dataType for f in df.schema.fields}, monthly_median, addons)
    return df.withColumns(coerce).withColumns(new)


def feature_exprs(dt: dict, monthly_median: float | None,
                  addons: Sequence[str] = ColumnRoles().addons) -> tuple[dict, dict]:
    """(coercions, new features) as Column expressions for a schema — built once, reusable."""
    cols = set(dt)
    coerce = {c: safe_double(c, dt[c]) for c in ("tenure", "MonthlyCharges", "TotalCharges") if c in cols}
    ten0 = F.coalesce(F.col("tenure"), F.lit(0.0)) if "tenure" in cols else None
    new = {}
    if "tenure" in cols:
        new["LoyaltyIndex"] = F.log1p(ten0)                                           # F1
    present_addons = [c for c in addons if c in cols]
    addon_sum = F.lit(0)
    for c in present_addons:
        addon_sum = addon_sum + yes_no_flag(c, dt[c])
    new["TotalAddOnServices"] = addon_sum.cast("int")                                 # F2
    if "MonthlyCharges" in cols:
        new["UnitCost"] = (F.coalesce(F.col("MonthlyCharges"), F.lit(monthly_median).cast("double"))
                           / (new["TotalAddOnServices"] + 1))                        # F3
    if "TotalCharges" in cols and "tenure" in cols:
        apm = F.try_divide(F.col("TotalCharges"), ten0 + 1)
        new["AvgPaidPerMonth"] = apm                                                 # F4
        if "MonthlyCharges" in cols:
            new["ChargeGap"] = F.abs(F.col("MonthlyCharges") - apm)                  # F5
    if {"InternetService", "TechSupport", "OnlineSecurity"} <= cols:
        no_support = F.lower(F.coalesce(F.col("TechSupport").cast("string"), F.lit("No"))) == "no"
        no_sec = F.lower(F.coalesce(F.col("OnlineSecurity").cast("string"), F.lit("No"))) == "no"
        new["RiskScope_Fiber_NoSupport_NoSec"] = (
            contains_ci("InternetService", "fiber") & no_support & no_sec).cast("int")  # F6
    else:
        new["RiskScope_Fiber_NoSupport_NoSec"] = F.lit(0)
    new["IsMonthToMonth"] = (contains_ci("Contract", "month").cast("int")
                             if "Contract" in cols else F.lit(0))                     # F7
    new["IsPaperless"] = (yes_no_flag("PaperlessBilling", dt["PaperlessBilling"])
                          if "PaperlessBilling" in cols else F.lit(0))                # F8
    new["IsElectronicCheck"] = (contains_ci("PaymentMethod", "electronic").cast("int")
                                if "PaymentMethod" in cols else F.lit(0))             # F9
    if "tenure" in cols:
        new["TenureBucket"] = tenure_bucket("tenure")                                # F10
    return coerce, new
