"""The EDA frame: lenient target → TotalCharges imputation → engineered features."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.cleaning import clean_total_charges, fit_cleaning_medians, target_lenient
from ..operators.features import add_features
from ..session import cut_lineage


def eda_frame(subs: DataFrame, target: str = "Churn") -> DataFrame:
    """Fits both medians in one job, then one projection: clean + ten features. The view is written once,
    so that neither the fit nor what follows joins and aggregates its sources again."""
    df = cut_lineage(target_lenient(subs, target))
    tc_med, mc_med = fit_cleaning_medians(df)
    df = clean_total_charges(df, tc_med, fit=False)
    return add_features(df, mc_med, fit=False)


EDA_NUMERIC = ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges", "LoyaltyIndex",
               "TotalAddOnServices", "UnitCost", "AvgPaidPerMonth", "ChargeGap",
               "RiskScope_Fiber_NoSupport_NoSec", "IsMonthToMonth", "IsPaperless", "IsElectronicCheck"]
EDA_CATEGORICAL = ["gender", "Partner", "Dependents", "PhoneService", "MultipleLines",
                   "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
                   "TechSupport", "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling",
                   "PaymentMethod", "TenureBucket"]
SUBSCRIBER_CATEGORICAL = EDA_CATEGORICAL[:-1]
