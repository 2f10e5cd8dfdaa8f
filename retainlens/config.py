"""Configuration as frozen dataclasses (defaults = the reference's YAML values)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ColumnRoles:
    """Column roles of the customer table (config; resolved against ``df.columns`` at run time)."""
    # Configured numeric / categorical / add-on / drop columns.
    numeric: tuple[str, ...] = ("tenure", "MonthlyCharges", "TotalCharges")
    categorical: tuple[str, ...] = (
        "gender", "SeniorCitizen", "Partner", "Dependents", "PhoneService", "MultipleLines",
        "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
        "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod")
    addons: tuple[str, ...] = ("OnlineSecurity", "OnlineBackup", "DeviceProtection",
                               "TechSupport", "StreamingTV", "StreamingMovies")
    engineered_numeric: tuple[str, ...] = (
        "LoyaltyIndex", "TotalAddOnServices", "UnitCost", "AvgPaidPerMonth", "ChargeGap",
        "RiskScope_Fiber_NoSupport_NoSec", "IsMonthToMonth", "IsPaperless", "IsElectronicCheck")
    engineered_categorical: tuple[str, ...] = ("TenureBucket",)
    drop: tuple[str, ...] = ("customerID",)
    target: str = "Churn"
    id_col: str = "customerID"


@dataclass(frozen=True)
class DriftConfig:
    # Fixed values of the monitoring config.
    enabled: bool = True
    min_samples: int = 50
    ks_pvalue: float = 0.05
    psi_threshold: float = 0.2
    drift_ratio: float = 0.3
    numeric_features: tuple[str, ...] = ("tenure", "MonthlyCharges", "TotalCharges")
    categorical_features: tuple[str, ...] = ("Contract", "InternetService", "PaymentMethod")
    psi_bins: int = 10


@dataclass(frozen=True)
class MonitorConfig:
    # Allowed relative drops per metric, cooldown hours, retention days.
    thresholds: tuple[tuple[str, float], ...] = (
        ("f1", 0.10), ("recall", 0.15), ("precision", 0.10), ("roc_auc", 0.05))
    cooldown_hours: float = 24.0
    retention_days: int = 90
    auto_retrain: bool = True
    retrain_enabled: bool = True


@dataclass(frozen=True)
class SplitConfig:
    test_size: float = 0.2
    seed: int = 42
    stratify: bool = True
    folds: int = 5


@dataclass(frozen=True)
class TrainConfig:
    min_f1: float = 0.5
    split: SplitConfig = field(default_factory=SplitConfig)
    parallelism: int = 4
