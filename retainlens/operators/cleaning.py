"""Cleaning, projection and row predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..config import ColumnRoles
from ..functions.expressions import lenient_target, safe_double, strict_target
from .prefix import exact_quantile_scalars, exact_quantiles


def _dtype(df: DataFrame, c: str):
    return df.schema[c].dataType


def target_strict(df: DataFrame, target: str = "Churn") -> DataFrame:
    """Yes → 1, No → 0, any other value fails the job."""
    return df.withColumn(target, strict_target(target, _dtype(df, target)))


def target_lenient(df: DataFrame, target: str = "Churn") -> DataFrame:
    """1 iff value ∈ {"Yes", 1, "1", True}, else 0."""
    return df.withColumn(target, lenient_target(target, _dtype(df, target)))


def coerce_numeric(df: DataFrame, cols: Sequence[str] = ("tenure", "MonthlyCharges", "TotalCharges")
                   ) -> DataFrame:
    """Safe numeric coercion of the given (present) columns, bad values → null."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: safe_double(c, _dtype(df, c)) for c in present})


def fit_total_charges_median(df: DataFrame) -> float | None:
    """Median of TotalCharges after rule 1 (new customers → 0.0) — the C5 fallback scalar."""
    if "TotalCharges" not in df.columns:
        return None
    tc = safe_double("TotalCharges", _dtype(df, "TotalCharges"))
    if "tenure" in df.columns and "MonthlyCharges" in df.columns:
        ten = safe_double("tenure", _dtype(df, "tenure"))
        tc = F.when(tc.isNull() & (F.coalesce(ten, F.lit(0.0)) == 0), F.lit(0.0)).otherwise(tc)
    return exact_quantile_scalars(df.select(tc.alias("_tc")), "_tc", [0.5])[0]


def fit_cleaning_medians(df: DataFrame) -> tuple[float | None, float | None]:
    """Both fitted fill values in one grouped quantile job: TotalCharges after rule 1 (C5) and
    MonthlyCharges (F3; cleaning does not change it)."""
    cols = {}
    if "TotalCharges" in df.columns:
        tc = safe_double("TotalCharges", _dtype(df, "TotalCharges"))
        if "tenure" in df.columns and "MonthlyCharges" in df.columns:
            ten = safe_double("tenure", _dtype(df, "tenure"))
            tc = F.when(tc.isNull() & (F.coalesce(ten, F.lit(0.0)) == 0), F.lit(0.0)).otherwise(tc)
        cols["TotalCharges"] = tc
    if "MonthlyCharges" in df.columns:
        cols["MonthlyCharges"] = safe_double("MonthlyCharges", _dtype(df, "MonthlyCharges"))
    if not cols:
        return None, None
    cells = [F.struct(F.lit(k).alias("column"), v.alias("v")) for k, v in cols.items()]
    long = df.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
    got = {r["column"]: r["median"] for r in
           exact_quantiles(long, "v", [0.5], by=["column"], names=["median"]).collect()}
    return got.get("TotalCharges"), got.get("MonthlyCharges")


def clean_total_charges(df: DataFrame, median: float | None = None, fit: bool = True) -> DataFrame:
    """Business imputation of TotalCharges.

    (1) null ∧ coalesce(tenure, 0) = 0 → 0.0; (2) other nulls → MonthlyCharges × tenure;
    (3) still null → ``median`` (fitted after rule 1). Without tenure / MonthlyCharges the
    column gets the plain median; without TotalCharges the frame is unchanged.
    """
    if "TotalCharges" not in df.columns:
        return df
    if median is None and fit:
        median = fit_total_charges_median(df)
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumn("TotalCharges", total_charges_expr(dtypes, median))


def total_charges_expr(dtypes: dict, median: float | None):
    """The C5 expression over the raw columns (reusable across frames of the same schema)."""
    med = F.lit(median).cast("double")
    tc = safe_double("TotalCharges", dtypes["TotalCharges"])
    if "tenure" not in dtypes or "MonthlyCharges" not in dtypes:
        return F.coalesce(tc, med)
    ten = safe_double("tenure", dtypes["tenure"])
    mon = safe_double("MonthlyCharges", dtypes["MonthlyCharges"])
    rule1 = F.when(tc.isNull() & (F.coalesce(ten, F.lit(0.0)) == 0), F.lit(0.0)).otherwise(tc)
    return F.coalesce(rule1, mon * ten, med)


def infer_roles(df: DataFrame, target: str | None = None, id_col: str | None = None
                ) -> tuple[list[str], list[str]]:
    """Numeric dtype vs the rest (target and id excluded)."""
    skip = {target, id_col}
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in skip]
    cat = [f.name for f in df.schema.fields if f.name not in skip and f.name not in num]
    return num, cat


def resolve_roles(df: DataFrame, roles: ColumnRoles = ColumnRoles()) -> tuple[list[str], list[str]]:
    """(config ∪ engineered) ∩ available − {drop, target, id}."""
    excluded = set(roles.drop) | {roles.target, roles.id_col}
    avail = set(df.columns)

    def pick(cols):
        out = []
        for c in cols:
            if c in avail and c not in excluded and c not in out:
                out.append(c)
        return out

    return (pick(list(roles.numeric) + list(roles.engineered_numeric)),
            pick(list(roles.categorical) + list(roles.engineered_categorical)))


# Fields and defaults of the scoring record, in record order.
RECORD_DEFAULTS: dict[str, object] = {
    "tenure": 0, "MonthlyCharges": 0.0, "TotalCharges": 0.0,
    "gender": "Male", "SeniorCitizen": 0, "Partner": "No", "Dependents": "No",
    "PhoneService": "Yes", "MultipleLines": "No", "InternetService": "Fiber optic",
    "OnlineSecurity": "No", "OnlineBackup": "No", "DeviceProtection": "No", "TechSupport": "No",
    "StreamingTV": "No", "StreamingMovies": "No", "Contract": "Month-to-month",
    "PaperlessBilling": "Yes", "PaymentMethod": "Electronic check",
    "customerID": "PREDICT_USER",
}


def project_defaults(df: DataFrame, defaults: Mapping[str, object] = RECORD_DEFAULTS,
                     keep: Sequence[str] = (), fill_nulls: bool = False) -> DataFrame:
    """Project to the known fields; absent fields get their default, unknown fields drop.

    The reference keeps an explicit null and only fills *missing* fields; ``fill_nulls=True``
    also replaces nulls.
    """
    cols = [F.col(k) for k in keep if k in df.columns]
    for name, default in defaults.items():
        if name in df.columns:
            c = F.col(name)
            if fill_nulls:
                c = F.coalesce(c, F.lit(default))
            cols.append(c.alias(name))
        else:
            cols.append(F.lit(default).alias(name))
    return df.select(*cols)


def _as_number(c: str):
    """String form → double; blank / malformed → null."""
    return F.col(c).cast("string").try_cast("double")


def _malformed(c: str):
    raw = F.trim(F.col(c).cast("string"))
    return F.col(c).isNotNull() & (raw != "") & _as_number(c).isNull()


def violations(df: DataFrame):
    """Array of rule names the row violates (empty array = valid).

    tenure: integer in [0, 72]; MonthlyCharges, TotalCharges: ≥ 0; SeniorCitizen ∈ {0, 1};
    a value that is not a number is a type violation (blank = missing, not a violation).
    """
    checks = []
    if "tenure" in df.columns:
        t = _as_number("tenure")
        checks += [F.when(_malformed("tenure"), F.lit("tenure_type")),
                   F.when(t != F.floor(t), F.lit("tenure_integer")),
                   F.when((t < 0) | (t > 72), F.lit("tenure_range"))]
    for c in ("MonthlyCharges", "TotalCharges"):
        if c in df.columns:
            checks += [F.when(_malformed(c), F.lit(f"{c}_type")),
                       F.when(_as_number(c) < 0, F.lit(f"{c}_negative"))]
    if "SeniorCitizen" in df.columns:
        s = _as_number("SeniorCitizen")
        checks += [F.when(_malformed("SeniorCitizen") | ~s.isin(0.0, 1.0), F.lit("SeniorCitizen_domain"))]
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def validate_rows(df: DataFrame) -> DataFrame:
    """C9 (re-aimed to tables): adds ``violations`` and ``is_valid``."""
    v = violations(df)
    return df.withColumn("violations", v).withColumn("is_valid", F.size("violations") == 0)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quarantine split: (valid rows, rejected rows with their violations)."""
    checked = validate_rows(df)
    return (checked.filter("is_valid").drop("violations", "is_valid"),
            checked.filter("NOT is_valid").drop("is_valid"))


def drop_target_id(df: DataFrame, target: str = "Churn", id_col: str = "customerID") -> DataFrame:
    """C10."""
    return df.drop(target, id_col)


def split_xy(df: DataFrame, features: Sequence[str], target: str = "Churn"
             ) -> tuple[DataFrame, DataFrame]:
    """C11: X = feature columns, y = target (keep an id column to re-pair rows)."""
    return df.select(*features), df.select(target)


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One-pass exact distinct counts per column (long form: column, n_unique)."""
    agg = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in cols])
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("n_unique")) for c in cols
    ])).alias("s")).select("s.*")


def low_cardinality_columns(df: DataFrame, cols: Sequence[str], max_unique: int = 200) -> list[str]:
    """Keep columns with at most ``max_unique`` distinct values (one aggregate job)."""
    if not cols:
        return []
    counts = {r["column"]: r["n_unique"] for r in distinct_counts(df, cols).collect()}
    return [c for c in cols if counts[c] <= max_unique]


def has_min_samples(df: DataFrame, n: int) -> bool:
    """At least ``n`` rows (stops counting after n)."""
    return len(df.limit(n).collect()) >= n if n > 0 else True
