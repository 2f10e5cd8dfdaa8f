"""Column-expression builders (JVM-side, whole-stage-codegen friendly).

Each builder returns a ``pyspark.sql.Column``; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType, StringType

# Tenure bins are right-closed (-1,6] (6,12] (12,24] (24,48] (48,72] (72,1e9].
TENURE_EDGES = (6, 12, 24, 48, 72, 1_000_000_000)
TENURE_LABELS = ("0-6", "7-12", "13-24", "25-48", "49-72", "72+")
# Risk bands p < 0.3 Low, p < 0.6 Medium, otherwise High.
RISK_THRESHOLDS = (0.3, 0.6)
RISK_LABELS = ("Low", "Medium", "High")


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """pandas treats NaN as missing; Spark does not — normalise NaN → null."""
    c = col_(c)
    return F.when(~F.isnan(c), c)


def safe_double(c, dtype: DataType | None = None) -> Column:
    """Numeric coercion, bad → null (``try_cast``; ' ' and 'abc' become null, NaN → null)."""
    c = col_(c)
    if dtype is not None and isinstance(dtype, NumericType):
        return nan_to_null(c.cast("double"))
    return nan_to_null(c.try_cast("double"))


def yes_no_flag(c, dtype: DataType | None = None) -> Column:
    """string → 1 iff lower(trim(x)) = 'yes' (null → 0); numeric → coalesce(x, 0) truncated."""
    c = col_(c)
    if dtype is not None and not isinstance(dtype, StringType):
        if isinstance(dtype, BooleanType):
            return F.coalesce(c.cast("int"), F.lit(0))
        return F.coalesce(nan_to_null(c.cast("double")), F.lit(0.0)).cast("int")
    return F.when(F.lower(F.trim(c)) == "yes", F.lit(1)).otherwise(F.lit(0))


def strict_target(c, dtype: DataType | None = None) -> Column:
    """Yes → 1, No → 0, anything else fails the query; numeric targets pass through."""
    c = col_(c)
    if dtype is not None and isinstance(dtype, NumericType):
        return c.cast("int")
    return (F.when(c == "Yes", F.lit(1)).when(c == "No", F.lit(0))
            .otherwise(F.raise_error(F.concat(F.lit("invalid target value: "),
                                              F.coalesce(c.cast("string"), F.lit("NULL"))))
                       .cast("int")))


def lenient_target(c, dtype: DataType | None = None) -> Column:
    """1 iff value ∈ {"Yes", 1, "1", True}, else 0."""
    c = col_(c)
    if dtype is not None and isinstance(dtype, BooleanType):
        return F.coalesce(c.cast("int"), F.lit(0))
    if dtype is not None and isinstance(dtype, NumericType):
        return F.when(c == 1, F.lit(1)).otherwise(F.lit(0))
    return F.when(c.isin("Yes", "1"), F.lit(1)).otherwise(F.lit(0))


def tenure_bucket(c) -> Column:
    """right-closed bins with labels; null → bucket of 0; outside all bins → 'nan'."""
    t = F.coalesce(col_(c).cast("double"), F.lit(0.0))
    expr = F.when(t <= -1, F.lit("nan"))
    for edge, label in zip(TENURE_EDGES, TENURE_LABELS):
        expr = expr.when(t <= edge, F.lit(label))
    return expr.otherwise(F.lit("nan"))


def risk_band(p, thresholds=RISK_THRESHOLDS, labels=RISK_LABELS) -> Column:
    """p < t0 → labels[0]; p < t1 → labels[1]; else labels[2]."""
    p = col_(p)
    return (F.when(p < F.lit(float(thresholds[0])), F.lit(labels[0]))
            .when(p < F.lit(float(thresholds[1])), F.lit(labels[1]))
            .otherwise(F.lit(labels[2])))


def contains_ci(c, needle: str) -> Column:
    """Case-insensitive substring test, null → False."""
    return F.coalesce(F.lower(col_(c).cast("string")).contains(needle.lower()), F.lit(False))


def safe_div(num, den) -> Column:
    """num / den with 0 when den = 0 (metric convention)."""
    num, den = col_(num), col_(den)
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def round_to(c, digits: int) -> Column:
    return F.round(col_(c), digits)
