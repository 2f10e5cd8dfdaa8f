"""Files in and out (S1–S4, S8–S12): CSV / Parquet readers, report tables, prepared matrices,
retrain history. All paths go through Spark / Hadoop FS, so they work on any cluster store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

# The raw customer schema (column order of the reference's fixture).
CUSTOMER_SCHEMA = StructType(
    [StructField("customerID", StringType()), StructField("gender", StringType()),
     StructField("SeniorCitizen", IntegerType()), StructField("Partner", StringType()),
     StructField("Dependents", StringType()), StructField("tenure", IntegerType())]
    + [StructField(c, StringType()) for c in (
        "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup",
        "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies", "Contract",
        "PaperlessBilling", "PaymentMethod")]
    + [StructField("MonthlyCharges", DoubleType()), StructField("TotalCharges", StringType()),
       StructField("Churn", StringType())])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_customers_csv(spark: SparkSession, path: str, schema: StructType = CUSTOMER_SCHEMA) -> DataFrame:
    """Raw customer CSV with an explicit schema; a missing file is a clear error."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"raw data not found: {path}")
    return spark.read.schema(schema).option("header", True).csv(path)


def read_by_suffix(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """``.csv`` / ``.parquet`` by suffix; anything else is rejected."""
    low = path.lower().rstrip("/")
    if low.endswith(".csv"):
        r = spark.read.option("header", True)
        return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file type: {path}")


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    """S3: prepared matrix (``features`` vector + ``label``); missing keys → KeyError."""
    df = spark.read.parquet(path)
    missing = {"features", "label"} - set(df.columns)
    if missing:
        raise KeyError(f"prepared dataset lacks {sorted(missing)}: {path}")
    return df


def load_training_source(spark: SparkSession, prepared_path: str, raw_path: str) -> tuple[DataFrame, str]:
    """The prepared matrix when present (mode 'npz'), else the raw CSV (mode 'csv')."""
    if _exists(spark, prepared_path):
        return read_prepared(spark, prepared_path), "npz"
    return read_customers_csv(spark, raw_path), "csv"


def write_prepared(features: DataFrame, path: str, metadata: dict | None = None) -> None:
    """Prepared dataset (vector columns) as Parquet + a one-row metadata JSON."""
    features.write.mode("overwrite").parquet(f"{path}/data")
    if metadata:
        spark = features.sparkSession
        spark.createDataFrame([tuple(metadata.values())], list(metadata.keys()))\
            .coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Small long-format report tables (JSON or Parquet), overwritten per run."""
    w = df.coalesce(1).write.mode("overwrite")
    (w.parquet if fmt == "parquet" else w.json)(path)


def read_report(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    if not _exists(spark, path):
        raise FileNotFoundError(f"report not found: {path}")
    return spark.read.parquet(path) if fmt == "parquet" else spark.read.json(path)


HISTORY_SCHEMA = "ts timestamp, reason string, model string"


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Retrain history; missing → empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], HISTORY_SCHEMA)
    return spark.read.schema(HISTORY_SCHEMA).json(path)


def append_history(spark: SparkSession, path: str, ts: str, reason: str, model: str) -> None:
    """Append one retrain event."""
    spark.createDataFrame([(ts, reason, model)], "ts string, reason string, model string")\
        .select(F.col("ts").cast("timestamp").alias("ts"), "reason", "model")\
        .write.mode("append").json(path)
