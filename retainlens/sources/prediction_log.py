"""Prediction log (S5–S7, P3, P4): JSON Lines partitioned by day, in committed epochs.

Layout of a log folder:

* ``epochs/epoch=<id>/log_date=<day>/…json``: the records of one append. A writer that dies leaves a
  folder that no reader looks at; the same epoch written again replaces it.
* ``commits/<id>/…json``: one manifest per epoch, written after its records. The manifest is the commit
  point. It may name epochs that it ``replaces`` (compaction).

Readers list the manifests, drop replaced epochs and open only the day folders of the window. A folder
without manifests is read as plain JSON Lines partitioned by ``log_date`` (a log from elsewhere).
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DateType, DoubleType, IntegerType, MapType, StringType, StructField,
                               StructType, TimestampType)

from ..functions.expressions import risk_band

LOG_SCHEMA = StructType([
    StructField("timestamp", TimestampType()),
    StructField("customer_id", StringType()),
    StructField("prediction", IntegerType()),
    StructField("churn_probability", DoubleType()),
    StructField("risk_level", StringType()),
    StructField("model_version", StringType()),
    StructField("input_features", StringType()),
    StructField("extra", MapType(StringType(), StringType())),
    StructField("log_date", DateType()),
])
_MANIFEST = "epoch string, replaces array<string>"


def to_log_records(scored: DataFrame, feature_cols: Sequence[str], ts_col: str | None = None,
                   id_col: str = "customerID", model_version: str = "v1", extra: dict | None = None) -> DataFrame:
    """Scored rows + their inputs → log records (prob rounded to 4, id default 'unknown'). ``extra`` gives further
    entries of a record: texts, or names of columns as ``F.col``."""
    ts = F.col(ts_col).cast("timestamp") if ts_col else F.current_timestamp()
    entries = [x for k, v in (extra or {}).items() for x in (F.lit(k), F.lit(v).cast("string"))]
    return scored.select(
        ts.alias("timestamp"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("unknown")).alias("customer_id")
        if id_col in scored.columns else F.lit("unknown").alias("customer_id"),
        F.col("prediction").cast("int").alias("prediction"),
        F.round(F.col("churn_probability"), 4).alias("churn_probability"),
        F.coalesce(F.col("risk_level"), risk_band(F.col("churn_probability"))).alias("risk_level")
        if "risk_level" in scored.columns else risk_band(F.col("churn_probability")).alias("risk_level"),
        F.lit(model_version).alias("model_version"),
        F.to_json(F.struct(*[F.col(c) for c in feature_cols])).alias("input_features"),
        (F.create_map(*entries) if entries else F.lit(None)).cast(MapType(StringType(), StringType())).alias("extra"),
        F.to_date(ts).alias("log_date"),
    )


# --- epochs -----------------------------------------------------------------------------------------

def stage_epoch(records: DataFrame, path: str, epoch: str) -> None:
    """Write an epoch's records where readers don't look yet; replaces what an earlier attempt left."""
    records.write.mode("overwrite").partitionBy("log_date").json(f"{path}/epochs/epoch={epoch}")


def commit_epoch(spark: SparkSession, path: str, epoch: str, replaces: Sequence[str] = ()) -> None:
    """Make a staged epoch visible, and those that it replaces invisible, by one small file."""
    spark.createDataFrame([(epoch, list(replaces))], _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/commits/{epoch}")


def _manifests(spark: SparkSession, path: str) -> list | None:
    """The committed manifests (one row an epoch), None where the folder has none."""
    try:
        return spark.read.schema(_MANIFEST).option("mode", "DROPMALFORMED").json(f"{path}/commits/*").filter("epoch IS NOT NULL").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def committed_epochs(spark: SparkSession, path: str) -> list[str]:
    """The ids of the epochs that readers see."""
    found = _manifests(spark, path) or []
    gone = {x for m in found for x in m.replaces or []}
    return sorted({m.epoch for m in found} - gone)


def append_log(records: DataFrame, path: str, enabled: bool = True, epoch: str | None = None) -> bool:
    """Append one epoch; no-op when disabled. An epoch of a name that is committed already (a replay), or has been
    compacted away, is skipped. Whether something was written."""
    if not enabled:
        return False
    spark, name = records.sparkSession, epoch or uuid.uuid4().hex
    if epoch and any(name == m.epoch or name in (m.replaces or []) for m in _manifests(spark, path) or []):
        return False
    stage_epoch(records, path, name)
    commit_epoch(spark, path, name)
    return True


def _read_json(spark: SparkSession, base: str, paths: list[str]) -> DataFrame:
    schema = StructType([*LOG_SCHEMA.fields, StructField("epoch", StringType())])
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("basePath", base).json(paths).drop("epoch")


def read_log(spark: SparkSession, path: str, as_of: str | None = None, days: int | None = None
             ) -> DataFrame:
    """Read the committed log; with ``days`` keep the last ``days`` calendar days up to ``as_of``
    (inclusive). Malformed lines are dropped, blank lines never produce rows."""
    if _manifests(spark, path) is None:
        df = spark.read.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    else:
        # An epoch whose days have all been purged has an empty folder, or none.
        names = [e for e in committed_epochs(spark, path) if _exists(spark, f"{path}/epochs/epoch={e}")]
        df = _read_json(spark, f"{path}/epochs", [f"{path}/epochs/epoch={e}" for e in names]) if names else spark.createDataFrame([], LOG_SCHEMA)
    if days is not None:
        end = F.to_date(F.lit(as_of)) if as_of else F.current_date()
        df = df.filter((F.col("log_date") > F.date_sub(end, days)) & (F.col("log_date") <= end))
    return df


def compact_log(spark: SparkSession, path: str) -> str | None:
    """Many small epochs become one, with the records of a day in one folder; the new epoch's manifest replaces them
    all at once, so a reader sees the old ones or the new one. Its name, None if there are fewer than two epochs."""
    old = committed_epochs(spark, path)
    if len(old) < 2:
        return None
    name = f"compact-{uuid.uuid4().hex}"
    stage_epoch(read_log(spark, path).repartition("log_date"), path, name)
    # Names that were replaced before stay known, so that their replays are still skipped.
    before = {x for m in _manifests(spark, path) or [] for x in m.replaces or []}
    commit_epoch(spark, path, name, sorted({*old, *before}))
    return name


def vacuum_log(spark: SparkSession, path: str) -> int:
    """Delete the folders of epochs that no manifest shows (replaced ones, and what dead writers left); not while a
    writer or an old reader is at work. The number of folders deleted."""
    live, gone = {f"epoch={e}" for e in committed_epochs(spark, path)}, 0
    fs, list_dirs = _fs(spark, path)
    for st in list_dirs(f"{path}/epochs"):
        if st.getPath().getName() not in live:
            fs.delete(st.getPath(), True)
            gone += 1
    return gone


# --- windows and retention --------------------------------------------------------------------------

def day_window(df: DataFrame, as_of: str, days: int, date_col: str = "log_date") -> DataFrame:
    """Rows of the last ``days`` calendar days ending at ``as_of`` (inclusive)."""
    end = F.to_date(F.lit(as_of))
    return df.filter((F.col(date_col) > F.date_sub(end, days)) & (F.col(date_col) <= end))


def retention_split(df: DataFrame, as_of: str, max_days: int = 90, date_col: str = "log_date"
                    ) -> DataFrame:
    """Tag rows ``expired`` when their day is strictly older than as_of − max_days."""
    cutoff = F.date_sub(F.to_date(F.lit(as_of)), max_days)
    return df.withColumn("retention", F.when(F.col(date_col) < cutoff, F.lit("expired"))
                         .otherwise(F.lit("live")))


def _fs(spark: SparkSession, path: str):
    """The path's file system, and a function that lists the folders below a folder (none where it is missing)."""
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, lambda p: [s for s in fs.listStatus(at(p)) if s.isDirectory()] if fs.exists(at(p)) else []


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    return _fs(spark, path)[0].exists(jvm.org.apache.hadoop.fs.Path(path))


def purge_expired(spark: SparkSession, path: str, as_of: str, max_days: int = 90) -> int:
    """Drop whole expired days, in every epoch; returns the number of days removed."""
    cutoff = dt.date.fromisoformat(as_of[:10]) - dt.timedelta(days=max_days)
    fs, list_dirs = _fs(spark, path)
    removed = set()
    for folder in [path, *(str(st.getPath()) for st in list_dirs(f"{path}/epochs"))]:
        for st in list_dirs(folder):
            name = st.getPath().getName()
            try:
                day = dt.date.fromisoformat(name.removeprefix("log_date="))
            except ValueError:
                continue
            if name.startswith("log_date=") and day < cutoff:
                fs.delete(st.getPath(), True)
                removed.add(day)
    return len(removed)


def log_features(df: DataFrame, schema: str) -> DataFrame:
    """Flatten the JSON ``input_features`` into columns (``schema`` is a DDL string)."""
    return df.select("*", F.from_json("input_features", schema).alias("_f")).select(
        *[c for c in df.columns if c != "input_features"], "_f.*")
