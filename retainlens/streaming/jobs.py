"""Structured Streaming jobs.

The reference's online path (score a request, append a JSON line, poll "the last N days") becomes
streams: file sources, event-time watermarks, tumbling / sliding windows, de-duplication within
the watermark and ``foreachBatch`` for the drift check. Checkpoints and outputs live under the
session's ``spark.checkpoint.dir`` (a shared folder on a cluster), in one fresh folder per run
unless the caller names a stable one to resume from. Every epoch has a place of its own in the
output, so an epoch that runs again replaces what it wrote.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import risk_band
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources.prediction_log import append_log, to_log_records


def stream_dir(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/retainlens-streams/{name}-{uuid.uuid4().hex[:10]}"


def file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Parquet file stream; the schema is taken from the existing files (a single file needs a glob)."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    src = path if any(ch in path for ch in "*?[") else (path + "*" if path.endswith(".parquet") else path)
    return r.parquet(src)


def run_available_now(stream: DataFrame, name: str, output_mode: str = "append",
                      keys: list[str] | None = None,
                      on_batch: Callable[[DataFrame, int], None] | None = None,
                      folder: str | None = None) -> DataFrame:
    """Drain the source (``trigger(availableNow=True)``) into a Parquet table and return it.

    append: rows are appended. update: each batch appends its changed rows tagged with the epoch
    and the reader keeps the latest version per ``keys`` (an upsert without a table format); the
    watermark lets Spark evict state of closed windows, so state stays bounded on an endless
    stream. complete: the whole (small) result is rewritten per batch — tests only."""
    spark = stream.sparkSession
    d = folder or stream_dir(spark, name)
    out = f"{d}/out"

    def sink(batch: DataFrame, epoch: int) -> None:
        if on_batch is not None:
            on_batch(batch, epoch)
        at = 0 if output_mode == "complete" else epoch
        batch.write.mode("overwrite").parquet(f"{out}/_epoch_no={at}")

    q = (stream.writeStream.outputMode(output_mode).foreachBatch(sink)
         .option("checkpointLocation", f"{d}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    # A source without any data has no epoch: an empty part keeps the output readable.
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/_epoch_no=-1")
    got = spark.read.option("basePath", out).parquet(f"{out}/*").withColumnRenamed("_epoch_no", "_epoch")
    if output_mode == "update" and keys:
        # Latest version per key: a key has at most one row per epoch, so each group is small.
        latest = got.groupBy(*keys).agg(F.max("_epoch").alias("_last"))
        got = got.join(latest, keys).filter(F.col("_epoch") == F.col("_last")).drop("_last")
    return got.drop("_epoch") if "_epoch" in got.columns else got


def event_time(df: DataFrame, c: str = "ts"):
    """Event-time column for watermarks. A wall-clock ``timestamp_ntz`` is read as UTC whatever
    the session time zone, so windows align to UTC days everywhere."""
    if df.schema[c].dataType.typeName() == "timestamp_ntz":
        return F.from_utc_timestamp(F.col(c).cast("timestamp"), F.current_timezone())
    return F.col(c)


def utc_day(c) -> F.Column:
    """'YYYY-MM-DD' of an instant's UTC day (independent of the session time zone)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.date_from_unix_date(F.floor(F.unix_seconds(col) / 86400).cast("int")).cast("string")


def prediction_events(events: DataFrame) -> DataFrame:
    """Events → prediction-log rows with an event-time ``ts`` (UTC instant)."""
    prob = F.floor(F.least(F.col("value") / 200, F.lit(1.0)) * 10000) / 10000
    return events.select(
        "event_id", event_time(events, "ts").alias("ts"),
        F.when(F.col("value") >= 60, F.lit(1)).otherwise(F.lit(0)).alias("prediction"),
        prob.alias("churn_probability"), risk_band(prob).alias("risk_level"),
        F.col("props").alias("input_features"))


def _window_stats(df: DataFrame, win) -> DataFrame:
    total = F.count(F.lit(1))
    churn = F.count_if(F.col("prediction") == 1)
    return df.groupBy(win.alias("w")).agg(
        total.alias("total_predictions"), churn.alias("churn_count"),
        F.round(F.try_divide(churn * 100, total), 2).alias("churn_rate"),
        F.round(F.avg("churn_probability"), 4).alias("avg_churn_probability"),
        F.count_if(F.col("risk_level") == "High").alias("n_high")
    ).select(utc_day("w.start").alias("window_start"), utc_day("w.end").alias("window_end"),
             "total_predictions", "churn_count", "churn_rate", "avg_churn_probability", "n_high")


def daily_stats_stream(events_stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Tumbling daily prediction stats with an event-time watermark (A15 per day)."""
    ev = prediction_events(events_stream).withWatermark("ts", watermark)
    return _window_stats(ev, F.window("ts", "1 day"))


def sliding_stats_stream(events_stream: DataFrame, length: str = "7 days", slide: str = "1 day",
                         watermark: str = "1 day") -> DataFrame:
    """Z3: rolling 7-day stats, one window per day."""
    ev = prediction_events(events_stream).withWatermark("ts", watermark)
    return _window_stats(ev, F.window("ts", length, slide))


def dedup_stream(events_stream: DataFrame, key: str = "event_id", watermark: str = "1 day") -> DataFrame:
    """Late / duplicate log rows — keep the first row per key within the watermark."""
    ev = prediction_events(events_stream).withWatermark("ts", watermark)
    return ev.dropDuplicatesWithinWatermark([key])


def scoring_stream(customer_stream: DataFrame, static_orders_agg: DataFrame, model, build_rows,
                   log_path: str, name: str = "scoring", checkpoint: str | None = None,
                   model_version: str = "v1") -> str:
    """Customers stream ⋈ static per-customer aggregate → features → model → records of the
    day-partitioned prediction log (as batch scoring writes them). Returns the log path.

    With a stable ``checkpoint`` a later run scores only customers that arrived since. Each micro-batch is an
    epoch of the log, named after the checkpoint and the batch (also in ``extra``): an attempt that died half
    way is invisible and replaced, a committed one is skipped, so a batch is in the log once.
    """
    from ..operators.score import score
    spark = customer_stream.sparkSession
    d = checkpoint or f"{stream_dir(spark, name)}/checkpoint"
    run = hashlib.sha256(f"{name}:{d}".encode()).hexdigest()[:16]
    # The static side of a stream-static join is re-evaluated every micro-batch: materialize the
    # per-customer aggregate once (reliable checkpoint) instead of re-aggregating all orders.
    static = cut_lineage(static_orders_agg)

    def sink(batch: DataFrame, epoch: int) -> None:
        rows = build_rows(batch, static)
        inputs = [c for c in rows.columns if c not in ("customerID", "Churn")]
        records = to_log_records(score(model, rows, keep=inputs), inputs, model_version=model_version, extra={"batch": f"{name}:{epoch}"})
        append_log(records, log_path, epoch=f"{run}-{epoch}")

    q = (customer_stream.writeStream.foreachBatch(sink).option("checkpointLocation", d)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return log_path


@dataclass
class WindowDrift:
    """Drift of closed windows: feature rows, and one report a window."""
    features: DataFrame
    report: DataFrame


def drift_windows(features_stream: DataFrame, reference, cfg, ts: str = "ts", length: str = "7 days", start: str = "4 days",
                  watermark: str = "1 day", name: str = "drift", folder: str | None = None) -> WindowDrift:
    """Drift (H9) of each event-time window against a stored reference (a drift ``Profile``).

    The stream's state is the counts of values per open window. Rows up to ``watermark`` late still count; a window
    that the watermark has passed is closed: its counts are written once and leave the state. Every closed window
    gets a report, whatever micro-batches its rows came in. ``start`` shifts the windows from multiples of ``length``
    since 1970 (4 days: weeks from Monday). With a stable ``folder`` a later run goes on where the last one ended.
    """
    from ..functions.expressions import safe_double
    from ..operators import drift as D
    schema = features_stream.schema
    none = F.lit(None)
    cells = [F.struct(F.lit("").alias("feature"), none.cast("double").alias("value"), none.cast("string").alias("category"))]  # one a row
    for c in cfg.numeric_features:
        if c in schema.fieldNames():
            cells.append(F.struct(F.lit(c).alias("feature"), safe_double(c, schema[c].dataType).alias("value"), none.cast("string").alias("category")))
    for c in cfg.categorical_features:
        if c in schema.fieldNames():
            cells.append(F.struct(F.lit(c).alias("feature"), none.cast("double").alias("value"), F.col(c).cast("string").alias("category")))
    long = features_stream.withWatermark(ts, watermark).select(ts, F.explode(F.array(*cells)).alias("_c")).select(ts, "_c.*").filter(
        "feature = '' OR value IS NOT NULL OR category IS NOT NULL")
    counts = long.groupBy(F.window(ts, length, length, start).alias("w"), "feature", "value", "category").agg(F.count(F.lit(1)).alias("n"))
    closed = run_available_now(counts.select(utc_day("w.start").alias("window_start"), "feature", "value", "category", "n"), name, "append", folder=folder)
    by = ["window_start"]
    cur = D.Profile(closed.filter("feature <> '' AND value IS NOT NULL").select(*by, "feature", "value", "n"),
                    closed.filter("feature <> '' AND category IS NOT NULL").select(*by, "feature", "category", "n"))
    sizes = closed.filter("feature = ''").select(*by, F.col("n").alias("sample_size"))
    ref = D.for_groups(reference, cur, by)
    return WindowDrift(D.features_from_profiles(ref, cur, cfg, by), D.report_from_profiles(ref, cur, sizes, cfg, by))
