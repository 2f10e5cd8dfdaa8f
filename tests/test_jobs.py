"""End-to-end jobs: monitoring report (O6), retrain run (O5), streaming scoring (Z1), profiles."""

import pytest
from pyspark.sql import functions as F

from retainlens.sources.prediction_log import append_log, purge_expired, read_log
from retainlens.config import DriftConfig, TrainConfig
from retainlens.operators import drift as D
from retainlens.operators import monitor as O
from retainlens.plans import jobs as J
from retainlens.plans import views as V
from retainlens.sources import artifacts as ART
from retainlens.sources import prediction_log as LG
from retainlens.sources.tables import table
from retainlens.streaming import jobs as Z


def test_monitoring_report(spark, sf):
    log = V.prediction_log(spark, sf)
    ref = LG.log_features(log.filter(F.col("log_date") < F.lit("2024-01-08").cast("date")), "k INT")
    base = spark.createDataFrame([("f1", .62), ("recall", .55), ("precision", .71), ("roc_auc", .85)], "metric string, value double")
    cur = spark.createDataFrame([("f1", .30), ("recall", .54), ("precision", .70), ("roc_auc", .84)], "metric string, value double")
    rep = J.monitoring_report(log, ref, base, cur, "2024-01-30", 7,
                              DriftConfig(numeric_features=("k",), categorical_features=("risk_level",)),
                              feature_schema="k INT")
    assert rep["stats"].first()["total_predictions"] == LG.day_window(log, "2024-01-30", 7).count()
    assert rep["performance"].first()["status"] == "degraded"
    assert rep["drift"].first()["total_features_checked"] == 2


def test_reference_profile_roundtrip(spark, sf, tmp_path):
    num, cat = D.reference_profile(V.subscribers(spark, sf))
    D.save_reference_profile(num, cat, str(tmp_path / "p"))
    n2, c2 = D.load_reference_profile(spark, str(tmp_path / "p"))
    assert n2.count() == 3 and c2.count() == cat.count()
    with pytest.raises(FileNotFoundError):
        D.load_reference_profile(spark, str(tmp_path / "missing"))


def test_retrain_run_gate_and_train(spark, sf, tmp_path):
    raw = V.subscribers(spark, sf)
    hist = str(tmp_path / "history")
    sig = spark.createDataFrame([(True,)], "retrain_recommended boolean")
    ART.append_history(spark, hist, "2024-01-30 00:00:00", "drift", "x")
    blocked = J.retrain_run(spark, raw, sig, hist, "2024-01-30 06:00:00", str(tmp_path / "out"))
    assert blocked == {"retrained": False, "reason": "cooldown active"}
    done = J.retrain_run(spark, raw, sig, hist, "2024-01-30 06:00:00", str(tmp_path / "out"), force=True,
                         cfg=TrainConfig(min_f1=0.0), families=("LogisticRegression",))
    assert done["retrained"] and done["model"] == "LogisticRegression"
    assert ART.read_history(spark, hist).count() == 2
    num, _ = D.load_reference_profile(spark, str(tmp_path / "out" / "reference_profile"))
    assert num.count() == 3


def test_streaming_scoring_to_log(spark, sf, tmp_path):
    raw = V.subscribers(spark, sf)
    res = J.train_pipeline(raw, TrainConfig(min_f1=0.0), families=("LogisticRegression",))
    customers = Z.file_stream(spark, f"{sf}/customer.parquet")
    per_cust = V.order_aggregate(table(spark, sf, "orders"))
    path = str(tmp_path / "log")
    Z.scoring_stream(customers, per_cust, res.model, V.subscriber_rows, path)
    log = read_log(spark, path)
    assert log.count() == raw.count()
    assert log.filter("customer_id is null or input_features is null or model_version is null").count() == 0
    # A second run over the same checkpoint scores new customers only; batch appends and purges keep the log readable.
    src, ck = str(tmp_path / "src"), str(tmp_path / "ck")
    people = table(spark, sf, "customer")
    ids = [r[0] for r in people.select("c_custkey").orderBy("c_custkey").collect()]
    log2 = str(tmp_path / "log2")
    for part in (F.col("c_custkey") <= ids[40], F.col("c_custkey") > ids[40]):
        people.filter(part).write.mode("append").parquet(src)
        for _ in range(2):
            Z.scoring_stream(Z.file_stream(spark, src), per_cust, res.model, V.subscriber_rows, log2, checkpoint=ck)
            got = read_log(spark, log2)
            assert got.count() == spark.read.parquet(src).count() == got.select("customer_id").distinct().count()
    append_log(got.limit(5).withColumn("log_date", F.lit("2001-01-01").cast("date")), log2)
    assert read_log(spark, log2).count() == people.count() + 5
    assert purge_expired(spark, log2, as_of="2030-01-01", max_days=5000) == 1 and read_log(spark, log2).count() == people.count()
    assert set(r["risk_level"] for r in log.select("risk_level").distinct().collect()) <= {"Low", "Medium", "High"}
