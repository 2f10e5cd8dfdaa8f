"""O* decision tables, prediction-log append / read / retention, A15 stats."""

import pytest
from pyspark.sql import functions as F

from retainlens.operators import monitor as O
from retainlens.sources import artifacts as ART
from retainlens.sources import prediction_log as LG

BASE = {"accuracy": .80, "f1": .62, "recall": .55, "precision": .71, "roc_auc": .85}


def _long(spark, d):
    return spark.createDataFrame(list(d.items()), "metric string, value double")


@pytest.mark.parametrize("cur,status,n", [
    ({"f1": .61, "recall": .54, "precision": .70, "roc_auc": .84}, "healthy", 0),
    ({"f1": .30, "recall": .25, "precision": .35, "roc_auc": .60}, "critical", 4),
    ({"f1": .30, "recall": .54, "precision": .70, "roc_auc": .84}, "degraded", 1),
])
def test_degradation(spark, cur, status, n):
    deg = O.degradation(_long(spark, BASE), _long(spark, cur))
    st = O.performance_status(deg).first()
    assert st["status"] == status and st["n_degraded"] == n and st["performance_ok"] == (n == 0)


def test_degradation_skips_missing(spark):
    deg = O.degradation(_long(spark, BASE), _long(spark, {"f1": .62}))
    assert [r["metric"] for r in deg.collect()] == ["f1"]


@pytest.mark.parametrize("drift,ok,decision,retrain", [
    (False, True, "stable", False), (True, False, "retrain_needed", True),
    (True, True, "drift_warning", False), (False, False, "degraded", True)])
def test_full_check(spark, drift, ok, decision, retrain):
    sig = spark.createDataFrame([(drift, ok)], "drift_detected boolean, performance_ok boolean")
    r = O.full_check(sig).first()
    assert r["decision"] == decision and r["retrain_recommended"] == retrain


def test_cooldown(spark):
    hist = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-02 00:00:00",)], "ts string")\
        .select(F.col("ts").cast("timestamp").alias("ts"))
    assert not O.cooldown(hist, "2024-01-02 12:00:00").first()["cooldown_ok"]
    assert O.cooldown(hist, "2024-01-03 00:00:00").first()["cooldown_ok"]
    empty = spark.createDataFrame([], "ts timestamp")
    assert O.cooldown(empty, "2024-01-03 00:00:00").first()["cooldown_ok"]


@pytest.mark.parametrize("kw,needed,cool,go,why", [
    ({"force": True, "enabled": False}, False, False, True, "forced"),
    ({"enabled": False}, True, True, False, "retraining disabled"),
    ({"auto": False, "reason": "drift"}, True, True, False, "auto retrain off"),
    ({"auto": False, "reason": "manual"}, True, True, True, "retrain approved"),
    ({}, False, True, False, "not needed"),
    ({}, True, False, False, "cooldown active"),
    ({}, True, True, True, "retrain approved")])
def test_retrain_gate_order(spark, kw, needed, cool, go, why):
    sig = spark.createDataFrame([(needed, cool)], "retrain_recommended boolean, cooldown_ok boolean")
    r = O.retrain_gate(sig, **kw).first()
    assert r["should_retrain"] == go and r["gate_reason"] == why


def test_log_roundtrip_window_and_retention(spark, tmp_path):
    scored = spark.createDataFrame(
        [("CUST-1", 1, 0.82345, 24, 79.85, "2024-01-30 10:00:00"), ("CUST-2", 0, 0.1, 3, 20.0, "2024-01-20 10:00:00"),
         (None, 1, 0.7, 5, 50.0, "2023-09-01 10:00:00")],
        "customerID string, prediction int, churn_probability double, tenure int, MonthlyCharges double, ts string")
    rec = LG.to_log_records(scored, ["tenure", "MonthlyCharges"], ts_col="ts")
    path = str(tmp_path / "log")
    LG.append_log(rec, path)
    LG.append_log(rec, path, enabled=False)
    epoch, = LG.committed_epochs(spark, path)
    with open(tmp_path / "log" / "epochs" / f"epoch={epoch}" / "log_date=2024-01-30" / "junk.json", "w") as f:
        f.write("\n{not json\n")
    allrows = LG.read_log(spark, path)
    assert allrows.count() == 3
    recent = LG.read_log(spark, path, as_of="2024-01-30", days=7).collect()
    assert [r["customer_id"] for r in recent] == ["CUST-1"]
    assert recent[0]["churn_probability"] == 0.8235 and recent[0]["risk_level"] == "High"
    feats = LG.log_features(allrows, "tenure INT, MonthlyCharges DOUBLE")
    assert {r["tenure"] for r in feats.collect()} == {24, 3, 5}
    assert {r["customer_id"] for r in allrows.collect()} == {"CUST-1", "CUST-2", "unknown"}
    assert LG.purge_expired(spark, path, "2024-01-30", 90) == 1
    assert LG.read_log(spark, path).count() == 2


def test_prediction_stats(spark):
    log = spark.createDataFrame([(1, .8, "High"), (1, .7, "High"), (1, .65, "High"), (0, .1, "Low"), (0, .4, "Medium")],
                                "prediction int, churn_probability double, risk_level string")
    s = O.prediction_stats(log).first()
    assert s["churn_rate"] == 60.0 and s["total_predictions"] == 5 and s["n_high"] == 3
    empty = O.batch_summary(log.limit(0)).first()
    assert empty["total"] == 0 and empty["churn_rate"] == 0.0


def test_history_roundtrip(spark, tmp_path):
    path = str(tmp_path / "hist")
    assert ART.read_history(spark, path).count() == 0
    ART.append_history(spark, path, "2024-01-01 00:00:00", "drift", "LogisticRegression")
    assert ART.read_history(spark, path).count() == 1


def test_read_by_suffix(spark, tmp_path):
    with pytest.raises(ValueError):
        ART.read_by_suffix(spark, str(tmp_path / "x.xlsx"))
    with pytest.raises(FileNotFoundError):
        ART.read_customers_csv(spark, str(tmp_path / "missing.csv"))


def test_log_epochs_commit_replay_and_compact(spark, tmp_path):
    path = str(tmp_path / "log")
    make = lambda ids: LG.to_log_records(spark.createDataFrame(
        [(f"C{i}", i % 2, .5, f"2024-01-{i % 3 + 10} 10:00:00", f"t{i}") for i in ids], "customerID string, prediction int, churn_probability double, ts string, tag string"),
        ["prediction"], ts_col="ts", extra={"source": "test", "tag": F.col("tag")})
    ids = lambda: sorted(int(r.customer_id[1:]) for r in LG.read_log(spark, path).collect())
    assert LG.append_log(make(range(5)), path, epoch="a") and ids() == list(range(5))
    # A writer that dies after it has staged its records: nothing is seen, and the epoch's next attempt replaces them.
    LG.stage_epoch(make(range(5, 99)), path, "b")
    assert ids() == list(range(5))
    assert LG.append_log(make(range(5, 9)), path, epoch="b") and ids() == list(range(9))
    # A replay of a committed epoch changes nothing.
    assert not LG.append_log(make(range(5, 9)), path, epoch="b") and ids() == list(range(9))
    LG.append_log(make(range(9, 12)), path)
    row = LG.read_log(spark, path).filter("customer_id = 'C3'").first()
    assert row.extra == {"source": "test", "tag": "t3"} and str(row.log_date) == "2024-01-10"
    # Compaction that dies before its manifest changes nothing; a finished one is one epoch with the same records.
    before = sorted(map(str, LG.read_log(spark, path).collect()))
    LG.stage_epoch(LG.read_log(spark, path), path, "compact-dead")
    assert ids() == list(range(12))
    name = LG.compact_log(spark, path)
    assert LG.committed_epochs(spark, path) == [name] and sorted(map(str, LG.read_log(spark, path).collect())) == before
    assert not LG.append_log(make(range(5)), path, epoch="a") and ids() == list(range(12))  # still known
    assert LG.vacuum_log(spark, path) == 4 and ids() == list(range(12)) and LG.compact_log(spark, path) is None
    assert LG.read_log(spark, path, as_of="2024-01-10", days=1).count() == 4
    assert LG.purge_expired(spark, path, "2024-02-01", 21) == 1 and LG.read_log(spark, path).count() == 8
    # A plain folder of JSON Lines is read as it is.
    make(range(3)).write.partitionBy("log_date").json(str(tmp_path / "plain"))
    assert LG.read_log(spark, str(tmp_path / "plain")).count() == 3
