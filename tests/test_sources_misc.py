"""File sources / sinks and small predicates."""

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from retainlens.operators import cleaning as C
from retainlens.operators import split as X
from retainlens.plans import views as V
from retainlens.sources import artifacts as ART


def test_csv_roundtrip_and_suffix_dispatch(spark, sf, tmp_path):
    subs = V.subscribers(spark, sf)
    csv = str(tmp_path / "raw.csv")
    subs.coalesce(1).write.option("header", True).csv(csv)
    back = ART.read_customers_csv(spark, csv)
    assert back.count() == subs.count() and back.columns == subs.columns
    assert dict(back.dtypes)["tenure"] == "int" and dict(back.dtypes)["TotalCharges"] == "string"
    pq = str(tmp_path / "raw.parquet")
    subs.write.parquet(pq)
    assert ART.read_by_suffix(spark, pq).count() == subs.count()
    assert ART.read_by_suffix(spark, csv, ART.CUSTOMER_SCHEMA).count() == subs.count()


def test_prepared_matrix_and_fallback(spark, tmp_path):
    df = spark.createDataFrame([(Vectors.dense([1.0, 2.0]), 1.0), (Vectors.dense([0.0, 1.0]), 0.0)],
                               ["features", "label"])
    path = str(tmp_path / "prepared")
    ART.write_prepared(df, path, {"n_rows": 2, "n_features": 2, "target": "Churn", "seed": 42})
    got, mode = ART.load_training_source(spark, f"{path}/data", str(tmp_path / "missing.csv"))
    assert mode == "npz" and got.count() == 2
    assert spark.read.json(f"{path}/metadata").first()["n_features"] == 2
    df.select("features").write.parquet(str(tmp_path / "broken"))
    with pytest.raises(KeyError):
        ART.read_prepared(spark, str(tmp_path / "broken"))
    with pytest.raises(FileNotFoundError):
        ART.load_training_source(spark, str(tmp_path / "nope"), str(tmp_path / "missing.csv"))


def test_reports_roundtrip(spark, tmp_path):
    rep = spark.createDataFrame([("f1", 0.6)], "metric string, value double")
    for fmt in ("json", "parquet"):
        ART.write_report(rep, str(tmp_path / fmt), fmt)
        assert ART.read_report(spark, str(tmp_path / fmt), fmt).first()["metric"] == "f1"
    with pytest.raises(FileNotFoundError):
        ART.read_report(spark, str(tmp_path / "none"))


def test_high_cardinality_and_min_samples(spark, sf):
    subs = V.subscribers(spark, sf)
    keep = C.low_cardinality_columns(subs, ["customerID", "Contract", "gender"], max_unique=100)
    assert keep == ["Contract", "gender"]
    assert C.has_min_samples(subs, 50) and not C.has_min_samples(subs.limit(10), 50)


def test_reference_sample(spark, sf):
    subs = V.subscribers(spark, sf)
    assert X.reference_sample(subs, "tenure").count() == subs.count()
    s = X.reference_sample(subs, "tenure", n=20, id_col="customerID")
    assert s.count() == 20
    assert sorted(r[0] for r in s.collect()) == sorted(r[0] for r in
                                                      X.reference_sample(subs, "tenure", n=20, id_col="customerID").collect())


def test_roles(spark, sf):
    subs = V.subscribers(spark, sf)
    num, cat = C.infer_roles(subs, "Churn", "customerID")
    assert num == ["SeniorCitizen", "tenure", "MonthlyCharges"] and "TotalCharges" in cat
    rnum, rcat = C.resolve_roles(subs)
    assert rnum == ["tenure", "MonthlyCharges", "TotalCharges"] and "customerID" not in rcat
    X_, y = C.split_xy(subs, rnum)
    assert X_.columns == rnum and y.columns == ["Churn"]
    assert "Churn" not in C.drop_target_id(subs).columns


def test_release_drops_shuffle_files_of_finished_work(spark):
    """Shuffle files of tables that nothing refers to go away between the stages of a long job."""
    import time

    from retainlens.session import release
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    spark.range(1000).repartition(7).count()
    files = lambda: sum(1 for b in manager.getAllBlocks().mkString("\n").split("\n") if b.startswith("shuffle_") and b.endswith(".data"))
    made = files()
    for _ in range(20):
        release(spark)
        if files() < made:
            break
        time.sleep(0.5)
    assert files() < made
