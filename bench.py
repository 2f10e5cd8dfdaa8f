"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints ONE JSON line.

Every query is forced with the ``noop`` sink (full execution, nothing collected). Model training
for the scoring benchmark happens once before timing (the reference's number is inference only).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from retainlens.plans import catalog, views as V  # noqa: E402
from retainlens.session import get_session  # noqa: E402

HEADLINE = [
    "q_add_features", "q_audit", "q_chi_square", "q_welch", "q_correlation_lower", "q_roc_auc",
    "q_avg_precision", "q_roc_curve", "q_ks", "q_psi_numeric", "q_drift_report", "q_prediction_stats_daily",
    "q_latest_predictions", "q_degradation", "q_stratified_split", "q_stream_daily_stats",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = get_session("retainlens-bench")
    qs = catalog.QUERIES
    run(qs["q_positive_rate_by_contract"](spark, sf_dir))  # warm-up (JVM, codegen, file listing)
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        run(qs[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - t0, 3)

    # Batch scoring throughput: a model fitted once, then every subscriber scored.
    from retainlens.operators import cleaning as C
    from retainlens.operators import preprocess as T
    from retainlens.operators import train as M
    from retainlens.operators.score import ChurnModel, score
    from retainlens.plans import jobs as J
    from pyspark.ml import PipelineModel
    raw = V.subscribers(spark, sf_dir)
    train_f, _, tc_med, mc_med = J.prepare_training_frame(raw, J.TrainConfig(min_f1=0.0))
    num, cat = C.resolve_roles(train_f)
    pre = T.fit_preprocessor(train_f, num, cat)
    tr = pre.transform(train_f).select("features", F.col("Churn").cast("double").alias("label"))
    n = tr.count()
    model = ChurnModel(PipelineModel(stages=list(pre.stages) + [M.logistic(n).fit(M.balanced(tr, "label"))]),
                       tc_med, mc_med, num, cat, "LogisticRegression", spec=getattr(pre, "_retainlens_spec", None))
    n_rows = raw.count()
    t0 = time.perf_counter()
    run(score(model, raw))
    score_sec = time.perf_counter() - t0
    times["score_batch"] = round(score_sec, 3)

    # Request-style latency (the reference's serving numbers): an in-memory batch scored and
    # collected, median of 5 runs after one warm-up. Reported, not added to the total.
    sample = raw.limit(100).collect()
    lat = {}
    for size in (1, 100):
        req = spark.createDataFrame(sample[:size], raw.schema)
        score(model, req).collect()
        runs = []
        for _ in range(5):
            t0 = time.perf_counter()
            score(model, req).collect()
            runs.append(time.perf_counter() - t0)
        lat[size] = round(sorted(runs)[2] * 1000, 1)

    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir).replace("sf", ""),
        "score_rows": n_rows, "score_rows_per_sec": round(n_rows / score_sec, 1),
        "latency_single_ms": lat[1], "latency_batch100_ms": lat[100],
        "cpus": int(os.environ.get("BENCH_CPUS", "8")),
    }))


if __name__ == "__main__":
    main()
