"""End-to-end jobs: train (M11), evaluate (E8), monitoring report (O6), retrain.

Driver-side code here only sequences Spark jobs and moves scalars / small reports; all row-level
work runs on executors.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ColumnRoles, DriftConfig, MonitorConfig, TrainConfig
from ..operators import cleaning as C
from ..operators import drift as D
from ..operators import evaluate as E
from ..operators import monitor as O
from ..operators import train as M
from ..operators.features import add_features, fit_monthly_median
from ..operators.preprocess import fit_preprocessor
from ..operators.rows import combine_rows
from ..operators.score import ChurnModel, score
from ..operators.split import stratified_split
from ..sources import artifacts as ART


@dataclass
class TrainResult:
    model: ChurnModel
    comparison: DataFrame
    evaluation: DataFrame
    timings: dict = field(default_factory=dict)
    mode: str = "csv"


def prepare_training_frame(raw: DataFrame, cfg: TrainConfig = TrainConfig(), roles: ColumnRoles = ColumnRoles()
                           ) -> tuple[DataFrame, DataFrame, float | None, float | None]:
    """Strict target → stratified split (+ folds) → medians fitted on the train side only →
    clean + features on both sides with those medians."""
    df = C.target_strict(raw, roles.target)
    split = stratified_split(df, roles.target, roles.id_col, cfg.split.test_size, cfg.split.seed,
                             cfg.split.stratify, cfg.split.folds)
    # The split feeds several fits (medians, modes, indexers, CV): compute it once.
    split = split.persist()
    train = split.filter(F.col("split") == "train")
    test = split.filter(F.col("split") == "test")
    tc_med = C.fit_total_charges_median(train)
    train_c = C.clean_total_charges(train, tc_med, fit=False)
    mc_med = fit_monthly_median(train_c)
    train_f = add_features(train_c, mc_med, fit=False)
    test_f = add_features(C.clean_total_charges(test, tc_med, fit=False), mc_med, fit=False)
    return train_f, test_f, tc_med, mc_med


def training_partitions(df: DataFrame, rows_per_partition: int = 100_000) -> DataFrame:
    """A cached training frame in partitions of about that many rows: every iteration of an optimizer is a job over
    them. No draw depends on them."""
    df = df.cache()
    return df.coalesce(max(1, -(-df.count() // rows_per_partition))).cache()


@dataclass
class Search:
    """A grid search before the gate: prepared frames, the report of every family and the fitted models."""
    pre: PipelineModel
    train: DataFrame
    test: DataFrame
    table: DataFrame
    fitted: dict
    medians: tuple[float | None, float | None]
    columns: tuple[list[str], list[str]]
    timings: dict


def search_models(raw: DataFrame, cfg: TrainConfig = TrainConfig(), roles: ColumnRoles = ColumnRoles(),
                  families: tuple[str, ...] | None = None, candidates: list[M.Candidate] | None = None) -> Search:
    """M1–M6, M9: ingest → clean/features → fitted preprocessor → CV grid search, without the gate."""
    t = {}
    t0 = time.time()
    train_f, test_f, tc_med, mc_med = prepare_training_frame(raw, cfg, roles)
    num_cols, cat_cols = C.resolve_roles(train_f, roles)
    t["prepare"] = time.time() - t0
    t0 = time.time()
    pre = fit_preprocessor(train_f, num_cols, cat_cols, scale_onehot=True)
    label = F.col(roles.target).cast("double").alias("label")
    tr = training_partitions(pre.transform(train_f).select("features", label, "fold", F.xxhash64(roles.id_col).alias("key")))
    te = training_partitions(pre.transform(test_f).select("features", label, roles.id_col))
    t["preprocess"] = time.time() - t0
    t0 = time.time()
    cands = [c for c in candidates or M.default_grids() if not families or c.name in families]
    table, fitted = M.grid_search(tr, te, cands, parallelism=cfg.parallelism, num_folds=cfg.split.folds)
    t["search"] = time.time() - t0
    return Search(pre, tr, te, table, fitted, (tc_med, mc_med), (num_cols, cat_cols), t)


def model_comparison(raw: DataFrame, cfg: TrainConfig = TrainConfig()) -> DataFrame:
    """The comparison of all families with the winner and the gate's verdict, which here raises nothing."""
    found = search_models(raw, cfg)
    best = M.best_model(found.table)
    return M.comparison(found.table, best and best["model"], cfg.min_f1)


def train_pipeline(raw: DataFrame, cfg: TrainConfig = TrainConfig(), roles: ColumnRoles = ColumnRoles(),
                   out_dir: str | None = None, mode: str = "csv", families: tuple[str, ...] | None = None,
                   candidates: list[M.Candidate] | None = None) -> TrainResult:
    """Ingest → clean/features → fitted preprocessor → CV grid search → gate → persist → E8.
    ``candidates`` replaces the default grids, ``families`` restricts them by name."""
    found = search_models(raw, cfg, roles, families, candidates)
    pre, tr, te, table, fitted, t = found.pre, found.train, found.test, found.table, found.fitted, found.timings
    best = M.select_best(table, cfg.min_f1)
    pipeline = PipelineModel(stages=list(pre.stages) + [fitted[best]])
    model = ChurnModel(pipeline, *found.medians, *found.columns, best,
                       spec=getattr(pre, "_retainlens_spec", None))
    if out_dir:
        model.save(f"{out_dir}/model")
        ART.write_report(table, f"{out_dir}/train_metrics")
    t0 = time.time()
    scored = fitted[best].transform(te).select(
        F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("score"))
    evaluation = E.evaluation_report(scored)
    if out_dir:
        ART.write_report(evaluation, f"{out_dir}/evaluation_metrics")
    t["evaluate"] = time.time() - t0
    tr.unpersist()
    te.unpersist()
    return TrainResult(model, M.comparison(table, best, cfg.min_f1), evaluation, t, mode)


def evaluate_labelled(model: ChurnModel, labelled: DataFrame, target: str = "Churn",
                      id_col: str = "customerID") -> DataFrame:
    """Score labelled outcomes with a stored model and report E1–E4 in one row."""
    df = C.target_strict(labelled, target)
    s = score(model, df, id_col, keep=[target])
    prob = s.select(F.col(target).alias("label"), "prediction", F.col("churn_probability").alias("score"))
    return E.evaluation_report(prob)


def monitoring_report(log: DataFrame, reference: DataFrame | D.Profile, baseline_metrics: DataFrame,
                      current_metrics: DataFrame, as_of: str, days: int = 7,
                      drift_cfg: DriftConfig = DriftConfig(), mon_cfg: MonitorConfig = MonitorConfig(),
                      feature_schema: str | None = None) -> dict[str, DataFrame]:
    """Prediction stats (A15) + drift of the logged inputs vs the reference (H9) + performance
    degradation of real current metrics (O1) — all over the whole window (no 500-row cap)."""
    from ..sources.prediction_log import day_window, log_features
    window = day_window(log, as_of, days)
    stats = O.prediction_stats(window)
    feats = log_features(window, feature_schema) if feature_schema else window
    stored = isinstance(reference, D.Profile)
    drift = D.drift_report_from_profile(reference, feats, drift_cfg) if stored else D.drift_report(reference, feats, drift_cfg)
    deg = O.degradation(baseline_metrics, current_metrics, mon_cfg)
    return {"stats": stats, "drift": drift, "degradation": deg,
            "performance": O.performance_status(deg)}


def retrain_run(spark: SparkSession, raw: DataFrame, signals: DataFrame, history_path: str, as_of: str,
                out_dir: str, force: bool = False, cfg: TrainConfig = TrainConfig(),
                mon_cfg: MonitorConfig = MonitorConfig(), mode: str = "csv",
                families: tuple[str, ...] | None = None) -> dict:
    """Gate → train → refresh the reference profile (raw mode only) → append a history event."""
    hist = ART.read_history(spark, history_path)
    cool = O.cooldown(hist, as_of, mon_cfg.cooldown_hours).select("cooldown_ok")
    gated = O.retrain_gate(combine_rows(signals, cool), force=force,
                           enabled=mon_cfg.retrain_enabled, auto=mon_cfg.auto_retrain).first()
    if not gated["should_retrain"]:
        return {"retrained": False, "reason": gated["gate_reason"]}
    result = train_pipeline(raw, cfg, out_dir=out_dir, mode=mode, families=families)
    if mode == "csv":
        num, cat = D.reference_profile(raw)
        D.save_reference_profile(num, cat, f"{out_dir}/reference_profile")
        D.save_profile(D.profile(raw), f"{out_dir}/reference_profile")
    ART.append_history(spark, history_path, as_of, gated["gate_reason"], result.model.model_name)
    return {"retrained": True, "reason": gated["gate_reason"], "model": result.model.model_name,
            "timings": result.timings}
