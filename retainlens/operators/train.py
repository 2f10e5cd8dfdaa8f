"""Model training and selection.

The grid is searched over a precomputed stratified ``fold`` column, scored by the F1 of class 1. Tree
families share their fits over folds and over the prefixes of a model (see ``ensembles``); logistic
regression is Spark ML's, cross-validated with parallel fits. The best combination of each family is
fitted again on all training rows and judged on the test rows.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ensembles as T
from . import evaluate as E


class ModelQualityError(RuntimeError):
    """M8: the best model is below the F1 quality gate."""


@dataclass
class Candidate:
    """A model family and the combinations to search: ``kind`` is "logistic", "forest", "xgb" or "gb"."""
    name: str
    kind: str
    grid: list[dict]


def _product(**values) -> list[dict]:
    out = [{}]
    for name, options in values.items():
        out = [{**o, name: v} for o in out for v in options]
    return out


def default_grids() -> list[Candidate]:
    """M1–M4: the reference's 42 combinations (4, 12, 18 and 8)."""
    # The parameter grids; None is an unlimited depth.
    return [Candidate("LogisticRegression", "logistic", _product(C=[0.01, 0.1, 1.0, 10.0])),
            Candidate("RandomForestClassifier", "forest", _product(n_estimators=[100, 300], max_depth=[5, 10, None], min_samples_split=[5, 10])),
            Candidate("XGBClassifier", "xgb", _product(learning_rate=[0.01, 0.05, 0.1], max_depth=[3, 5, 7], n_estimators=[100, 300])),
            Candidate("GradientBoostingClassifier", "gb", _product(n_estimators=[100, 300], learning_rate=[0.05, 0.1], max_depth=[3, 5]))]


def logistic(n_train: int, c: float = 1.0, label: str = "label", features: str = "features") -> LogisticRegression:
    """M1: L2 logistic regression; C and Spark's regParam are related by 1 / (C · Σw), balanced weights sum to n."""
    return LogisticRegression(featuresCol=features, labelCol=label, weightCol="weight", maxIter=1000, elasticNetParam=0.0,
                              standardization=False, regParam=1.0 / (c * n_train))


def balanced(df: DataFrame, label: str) -> DataFrame:
    """X4 as a column: n / (2 n_c) from one small aggregate."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    n = sum(counts.values())
    w = F.lit(0.0)
    for cls, c in counts.items():
        w = F.when(F.col(label) == cls, F.lit(n / (2.0 * c))).otherwise(w)
    return df.withColumn("weight", w)


def test_reports(scored: DataFrame, by: str = "model") -> DataFrame:
    """M6: f1, recall, precision, accuracy, roc_auc (exact) of the test predictions of each model, from rows
    (model, label, prediction, score)."""
    auc = E.roc_auc(scored, by=[by]).select(by, F.round("roc_auc", 4).alias("roc_auc"))
    return E.metrics(scored, by=[by]).join(auc, by, "left").select(by, "f1", "recall", "precision", "accuracy", "roc_auc")


def _test_rows(name: str, model, test: DataFrame, label: str) -> DataFrame:
    return model.transform(test).select(F.lit(name).alias("model"), F.col(label).cast("int").alias("label"),
                                        F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability")[1].alias("score"))


def _spec(kind: str, p: dict, fold: int, seed: int) -> T.Spec:
    return T.Spec(kind, fold, (p["n_estimators"],), (p["max_depth"],), p.get("learning_rate", 0.1), p.get("min_samples_split", 2), seed)


def shared_specs(kind: str, grid: list[dict], folds: int, seed: int = 42) -> list[T.Spec]:
    """The fits that serve all combinations of a tree family: one for each learning rate, depth and fold (boosting),
    or for each least split size and fold (forests); smaller models are prefixes of them."""
    merged: dict = {}
    for p in grid:
        s = _spec(kind, p, 0, seed)
        of = s.min_split if kind == "forest" else (s.rate, s.depths)
        sizes, depths = merged.setdefault(of, (s, set(), set()))[1:]
        sizes.update(s.sizes)
        depths.update(s.depths)
    deep = lambda d: (d is None, d or 0)
    return [T.Spec(kind, fold, tuple(sorted(sizes)), tuple(sorted(depths, key=deep)), s.rate, s.min_split, seed)
            for s, sizes, depths in merged.values() for fold in range(folds)]


def cv_scores(train: DataFrame, candidates: list[Candidate], edges: list, folds: int, seed: int = 42, busy=(), **columns) -> dict[str, list[float]]:
    """Mean F1 over the folds of every combination of the tree families."""
    specs = [(c, s) for c in candidates for s in shared_specs(c.kind, c.grid, folds, seed)]
    f1: dict = {}
    for i, size, depth, (tp, fp, fn), _ in T.fit(train, [s for _, s in specs], edges, busy=busy, **columns):
        c, s = specs[i]
        of = (s.min_split, size, depth) if c.kind == "forest" else (s.rate, size, depth)
        f1.setdefault((c.name, of), []).append(2 * tp / (2 * tp + fp + fn) if tp else 0.0)
    lead = lambda c, p: p["min_samples_split"] if c.kind == "forest" else p["learning_rate"]
    return {c.name: [sum(x) / len(x) for p in c.grid for x in [f1[c.name, (lead(c, p), p["n_estimators"], p["max_depth"])]]] for c in candidates}


def _search_logistic(train: DataFrame, c: Candidate, label: str, fold: str, folds: int, parallelism: int):
    tr = balanced(train, label).cache()
    try:
        n = tr.count()
        lr = logistic(n, label=label)
        grid = ParamGridBuilder().addGrid(lr.regParam, [1.0 / (p["C"] * n) for p in c.grid]).build()
        evaluator = MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel", metricLabel=1.0)
        found = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=evaluator, foldCol=fold, numFolds=folds, parallelism=parallelism, seed=42).fit(tr)
    finally:
        tr.unpersist()
    scores = list(found.avgMetrics)
    return c, found.bestModel, c.grid[scores.index(max(scores))], max(scores)


def _search_trees(train: DataFrame, candidates: list[Candidate], label: str, fold: str, folds: int, key: str, busy) -> list:
    if not candidates:
        return []
    columns = {"label": label, "fold": fold, "key": key}
    edges = T.bin_edges(train)
    scores = cv_scores(train, candidates, edges, folds, busy=busy, **columns)
    best = {c.name: scores[c.name].index(max(scores[c.name])) for c in candidates}
    specs = [_spec(c.kind, c.grid[best[c.name]], -1, 42) for c in candidates]
    out = []
    for (i, _, _, _, model), c in zip(T.fit(train, specs, edges, busy=busy, **columns), candidates):
        p = c.grid[best[c.name]]
        out.append((c, T.ensemble_model(c.kind, model, p), p, max(scores[c.name])))
    return out


def grid_search(train: DataFrame, test: DataFrame, candidates: list[Candidate], label: str = "label", fold_col: str = "fold",
                key_col: str = "key", parallelism: int = 4, num_folds: int = 5) -> tuple[DataFrame, dict]:
    """M5 + M6 + M9: cross-validated search of every family, the best combination fitted on all of ``train`` and
    judged on ``test``. ``key_col`` (long) tells training rows apart.

    Returns (comparison table, {name: fitted best model})."""
    # The families are independent: their Spark jobs are submitted concurrently from driver threads. The linear fits are many
    # short jobs, which would wait for the long ones of the trees if these held all slots.
    with ThreadPoolExecutor(max_workers=4) as pool:
        linear = [pool.submit(_search_logistic, train, c, label, fold_col, num_folds, parallelism) for c in candidates if c.kind == "logistic"]
        trees = _search_trees(train, [c for c in candidates if c.kind != "logistic"], label, fold_col, num_folds, key_col, linear)
        found = {c.name: (model, p, score) for c, model, p, score in [*trees, *(x.result() for x in linear)]}
    # Predictions are made once, in as many tasks as can run: a deep forest takes most of their time.
    test = test.repartition(test.sparkSession.sparkContext.defaultParallelism)
    scored = reduce(DataFrame.unionAll, [_test_rows(c.name, found[c.name][0], test, label) for c in candidates]).persist()
    try:
        reports = {r.model: r for r in test_reports(scored).collect()}
    finally:
        scored.unpersist()
    rows = [(c.name, r.f1, r.recall, r.precision, r.accuracy, r.roc_auc, ",".join(f"{k}={v}" for k, v in sorted(p.items())), round(float(score), 4))
            for c in candidates for r, (_, p, score) in [(reports[c.name], found[c.name])]]
    table = train.sparkSession.createDataFrame(rows, "model string, f1 double, recall double, precision double, "
                                                     "accuracy double, roc_auc double, best_params string, cv_best_score double")
    return table, {c.name: found[c.name][0] for c in candidates}


def best_model(table: DataFrame):
    """M7: the row of the largest test F1 (the first of equal ones), None if there is none."""
    return max(table.collect(), key=lambda r: r["f1"] or 0, default=None)


def select_best(table: DataFrame, min_f1: float = 0.5) -> str:
    """M7 + M8: the best model's name; below the gate → error."""
    best = best_model(table)
    if best is None or (best["f1"] or 0) < min_f1:
        raise ModelQualityError(f"best F1 {None if best is None else best['f1']} is below the gate {min_f1}")
    return best["model"]


def comparison(table: DataFrame, best: str | None, min_f1: float = 0.5) -> DataFrame:
    """The model comparison table, best F1 first; ``is_best`` marks the winner, ``accepted`` says whether a model passes the gate."""
    return table.withColumn("is_best", F.col("model") == F.lit(best)).withColumn(
        "accepted", F.coalesce(F.col("f1"), F.lit(0.0)) >= min_f1).orderBy(F.desc("f1"), "model")
