"""X*, T*, M*, P*: split contract, preprocessing width / unknowns, quality gate, persistence, scoring."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from retainlens.config import TrainConfig
from retainlens.operators import cleaning as C
from retainlens.operators import ensembles as EN
from retainlens.operators import preprocess as T
from retainlens.operators import split as X
from retainlens.operators import train as M
from retainlens.operators.score import ChurnModel, score
from retainlens.plans import jobs as J
from retainlens.plans import views as V
from retainlens.plans.eda import EDA_CATEGORICAL, EDA_NUMERIC, eda_frame


@pytest.fixture(scope="module")
def subs(spark, sf):
    return V.subscribers(spark, sf).cache()


def test_stratified_split_contract(spark, subs):
    df = C.target_lenient(subs)
    s = X.stratified_split(df, "Churn", "customerID", 0.2, 42).cache()
    n = s.count()
    assert n == df.count() and s.select("customerID").distinct().count() == n      # exhaustive, disjoint
    rates = {r["Churn"]: r["test_rate"] for r in s.groupBy("Churn").agg(
        F.avg((F.col("split") == "test").cast("double")).alias("test_rate")).collect()}
    assert all(abs(v - 0.2) <= 0.05 for v in rates.values())
    folds = [r["count"] for r in s.groupBy("fold").count().collect()]
    assert len(folds) == 5 and max(folds) - min(folds) <= 2
    h = X.stratified_split(df, method="hash")
    assert abs(h.filter("split = 'test'").count() / n - 0.2) < 0.1


def test_class_weights_balanced(spark, subs):
    w = {r["Churn"]: (r["n_class"], r["weight"]) for r in X.class_weights(C.target_lenient(subs)).collect()}
    n = sum(c for c, _ in w.values())
    assert all(abs(wt - n / (2 * c)) < 1e-12 for c, wt in w.values())
    assert sum(c * wt for c, wt in w.values()) == pytest.approx(n)


def test_preprocessor_width_and_unknown(spark, subs):
    df = eda_frame(subs)
    pre = T.fit_preprocessor(df, EDA_NUMERIC, EDA_CATEGORICAL, scale_onehot=False)
    n_cats = sum(r[0] for r in [df.select(F.countDistinct(c)).first() for c in EDA_CATEGORICAL])
    width = len(pre.transform(df).first()["features"])
    assert width == len(EDA_NUMERIC) + n_cats
    unknown = df.limit(1).withColumn("Contract", F.lit("Ten year"))
    v = pre.transform(unknown).select(vector_to_array("features").alias("a")).first()["a"]
    names = T.feature_names(pre, EDA_NUMERIC, EDA_CATEGORICAL)
    assert all(v[i] == 0.0 for i, nm in enumerate(names) if nm.startswith("Contract_"))
    # numeric block is standardised with the population std
    z = pre.transform(df).select(vector_to_array("features")[0].alias("z"))
    st = z.agg(F.avg("z"), F.stddev_pop("z")).first()
    assert abs(st[0]) < 1e-9 and abs(st[1] - 1) < 1e-9


def test_onehot_scaling_population_std(spark, subs):
    df = eda_frame(subs)
    pre = T.fit_preprocessor(df, ["tenure"], ["Contract"], scale_onehot=True)
    arr = pre.transform(df).select(vector_to_array("features").alias("a"))
    col1 = arr.select(F.col("a")[1].alias("x"))
    st = col1.agg(F.stddev_pop("x")).first()[0]
    assert st == pytest.approx(1.0, abs=1e-9)


def test_quality_gate_raises(spark, subs):
    with pytest.raises(M.ModelQualityError):
        J.train_pipeline(subs, TrainConfig(min_f1=0.99), families=("LogisticRegression",))


SMALL = [M.Candidate("RandomForestClassifier", "forest", M._product(n_estimators=[3, 7], max_depth=[2, None], min_samples_split=[10])),
         M.Candidate("XGBClassifier", "xgb", M._product(learning_rate=[0.1, 0.3], max_depth=[3], n_estimators=[4, 9])),
         M.Candidate("GradientBoostingClassifier", "gb", M._product(n_estimators=[4, 9], learning_rate=[0.3], max_depth=[2]))]


@pytest.fixture(scope="module")
def training(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(400, 5))
    x[:, 3] = r.integers(0, 2, 400)
    y = (x[:, 0] * x[:, 1] + x[:, 3] + .5 * r.normal(size=400) > .6).astype(float)
    rows = [(Vectors.dense(v), float(t), i % 5, i * 7919) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, ["features", "label", "fold", "key"]).cache()
    return df, EN.bin_edges(df)


def test_grid_has_42_combinations(spark):
    assert [len(c.grid) for c in M.default_grids()] == [4, 12, 18, 8]
    assert [len(M.shared_specs(c.kind, c.grid, 5)) for c in M.default_grids()[1:]] == [10, 45, 20]
    lr = M.logistic(100, 0.1)
    assert lr.getMaxIter() == 1000 and lr.getTol() == 1e-6 and lr.getRegParam() == pytest.approx(0.1)


def test_shared_fits_equal_separate_fits(spark, training, monkeypatch):
    df, edges = training
    shared = M.cv_scores(df, SMALL, edges, 2)
    alone = {}
    for c in SMALL:
        specs = [(i, M._spec(c.kind, p, fold, 42)) for i, p in enumerate(c.grid) for fold in range(2)]
        for n, _, _, (tp, fp, fn), _ in EN.fit(df, [s for _, s in specs], edges):
            alone.setdefault((c.name, specs[n][0]), []).append(2 * tp / (2 * tp + fp + fn) if tp else 0.0)
    assert {c.name: [pytest.approx(sum(alone[c.name, i]) / 2) for i in range(len(c.grid))] for c in SMALL} == shared
    # Rows over several tasks, which sum their histograms: the same figures.
    monkeypatch.setattr(EN, "CELLS", 700)
    assert {n: [pytest.approx(x) for x in v] for n, v in M.cv_scores(df, SMALL[1:], edges, 2).items()} == {n: shared[n] for n in shared if n != "RandomForestClassifier"}


def test_ensembles_learn_and_stages_persist(spark, training, tmp_path):
    from pyspark.ml import PipelineModel
    df, edges = training
    for c, p in ((SMALL[0], {"n_estimators": 60, "max_depth": None, "min_samples_split": 5}), (SMALL[1], {"n_estimators": 60, "max_depth": 3, "learning_rate": .2}),
                 (SMALL[2], {"n_estimators": 60, "max_depth": 3, "learning_rate": .2})):
        (_, _, _, _, model), = EN.fit(df, [M._spec(c.kind, p, -1, 42)], edges)
        stage = EN.ensemble_model(c.kind, model, p)
        got = stage.transform(df).select("key", "label", "prediction", "probability").orderBy("key").collect()
        assert sum(r.label == r.prediction for r in got) > 340 and all(r.prediction == float(r.probability[1] > .5) for r in got)
        PipelineModel(stages=[stage]).write().overwrite().save(str(tmp_path / c.kind))
        back = PipelineModel.load(str(tmp_path / c.kind)).transform(df).select("key", "label", "prediction", "probability").orderBy("key").collect()
        assert back == got
        # Row by row down the trees.
        start, trees = model
        x = df.orderBy("key").select("features").first()[0].toArray()
        total = []
        for f, cut, child, value in trees:
            at = 0
            while f[at] >= 0:
                at = child[at] + (x[f[at]] > cut[at])
            total.append(value[at])
        want = np.mean(total) if c.kind == "forest" else 1 / (1 + np.exp(-start - sum(total)))
        assert got[0].probability[1] == pytest.approx(want)


def test_train_persist_score_roundtrip(spark, subs, tmp_path):
    res = J.train_pipeline(subs, TrainConfig(min_f1=0.0), out_dir=str(tmp_path),
                           candidates=[M.default_grids()[0], M.Candidate("XGBClassifier", "xgb", M._product(learning_rate=[.1], max_depth=[3], n_estimators=[40]))])
    comp = res.comparison.collect()
    assert len(comp) == 2 and sum(r["is_best"] for r in comp) == 1
    assert comp[0]["is_best"] and comp[0]["f1"] == max(r["f1"] for r in comp)
    ev = res.evaluation.first()
    assert ev["tn"] + ev["fp"] + ev["fn"] + ev["tp"] == ev["total"] and 0 <= ev["roc_auc"] <= 1
    loaded = ChurnModel.load(spark, str(tmp_path / "model"))
    a = score(res.model, subs).orderBy("customerID").collect()
    b = score(loaded, subs).orderBy("customerID").collect()
    assert a == b and len(a) == subs.count()
    assert all(r["risk_level"] in ("Low", "Medium", "High") and 0 <= r["churn_probability"] <= 1 for r in a)
    with pytest.raises(FileNotFoundError):
        ChurnModel.load(spark, str(tmp_path / "nope"))


def test_pca_variance(spark, subs):
    df = eda_frame(subs)
    feats = T.fit_preprocessor(df, EDA_NUMERIC, EDA_CATEGORICAL, scale_onehot=False).transform(df)
    ratios, k90, k95, d = T.pca_variance(feats)
    assert len(ratios) == min(50, d) and sum(ratios) <= 1 + 1e-9
    assert 1 <= k90 <= k95 <= len(ratios)
    proj = T.pca_project(feats, k95)
    assert len(proj.first()["pca"]) == k95


def test_compiled_fast_path_equals_pipeline(spark, subs):
    """The fast scorer (expressions + classifier only) gives bit-identical probabilities to the
    full stage pipeline, for a linear and a tree model, including an unseen category."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from retainlens.functions.expressions import RISK_LABELS, RISK_THRESHOLDS
    from retainlens.operators.score import CompiledScorer
    train_f, _, tc, mc = J.prepare_training_frame(subs, TrainConfig(min_f1=0.0))
    num, cat = C.resolve_roles(train_f)
    pre = T.fit_preprocessor(train_f, num, cat)
    tr = pre.transform(train_f).select("features", F.col("Churn").cast("double").alias("label"))
    probe = subs.withColumn("Contract", F.when(F.col("tenure") > 70, F.lit("Ten year")).otherwise(F.col("Contract")))
    for est in (LogisticRegression(regParam=0.01), RandomForestClassifier(numTrees=5, maxDepth=4, seed=1)):
        m = ChurnModel(PipelineModel(stages=list(pre.stages) + [est.fit(tr)]), tc, mc, num, cat,
                       spec=pre._retainlens_spec)
        fast = CompiledScorer(m, probe.schema, "customerID", (), RISK_THRESHOLDS, RISK_LABELS, 8, fast=True)
        slow = CompiledScorer(m, probe.schema, "customerID", (), RISK_THRESHOLDS, RISK_LABELS, 8, fast=False)
        assert fast.fast is not None and slow.fast is None
        a = sorted(fast(probe).collect())
        b = sorted(slow(probe).collect())
        assert a == b


def _wide(spark, n=3000):
    """A column of many categories, one of them holding a third of all rows, beside a small and an empty one."""
    rows = [(i, float(i % 7), "hot" if i % 3 == 0 else f"c{i:05d}", None if i % 5 == 0 else "ab"[i % 2], None) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x double, who string, kind string, none string").repartition(5)


def test_dictionary_encoder_equals_constants(spark, monkeypatch, tmp_path):
    """Slots joined from the dictionary equal the compiled one-hot encoding, also after saving; unknown and null categories too."""
    from retainlens.operators import categories as D
    df = _wide(spark)
    few = T.fit_preprocessor(df, ["x"], ["who", "kind"])
    monkeypatch.setattr(D, "COMPILED", 100)
    many = T.fit_preprocessor(df, ["x"], ["who", "kind"])
    assert isinstance(many.stages[1], D.DictionaryEncoder) and not isinstance(few.stages[1], D.DictionaryEncoder)
    live = df.unionByName(spark.createDataFrame([(-1, 2.0, "new", "z", None), (-2, None, None, None, None)], df.schema))
    want = {r.id: r.features for r in few.transform(live).collect()}
    for model in (many, many.copy({})):
        got = {r.id: r.features for r in model.transform(live).collect()}
        assert len(got) == len(want) and all(np.allclose(got[i].toArray(), want[i].toArray()) for i in (-2, -1, 0, 1, 2, 5, 2999))
        assert all(set(got[i].indices) >= set(np.flatnonzero(want[i].toArray())) for i in want)
    kept = D.DictionaryEncoder.load(_saved(many.stages[1].kept_in(spark, f"{tmp_path}/words"), f"{tmp_path}/stage"))
    again = {r.id: r.features for r in kept.transform(many.stages[0].transform(live)).collect()}
    assert all(again[i] == got[i] for i in got)
    with pytest.raises(ValueError):
        T.feature_names(many, ["x"], ["who", "kind"])


def _saved(stage, path):
    stage.write().overwrite().save(path)
    return path


def test_million_categories_fit(spark):
    """A column of a million categories fits; nothing but one row a column reaches the driver."""
    df = spark.range(1_000_000).select("id", (F.col("id") % 3).cast("double").alias("x"), F.concat(F.lit("u"), "id").alias("who"))
    pre = T.fit_preprocessor(df, ["x"], ["who"])
    v = pre.transform(df.filter("id = 999999")).first()["features"]
    assert v.size == 1_000_001 and len(v.indices) == 2 and v.indices[1] == 1_000_000
    assert v.values[1] == pytest.approx(1 / np.sqrt(1e-6 * (1 - 1e-6)))


def test_dictionary_defined_cases(spark):
    """Nulls count as the mode, ties take the smallest, a column of nulls has no row, an empty table none at all."""
    from retainlens.operators import categories as D
    df = spark.createDataFrame([("b", None), ("a", None), ("a", None), ("b", None), (None, None)], "k string, none string")
    got = sorted(tuple(r) for r in D.fit_dictionary(df, ["k", "none"]).select("column", "category", "count", "slot", "n").collect())
    assert got == [("k", "a", 3, 0, 2), ("k", "b", 2, 1, 2)]
    assert T.fit_modes(df, ["k", "none"]) == {"k": "a", "none": None}
    assert D.fit_dictionary(df.limit(0), ["k"]).count() == 0


def test_boosted_fits_are_dealt_to_free_slots():
    """One stage of 15 boosted models would be the longest task of the search, with all other slots idle."""
    specs = [s for c in M.default_grids()[1:] for s in M.shared_specs(c.kind, c.grid, 5)]
    dealt = EN._groups(specs, 8)
    assert sorted(i for g in dealt for i in g) == list(range(len(specs)))
    assert max(len(g) for g in dealt) == 2 and {specs[g[0]].kind for g in dealt[:10]} == {"forest"}
    assert all(len({(specs[i].kind, specs[i].depths) for i in g}) == 1 for g in dealt)
    assert len(EN._groups(specs, 1)) == 15  # tasks that fill the slots share their exchanges


def _one_hot_rows(n=900):
    """Five categorical columns as 20 one-hot features beside a numeric one; ten rows have no category in the first column."""
    r = np.random.default_rng(3)
    kinds = [r.integers(0, 4, n) for _ in range(5)]
    x = np.column_stack([r.normal(size=n), *[(k[:, None] == np.arange(4)).astype(float) for k in kinds]])
    x[:10, 1:5] = 0
    y = ((kinds[0] == 1) ^ (x[:, 0] > 0.3) ^ (r.random(n) < .1)).astype(float)
    edges = [np.quantile(x[:, 0], np.arange(1, 32) / 32), *[np.array([0.0])] * 20]
    return x, y, np.arange(n) % 5, np.arange(n) * 7919, edges


def _rows(x, y, fold, key, edges, at=slice(None)):
    return EN.Rows(EN.binned(x, edges)[at], y[at], fold[at], key[at], edges)


def test_packs_hold_the_sums_of_every_cut():
    """One code a row stands for many one-hot columns, and gives the same sums left of each cut."""
    x, y, fold, key, edges = _one_hot_rows()
    d, w = _rows(x, y, fold, key, edges), np.random.default_rng(1).integers(-50, 50, len(y)).astype(float)
    want = [w[d.bins[:, j] <= b].sum() for j in range(d.width) for b in range(d.size[j] - 1)]
    for most in (1, 64, 256):
        packs = EN.packs(d, most)
        got = np.concatenate([np.bincount(code, w, size) @ left for code, size, left, _ in packs])
        assert got.tolist() == want
    assert len(EN.packs(d, 1)) == 21 and len(EN.packs(d, 256)) <= 6


def test_boosting_counts_few_cells(monkeypatch):
    """A level counts the rows of the lighter children only, each in a few packs: not all rows in all features."""
    x, y, fold, key, edges = _one_hot_rows()
    cells, count = [], np.bincount
    monkeypatch.setattr(EN.np, "bincount", lambda a, *b, **c: (cells.append(len(a)), count(a, *b, **c))[1])
    list(EN.boost([EN.Spec("xgb", 0, (20,), (5,), .1)], _rows(x, y, fold, key, edges), EN.Together(None)))
    assert sum(cells) < 20 * 5 * 2 * 900 * .8 * .8 * 21 / 4


class _Task:
    """One of several tasks in threads, which gather like those of a barrier stage."""

    def __init__(self, number, all_, barrier):
        self.number, self.all, self.barrier = number, all_, barrier

    def partitionId(self):
        return self.number

    def getTaskInfos(self):
        return self.all

    def allGather(self, message):
        self.all[self.number] = message
        self.barrier.wait()
        out = list(self.all)
        self.barrier.wait()
        return out


@pytest.mark.parametrize("kind", ["xgb", "gb"])
def test_boosted_trees_do_not_depend_on_tasks(kind):
    """Sums of gradients are exact: the same trees bit for bit from one task and from three."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier
    x, y, fold, key, edges = _one_hot_rows()
    specs, all_, barrier = [EN.Spec(kind, f, (12,), (4,), .3) for f in (-1, 2)], [None] * 3, Barrier(3)

    def fitted(task, at):
        return [(m and [[v.tolist() for v in t] for t in m[1]], counts) for _, _, _, counts, m in EN.boost(specs, _rows(x, y, fold, key, edges, at), EN.Together(task), edges)]

    one = fitted(None, slice(None))
    with ThreadPoolExecutor(3) as pool:
        three = list(pool.map(lambda i: fitted(_Task(i, all_, barrier), slice(i, None, 3)), range(3)))
    assert one[0][0] == three[0][0][0] == three[2][0][0] and len(one[0][0]) == 12
    assert one[1][1] == np.sum([t[1][1] for t in three], axis=0).tolist()


def test_forests_of_all_least_splits_are_grown_once():
    x, y, fold, key, edges = _one_hot_rows()
    d, specs = _rows(x, y, fold, key, edges), [EN.Spec("forest", 1, (5, 30), (2, 4, None), min_split=m) for m in (10, 40, 5)]
    got = {(s.min_split, size, depth): counts for s, size, depth, counts, _ in EN.forest(specs, d, EN.Together(None))}
    alone = {(s.min_split, size, depth): counts for one in specs for s, size, depth, counts, _ in EN.forest([one], d, EN.Together(None))}
    assert got == alone and len(got) == 18 and len({tuple(c) for c in got.values()}) > 6
    whole = [s for c in M.default_grids()[1:] for s in M.shared_specs(c.kind, c.grid, 5)]
    groups = EN._shared(whole, EN._groups(whole, 8))
    assert sorted(i for g in groups for i in g) == list(range(len(whole))) and sum(whole[g[0]].kind == "forest" for g in groups) == 5
    assert EN._shared([specs[0]] * 2, [[0], [1]]) == [[0], [1]]


def test_last_forest_is_dealt_to_stages():
    """Trees of the model fitted at last are grown in parts, which together are the whole forest; packed trees come back."""
    x, y, fold, key, edges = _one_hot_rows(300)
    d, spec = _rows(x, y, fold, key, edges), EN.Spec("forest", -1, (10,), (None,), min_split=5)
    parts = EN._ranges(spec, 4)
    assert [n for r in parts for n in r] == list(range(10)) and len(parts) == 4 and EN._ranges(EN.Spec("xgb", -1, (10,), (3,)), 4) == [None]
    (_, _, _, _, whole), = EN.forest([spec], d, EN.Together(None), edges)
    dealt = [t for r in parts for _, _, _, _, m in EN.forest([spec], d, EN.Together(None), edges, r) for t in EN._unpacked(EN._packed(m[1]))]
    assert [[v.tolist() for v in t] for t in dealt] == [[v.tolist() for v in t] for t in whole[1]] and EN._unpacked(EN._packed([])) == []
