"""H* operators: golden p-values, Yates, Welch, VIF vs OLS, PSI / KS direction tests, drift report."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from retainlens.config import DriftConfig
from retainlens.functions.pvalues import chi2_sf, ks_exact_p, t_two_sided_p
from retainlens.operators import drift as D
from retainlens.operators import stats as S


@pytest.mark.parametrize("x,dof,p", [
    (1184.5965720837926, 2, 5.863038300673391e-258),     # published chi² p-values (telco EDA)
    (927.329274556515, 4, 1.9959341029566983e-199),
    (648.1423274814, 3, 3.6823546520097993e-140),
    (3.841458820694124, 1, 0.05),
])
def test_chi2_sf_golden(x, dof, p):
    assert chi2_sf(x, dof) == pytest.approx(p, rel=1e-9)


def test_t_pvalue_known():
    assert t_two_sided_p(2.0, 10) == pytest.approx(0.0733880347707454, rel=1e-9)
    assert t_two_sided_p(0.0, 5) == pytest.approx(1.0)
    assert t_two_sided_p(1.96, 1e6) == pytest.approx(0.04999579, rel=1e-5)


def test_chi_square_yates_2x2(spark):
    rows = [("a", 1)] * 10 + [("a", 0)] * 20 + [("b", 1)] * 30 + [("b", 0)] * 40
    df = spark.createDataFrame(rows, "f string, Churn int")
    r = S.chi_square_tests(df, ["f"]).first()
    obs = np.array([[20, 10], [40, 30]], dtype=float)
    e = obs.sum(1)[:, None] * obs.sum(0)[None, :] / obs.sum()
    d = np.abs(obs - e) - np.minimum(0.5, np.abs(obs - e))
    assert r["dof"] == 1 and r["chi2"] == pytest.approx(float((d * d / e).sum()))
    assert r["p_value"] == pytest.approx(chi2_sf(r["chi2"], 1))


def test_chi_square_skips(spark):
    rows = [(str(i), "x", i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, const string, Churn int")
    assert S.chi_square_stats(df, ["id", "const"]).count() == 0   # >200 distinct; one row only


def test_welch_against_formula(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(1, 2, 200), rng.normal(0, 1, 300)
    df = spark.createDataFrame([(float(x), 1) for x in a] + [(float(x), 0) for x in b], "v double, Churn int")
    r = S.welch_tests(df, ["v"]).first()
    se = a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b)
    t = (a.mean() - b.mean()) / math.sqrt(se)
    dof = se ** 2 / ((a.var(ddof=1) / len(a)) ** 2 / (len(a) - 1) + (b.var(ddof=1) / len(b)) ** 2 / (len(b) - 1))
    assert r["t_stat"] == pytest.approx(t) and r["dof"] == pytest.approx(dof)
    assert r["p_value"] == pytest.approx(t_two_sided_p(t, dof))


def test_vif_matches_ols(spark):
    rng = np.random.default_rng(2)
    x1 = rng.normal(size=500)
    x2 = 0.8 * x1 + rng.normal(scale=0.5, size=500)
    x3 = rng.normal(size=500)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x1, x2, x3)], "x1 double, x2 double, x3 double")
    got = {r["feature"]: r["vif"] for r in S.vif(df, ["x1", "x2", "x3"]).collect()}
    X = np.column_stack([x1, x2, x3])
    for i, name in enumerate(["x1", "x2", "x3"]):
        others = np.column_stack([np.ones(500), np.delete(X, i, axis=1)])
        beta, *_ = np.linalg.lstsq(others, X[:, i], rcond=None)
        resid = X[:, i] - others @ beta
        r2 = 1 - resid.var() / X[:, i].var()
        assert got[name] == pytest.approx(1 / (1 - r2), rel=1e-8)


def _num(spark, ref, cur):
    return (spark.createDataFrame([(float(v),) for v in ref], "x double"),
            spark.createDataFrame([(float(v),) for v in cur], "x double"))


def test_numeric_psi_direction(spark):
    rng = np.random.default_rng(42)
    data = rng.normal(size=1000)
    same = D.psi_numeric(*_num(spark, data, data), ["x"]).first()["psi"]
    shifted = D.psi_numeric(*_num(spark, rng.normal(size=1000), rng.normal(size=1000) + 5), ["x"]).first()["psi"]
    assert same < 0.01 and shifted > 0.1


def test_numeric_psi_matches_numpy(spark):
    rng = np.random.default_rng(4)
    ref, cur = rng.normal(size=700), rng.normal(0.5, 1.2, 400)
    edges = np.linspace(min(ref.min(), cur.min()), max(ref.max(), cur.max()), 11)
    rh, _ = np.histogram(ref, bins=edges)
    ch, _ = np.histogram(cur, bins=edges)
    rp, cp = (rh + 1) / (rh.sum() + 10), (ch + 1) / (ch.sum() + 10)
    expected = round(float(np.sum((cp - rp) * np.log(cp / rp))), 6)
    assert D.psi_numeric(*_num(spark, ref, cur), ["x"]).first()["psi"] == pytest.approx(expected, abs=2e-6)


def test_categorical_psi(spark):
    def cat(vals):
        return spark.createDataFrame([(v,) for v in vals], "c string")
    drifted = D.psi_categorical(cat(["A"] * 80 + ["B"] * 10 + ["C"] * 10), cat(["A"] * 10 + ["B"] * 10 + ["C"] * 80), ["c"]).first()
    stable = D.psi_categorical(cat(["A"] * 50 + ["B"] * 30 + ["C"] * 20), cat(["A"] * 50 + ["B"] * 30 + ["C"] * 20), ["c"]).first()
    assert drifted["psi"] > 0.2 and drifted["drift_detected"]
    assert stable["psi"] < 0.05 and not stable["drift_detected"]
    new_cat = D.psi_categorical(cat(["A"] * 10), cat(["A"] * 5 + ["Z"] * 5), ["c"]).first()
    assert new_cat["psi"] > 0.2                   # unseen category counted with the 1e-6 floor


def test_ks_matches_numpy(spark):
    rng = np.random.default_rng(5)
    a, b = np.round(rng.normal(0, 1, 700), 2), np.round(rng.normal(0.3, 1, 500), 2)
    r = D.ks_test(*_num(spark, a, b), ["x"]).first()
    grid = np.union1d(a, b)
    fa = np.searchsorted(np.sort(a), grid, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), grid, side="right") / len(b)
    assert r["ks_statistic"] == pytest.approx(np.abs(fa - fb).max(), abs=1e-12)
    assert r["p_value"] < 0.05 and r["drift_detected"]
    assert r["cur_std"] == pytest.approx(b.std()) and r["ref_std"] == pytest.approx(a.std(ddof=1))


def test_drift_report_levels(spark):
    rng = np.random.default_rng(9)
    ref = spark.createDataFrame([(float(x), c) for x, c in zip(rng.normal(0, 1, 400), rng.choice(["a", "b"], 400))],
                                "x double, c string")
    stable = spark.createDataFrame([(float(x), c) for x, c in zip(rng.normal(0, 1, 200), rng.choice(["a", "b"], 200))],
                                   "x double, c string")
    drifted = spark.createDataFrame([(float(x), "b") for x in rng.normal(3, 1, 200)], "x double, c string")
    cfg = DriftConfig(numeric_features=("x",), categorical_features=("c",))
    s = D.drift_report(ref, stable, cfg).first()
    d = D.drift_report(ref, drifted, cfg).first()
    assert s["alert_level"] in ("none", "warning") and not s["drift_detected"]
    assert d["drift_detected"] and d["alert_level"] == "critical" and d["drift_ratio"] == 1.0
    small = D.drift_report(ref, drifted.limit(10), cfg).first()
    assert small["status"] == "insufficient_data" and not small["drift_detected"]


def test_exact_ks_p():
    # Published two-sample examples.
    for d, n, m, p in ((600 / 1100, 100, 110, 7.37417839555191e-15), (125 / 600, 200, 300, 5.129279597781977e-05), (62 / 600, 200, 300, 0.14691437867433876)):
        assert ks_exact_p(d, n, m) == pytest.approx(p, rel=1e-9)
    # All orders of few values.
    for n, m in ((1, 1), (3, 4), (5, 5), (2, 7)):
        stats = []
        for first in combinations(range(n + m), n):
            i = j = worst = 0
            for k in range(n + m):
                i, j = (i + 1, j) if k in first else (i, j + 1)
                worst = max(worst, abs(i * m - j * n))
            stats.append(worst)
        for far in set(stats):
            assert ks_exact_p(far / (n * m), n, m) == pytest.approx(sum(x >= far for x in stats) / len(stats))
    assert ks_exact_p(0.0, 5, 9) == 1.0


def _window(spark, rng, n, shift=0.0):
    rows = [(None if i % 50 == 0 else float(round(x, 2)), None if i % 40 == 0 else str(c)) for i, (x, c) in enumerate(zip(rng.normal(shift, 1, n), rng.choice(["a", "b", "c"], n)))]
    return spark.createDataFrame(rows, "x double, c string")


def test_stored_profile_equals_raw_reference(spark, tmp_path):
    rng = np.random.default_rng(11)
    ref, more, cur = _window(spark, rng, 300), _window(spark, rng, 200, .5), _window(spark, rng, 250, .4)
    cfg = DriftConfig(numeric_features=("x", "gone"), categorical_features=("c",))
    path = str(tmp_path / "ref")
    D.save_profile(D.profile(ref, cfg), path)
    D.save_profile(D.profile(more, cfg), path, increment=True)
    order = lambda f: sorted(f.collect())
    want = order(D.drift_features(ref.unionAll(more), cur, cfg))
    close = lambda a, b: all(x == pytest.approx(y) for r, s in zip(a, b) for x, y in zip(r, s)) and len(a) == len(b)
    assert close(order(D.features_from_profiles(D.load_profile(spark, path), D.profile(cur, cfg), cfg)), want) and len(want) == 2
    both = D.profile(ref, cfg).merge(D.profile(more, cfg))
    assert close(order(D.features_from_profiles(both, D.profile(cur, cfg), cfg)), want)
    assert D.drift_report_from_profile(D.load_profile(spark, path), cur, cfg).first() == D.drift_report(ref.unionAll(more), cur, cfg).first()
    x = [r.x for r in ref.unionAll(more).collect() if r.x is not None]
    ks = [r for r in want if r.kind == "ks"][0]
    assert ks.ref_mean == pytest.approx(np.mean(x)) and ks.ref_std == pytest.approx(np.std(x, ddof=1)) and ks.threshold == 0.05
    with pytest.raises(FileNotFoundError):
        D.load_profile(spark, str(tmp_path / "missing"))
    none = D.drift_report(ref.select("x"), cur.select("c"), cfg).first()
    assert none.total_features_checked == 0 and not none.drift_detected


def test_drift_by_equals_each_group_alone(spark):
    rng = np.random.default_rng(12)
    size = {"hot": 400, None: 30, **{f"g{i}": 3 + i for i in range(6)}}
    make = lambda shift: spark.createDataFrame([(g, float(round(v, 1))) for g, n in size.items() for v in rng.normal(shift, 1, n)], "g string, x double")
    ref, cur = make(0), make(.7).filter("g IS NULL OR g <> 'g5'")
    got = {r.g: r for r in D.ks_test(ref, cur, ["x"], by=["g"]).collect()}
    psi = {r.g: r.psi for r in D.psi_numeric(ref, cur, ["x"], by=["g"]).collect()}
    assert set(got) == set(size) == set(psi)
    for g in ("hot", None, "g0", "g4"):
        one = lambda d: d.filter(F.col("g").eqNullSafe(F.lit(g))).select("x")  # noqa: E731, B023
        alone = D.ks_test(one(ref), one(cur), ["x"]).first()
        assert [got[g][c] for c in alone.asDict()] == [pytest.approx(v) for v in alone]
        assert psi[g] == D.psi_numeric(one(ref), one(cur), ["x"]).first().psi
    assert got["g5"].p_value is None and got["g5"].n_cur == 0


def test_exact_p_of_groups_is_spread_over_tasks(spark):
    """Rows of few bytes and much work: adaptive execution must not gather them in one task."""
    rows = [(f"g{g}", float(i * (g + 1) % 17), int(i % 2)) for g in range(60) for i in range(20)]
    df = spark.createDataFrame(rows, "grp string, x double, side int")
    got = D.ks_test(df.filter("side = 0").drop("side"), df.filter("side = 1").drop("side"), ["x"], by=["grp"])
    at = got.select("grp", "p_value", F.spark_partition_id().alias("task")).collect()
    assert len(at) == 60 and len({r.task for r in at}) > 3
