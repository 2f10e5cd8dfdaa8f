"""E* operators: known small vectors and naive numpy re-computation."""

import numpy as np
import pytest

from retainlens.operators import evaluate as E


def _df(spark, y, p, s=None):
    s = [float(x) for x in p] if s is None else list(s)
    return spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(y, p, s)],
                                 "label int, prediction int, score double")


def test_confusion_known_vector(spark):
    cm = E.confusion(_df(spark, [0, 0, 1, 1], [0, 1, 1, 0])).first()
    assert (cm["tn"], cm["fp"], cm["fn"], cm["tp"]) == (1, 1, 1, 1)
    assert cm["tp_rate"] == 0.25 and cm["actual_positive"] == 2


def test_confusion_single_class_is_2x2(spark):
    cm = E.confusion(_df(spark, [0, 0, 0], [0, 0, 1])).first()
    assert (cm["tn"], cm["fp"], cm["fn"], cm["tp"]) == (2, 1, 0, 0)
    m = E.metrics_from_confusion(E.confusion(_df(spark, [0, 0, 0], [0, 0, 1]))).first()
    assert m["f1"] == 0.0 and m["precision"] == 0.0


def test_perfect_prediction(spark):
    m = E.metrics(_df(spark, [0, 1, 1, 0, 1], [0, 1, 1, 0, 1])).first()
    assert m["f1"] == 1.0 and m["accuracy"] == 1.0


def naive_auc(y, s):
    y, s = np.asarray(y), np.asarray(s)
    pos, neg = s[y == 1], s[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return gt / (len(pos) * len(neg))


def naive_ap(y, s):
    y, s = np.asarray(y), np.asarray(s)
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        sel = s >= t
        tp = (y[sel] == 1).sum()
        r, p = tp / (y == 1).sum(), tp / sel.sum()
        ap += (r - prev_r) * p
        prev_r = r
    return ap


def test_auc_ap_curve_fixture(spark):
    y, s = [0, 0, 1, 1, 0, 1], [.1, .2, .9, .4, .15, .85]
    df = _df(spark, y, [int(x >= .5) for x in s], s)
    assert E.roc_auc(df).first()[0] == pytest.approx(naive_auc(y, s))
    assert E.average_precision(df).first()[0] == pytest.approx(naive_ap(y, s))


def test_auc_ap_with_ties(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 3000)
    s = np.round(rng.random(3000) * 10) / 10 + 0.2 * y
    df = _df(spark, y, (s > 0.5).astype(int), s)
    assert E.roc_auc(df).first()[0] == pytest.approx(naive_auc(y, s), abs=1e-12)
    assert E.average_precision(df).first()[0] == pytest.approx(naive_ap(y, s), abs=1e-12)


def test_curves_endpoints(spark):
    y, s = [0, 0, 1, 1, 0, 1], [.1, .2, .9, .4, .15, .85]
    df = _df(spark, y, [0] * 6, s)
    roc = E.roc_curve(df).collect()
    assert any(r["threshold"] is None and r["fpr"] == 0 and r["tpr"] == 0 for r in roc)
    assert max(r["fpr"] for r in roc) == 1.0 and max(r["tpr"] for r in roc) == 1.0
    pr = E.pr_curve(df).collect()
    assert any(r["threshold"] is None and r["precision"] == 1.0 and r["recall"] == 0.0 for r in pr)


def test_class_report_rows(spark):
    rep = {r["class"]: r for r in E.class_report(_df(spark, [0, 0, 1, 1], [0, 1, 1, 1])).collect()}
    assert set(rep) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert rep["1"]["precision"] == pytest.approx(2 / 3, abs=1e-4) and rep["0"]["recall"] == 0.5
    assert rep["accuracy"]["f1"] == 0.75 and rep["weighted avg"]["support"] == 4
