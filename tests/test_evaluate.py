import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from ferrule.operators import evaluate as EV
from ferrule.sources import io


def literal_predictions(spark, rows):
    """(uid, y, pred, p) rows."""
    return spark.createDataFrame(rows, "uid long, y int, pred int, p double")


def _confusion_frame(spark):
    """Confusion [[11, 3], [9, 7]] of the committed report (rows true 0, 1)."""
    rows, uid = [], 0
    for y, pred, n in [(0, 0, 11), (0, 1, 3), (1, 0, 9), (1, 1, 7)]:
        for _ in range(n):
            uid += 1
            rows.append((uid, y, pred, float(pred)))
    return literal_predictions(spark, rows)


def test_classification_report_golden(spark):
    rep = {r["label"]: r for r in EV.classification_report(_confusion_frame(spark), labels=[0, 1]).collect()}
    assert rep["0"]["precision"] == pytest.approx(11 / 20, abs=1e-6)
    assert rep["0"]["recall"] == pytest.approx(11 / 14, abs=1e-6)
    assert rep["1"]["precision"] == pytest.approx(0.7, abs=1e-6)
    assert rep["1"]["recall"] == pytest.approx(7 / 16, abs=1e-6)
    assert rep["accuracy"]["f1"] == pytest.approx(0.6, abs=1e-6)
    assert rep["weighted avg"]["f1"] == pytest.approx(0.5891402714932127, abs=1e-6)
    assert round(rep["macro avg"]["precision"], 2) == 0.62
    assert round(rep["weighted avg"]["precision"], 2) == 0.63
    assert rep["0"]["support"] == 14 and rep["1"]["support"] == 16


def test_weighted_recall_equals_accuracy(spark):
    m = EV.summary_metrics(_confusion_frame(spark), labels=[0, 1]).first()
    assert m["recall_weighted"] == m["accuracy"] == 0.6


def test_error_analysis_golden(spark):
    errs = EV.error_frame(_confusion_frame(spark))
    rates = {(r["scope"], r["label"]): r["error_rate"] for r in EV.error_rates(errs).collect()}
    assert rates[("all", None)] == pytest.approx(0.4)
    assert rates[("class", 0)] == pytest.approx(3 / 14, abs=1e-6)
    assert rates[("class", 1)] == pytest.approx(9 / 16, abs=1e-6)
    top = [(r["true_label"], r["predicted_label"], r["count"]) for r in EV.top_misclassified(errs).collect()]
    assert top == [(1, 0, 9), (0, 1, 3)]
    cells = EV.confusion_cells(_confusion_frame(spark), labels=[0, 1])
    assert sum(r["count"] for r in cells.collect()) == 30
    rep = io.error_report(cells).first()
    assert rep["error_rate"] == pytest.approx(0.4)
    assert rep["error_rate_by_class"]["1"] == pytest.approx(9 / 16)
    assert [(x["true_label"], x["predicted_label"], x["count"]) for x in rep["top_misclassifications"]] == [
        (1, 0, 9), (0, 1, 3)]


def test_zero_division_and_missing_class(spark):
    df = literal_predictions(spark, [(1, 0, 0, 0.1), (2, 0, 0, 0.2), (3, 1, 0, 0.3)])
    rep = {r["label"]: r for r in EV.classification_report(df, labels=[0, 1]).collect()}
    assert rep["1"]["precision"] == 0.0 and rep["1"]["f1"] == 0.0


def _sk_like_roc(y, s):
    order = np.argsort(-s, kind="mergesort")
    y, s = y[order], s[order]
    idx = np.where(np.diff(s))[0]
    thr = np.r_[idx, len(y) - 1]
    tps = np.cumsum(y)[thr]
    fps = 1 + thr - tps
    keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
    fps, tps, t = fps[keep], tps[keep], s[thr][keep]
    return np.r_[np.inf, t], np.r_[0, fps] / fps[-1], np.r_[0, tps] / tps[-1]


def _sk_like_ap(y, s):
    order = np.argsort(-s, kind="mergesort")
    y, s = y[order], s[order]
    idx = np.where(np.diff(s))[0]
    thr = np.r_[idx, len(y) - 1]
    tps = np.cumsum(y)[thr]
    fps = 1 + thr - tps
    prec = tps / (tps + fps)
    rec = tps / tps[-1]
    return float(np.sum(np.diff(np.r_[0, rec]) * prec))


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_curves_match_reference_formulas(spark, ranges):
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        s = round(rnd.random(), 2)  # many ties
        y = 1 if rnd.random() < s else 0
        rows.append((i, y, int(s > 0.5), s))
    df = literal_predictions(spark, rows)
    y = np.array([r[1] for r in rows])
    s = np.array([r[3] for r in rows])
    t, fpr, tpr = _sk_like_roc(y, s)
    roc = sorted(((r["threshold"], r["fpr"], r["tpr"]) for r in EV.roc_curve(df, ranges=ranges).collect()),
                 reverse=True)
    assert len(roc) == len(t)
    for (a, b, c), (x, yv, z) in zip(roc, zip(t, fpr, tpr)):
        assert a == x and b == pytest.approx(yv) and c == pytest.approx(z)
    ap = EV.average_precision(df, ranges=ranges).first()["average_precision"]
    assert ap == pytest.approx(_sk_like_ap(y, s), abs=1e-6)
    auc = EV.roc_auc(df, ranges=ranges).first()["roc_auc"]
    spark_auc = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0).evaluate(
        df.withColumn("y", F.col("y").cast("double")))
    assert auc == pytest.approx(spark_auc, abs=1e-12)
    pr = EV.pr_curve(df, ranges=ranges).collect()
    assert len(pr) == len(set(s)) + 1


def test_histogram_bins(spark):
    df = spark.createDataFrame([(i, float(i), i % 2) for i in range(21)], "uid long, x double, is_error int")
    out = EV.error_dist_numeric(df, ["x"]).collect()
    per_bin = {}
    for r in out:
        per_bin[r["bin"]] = per_bin.get(r["bin"], 0) + r["n_rows"]
    assert per_bin[19] == 2  # max value falls into the closed last bin
    assert sum(per_bin.values()) == 21


def test_best_model_tie_first_wins(spark):
    m = spark.createDataFrame([("a", 0.5), ("b", 0.7), ("c", 0.7)], "model string, accuracy double")
    best = EV.best_model(m, {"a": 0, "b": 1, "c": 2}).filter("is_best_accuracy = 1").first()
    assert best["model"] == "b"


@pytest.mark.parametrize("ranges", [1, 8])
def test_metric_plans_have_no_cross_join_or_python(spark, ranges):
    rows = [(i, i % 2, i % 3 == 0, (i % 17) / 17.0) for i in range(200)]
    df = literal_predictions(spark, [(a, b, int(c), d) for a, b, c, d in rows]).repartition(4)
    for out in (EV.roc_auc(df, ranges=ranges), EV.roc_curve(df, ranges=ranges),
                EV.average_precision(df, ranges=ranges)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
        assert "EvalPython" not in plan


def test_more_than_two_classes(spark):
    rows = [(i, 0 if i < 30 else 1 if i < 50 else 2, i % 3, 0.5) for i in range(60)]
    df = spark.createDataFrame(rows, "uid long, y int, pred int, p double")
    assert EV.roc_auc(df).first()["roc_auc"] is None
    assert EV.roc_auc(df.filter("y < 2")).first()["roc_auc"] == 0.5
    assert EV.roc_auc(df.filter("y = 1")).first()["roc_auc"] is None
    whole = {r["label"]: r["support"] for r in EV.per_class(df, labels=[0, 1, 2, 7]).collect()}
    assert whole == {0: 30, 1: 20, 2: 10, 7: 0}
    shares = df.withColumn("probability", F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5)))
    out = EV.error_frame(shares, probability="probability", n_classes=3).first()
    assert (out["prob_class_0"], out["prob_class_1"], out["prob_class_2"]) == (0.2, 0.3, 0.5)
    with pytest.raises(ValueError):
        EV.error_frame(df, n_classes=3)
