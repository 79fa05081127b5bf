import os

from ferrule import workflow
from ferrule.ml import train as TR
from ferrule.sources.readings import machine_readings

SF = "/root/testdata/sf0.001"


def test_train_evaluate_predict(spark, tmp_path):
    opts = TR.TrainOptions(
        rf={"n_estimators": 10, "max_depth": 5, "min_samples_leaf": 1, "class_weight": "balanced"},
        enabled=("random_forest", "logistic_regression"),
    )
    readings = machine_readings(spark, SF)
    res = workflow.train_and_report(readings, str(tmp_path), opts)
    assert res.best_model in ("random_forest", "logistic_regression")
    assert os.path.isdir(tmp_path / "model")
    rep = spark.read.json(str(tmp_path / "evaluation_report")).first()
    assert rep["best_model"] in ("random_forest", "logistic_regression")
    model = TR.load(str(tmp_path / "model"))
    scored, summary = workflow.predict_batch(model, readings, str(tmp_path / "pred"))
    s = summary.first()
    assert s["total_machines"] == readings.count()
    assert scored.filter("machine_failure_pred = 1").count() == s["failure_count"]
    assert spark.read.option("header", True).csv(str(tmp_path / "pred" / "result_table")).count() == 1000
