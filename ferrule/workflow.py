"""The reference's three flows (train, evaluate, predict) composed from the
library's operators.  Each writes its results as tables under ``out_dir``
(a shared folder on a cluster); nothing is collected beyond one-row
statistics and per-model metric rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule import schema as S
from ferrule.functions import rules
from ferrule.ml import train as TR
from ferrule.operators import evaluate as EV
from ferrule.operators import prep
from ferrule.operators import scoring as SC
from ferrule.operators import summary as SU
from ferrule.sources import io


@dataclass
class TrainResult:
    models: dict[str, PipelineModel]
    metrics: DataFrame
    best_model: str
    not_run: list


def train_and_report(readings: DataFrame, out_dir: str, opts: TR.TrainOptions | None = None,
                     label_rules: bool = True) -> TrainResult:
    """Train flow: label (rules) -> split 70/15/15 -> fit every enabled model
    -> evaluate on the test part -> reports (metrics JSON, classification
    report, confusion/error report, ROC/PR curves, importances) -> save the
    best pipeline."""
    opts = opts or TR.TrainOptions()
    df = rules.label_failures(readings) if label_rules else readings
    df = prep.hash_split(df)
    train = df.filter(F.col("split") == "train")
    test = df.filter(F.col("split") == "test")
    trained = TR.train_all(train, test, opts)
    models, ranked = trained.models, trained.metrics
    best = ranked.filter(F.col(f"is_best_{opts.select_metric}") == 1).first()["model"]
    io.write_table(io.evaluation_report(ranked, opts.select_metric), f"{out_dir}/evaluation_report", "json")
    for name, model in models.items():
        evaluate_model(model, test, f"{out_dir}/{name}", opts.label)
    TR.save(models[best], f"{out_dir}/model")
    return TrainResult(models, ranked, best, trained.not_run)


def evaluate_model(model: PipelineModel, data: DataFrame, out_dir: str, label: str = "machine_failure") -> None:
    """Evaluate flow: transform once, persist the narrow prediction frame,
    derive every report from it."""
    preds = TR.predictions(model, data, label, probabilities=True).persist()
    try:
        io.write_table(EV.classification_report(preds), f"{out_dir}/classification_report", "csv")
        cells = EV.confusion_cells(preds)
        io.write_table(io.error_report(cells), f"{out_dir}/error_report", "json")
        top_class = cells.agg(F.max("true_label")).first()[0] or 0
        if top_class < 2:  # curves are of class 1 against class 0
            io.write_table(EV.roc_curve(preds), f"{out_dir}/roc_curve")
            io.write_table(EV.pr_curve(preds), f"{out_dir}/pr_curve")
        clf = model.stages[-1]
        if hasattr(clf, "featureImportances") or hasattr(clf, "coefficients"):
            imp = TR.importance_table(data.sparkSession, model, data)
            io.write_table(imp, f"{out_dir}/importance", "csv")
    finally:
        preds.unpersist()


def predict_batch(model: PipelineModel, readings: DataFrame, out_dir: str | None = None,
                  threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Predict flow: model probability -> attribution and recommendation ->
    (scored rows, one-row summary); optionally written as tables."""
    scored = SC.model_probability(model.transform(readings), "p")
    keep = [c for c in readings.columns] + ["p"]
    out = SC.score(scored.select(*keep), "p", threshold, S.TS if S.TS in readings.columns else None)
    summary = SU.batch_summary(out)
    if out_dir:
        io.write_table(io.prediction_sink(out.withColumn("pred", F.col("machine_failure_pred")), S.UID,
                                          "machine_failure"), f"{out_dir}/predictions")
        io.write_table(SU.result_table(out), f"{out_dir}/result_table", "csv")
        io.write_table(summary, f"{out_dir}/summary", "json")
    return out, summary
