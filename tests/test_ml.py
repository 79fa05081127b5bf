import pytest
from pyspark.sql import functions as F

from ferrule import schema as S
from ferrule.functions import rules
from ferrule.ml import train as TR
from ferrule.operators import evaluate as EV
from ferrule.operators import prep
from ferrule.sources.readings import machine_readings

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split(spark):
    df = prep.hash_split(rules.label_failures(machine_readings(spark, SF)), (0.8, 0.2), ("train", "test"))
    return df.filter("split = 'train'").cache(), df.filter("split = 'test'").cache()


def test_forest_beats_majority_and_round_trips(spark, split, tmp_path):
    train, test = split
    opts = TR.TrainOptions(rf={"n_estimators": 20, "max_depth": 8, "min_samples_leaf": 1,
                               "class_weight": "balanced"})
    model = TR.fit("random_forest", train, opts)
    preds = TR.predictions(model, test, "machine_failure")
    acc = EV.summary_metrics(preds, labels=[0, 1]).first()["accuracy"]
    majority = max(test.agg(F.avg("machine_failure")).first()[0], 1 - test.agg(F.avg("machine_failure")).first()[0])
    assert acc > majority
    TR.save(model, str(tmp_path / "rf"))
    again = TR.predictions(TR.load(str(tmp_path / "rf")), test, "machine_failure")
    assert sorted(map(tuple, preds.collect())) == sorted(map(tuple, again.collect()))
    imp = TR.importance_table(spark, model, train).collect()
    assert len(imp) == len(S.MACHINE_TYPES) + len(TR.feature_columns(opts))
    assert imp[0]["importance"] >= imp[-1]["importance"]


def test_load_missing_fails(tmp_path):
    with pytest.raises(Exception):
        TR.load(str(tmp_path / "absent"))


def test_logistic_coefficients(spark, split):
    train, _ = split
    model = TR.fit("logistic_regression", train)
    rows = TR.importance_table(spark, model, train).collect()
    assert rows[0]["importance"] == max(abs(r["value"]) for r in rows)


def test_candidate_maps():
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier

    lr = LogisticRegression()
    assert len(TR.candidate_maps("logistic_regression", lr, 100.0, "random", 20)) == 6
    rf = RandomForestClassifier()
    maps = TR.candidate_maps("random_forest", rf, 1.0, "random", 20, 42)
    assert 0 < len(maps) <= 20
    assert maps == TR.candidate_maps("random_forest", rf, 1.0, "random", 20, 42)


def test_rbf_not_built(spark, split):
    train, _ = split
    opts = TR.TrainOptions(svm={"C": 1.0, "kernel": "rbf", "class_weight": "balanced"})
    with pytest.raises(ValueError):
        TR.fit("svm", train, opts)


def test_class_probabilities_and_selection(spark, split):
    from pyspark.ml import Pipeline

    from ferrule.ml import select as SEL

    train, test = split
    model = TR.fit("logistic_regression", train)
    out = TR.class_probabilities(model.transform(test), 2)
    r = out.select((F.col("prob_class_0") + F.col("prob_class_1")).alias("s")).first()
    assert r["s"] == pytest.approx(1.0)
    prepared = Pipeline(stages=TR.base_stages(TR.TrainOptions())).fit(train).transform(train)
    top = SEL.univariate(prepared, "machine_failure", 5, "f_test")
    assert len(top) == 5 and len(set(top)) == 5
    kept = SEL.recursive_elimination(prepared, "machine_failure", n=15, step=2)
    assert len(kept) == 15


def test_train_all_with_search(spark, split):
    train, test = split
    opts = TR.TrainOptions(enabled=("logistic_regression",), tune=True, tune_method="random", n_iter=2, cv=2)
    trained = TR.train_all(train, test, opts)
    assert set(trained.models) == {"logistic_regression"}
    assert trained.metrics.count() == 1


def test_left_out_candidates_and_models_are_named(spark, split):
    train, test = split
    settings, not_run = TR.candidates("svm", 100.0, "grid")
    assert len(settings) == 3 and len(settings) + len(not_run) == 36 and all(x["reason"] for x in not_run)
    opts = TR.TrainOptions(enabled=("svm", "logistic_regression"), svm={"C": 1.0, "kernel": "rbf", "class_weight": "balanced"})
    trained = TR.train_all(train, test, opts)
    assert list(trained.models) == ["logistic_regression"] and [x["model"] for x in trained.not_run] == ["svm"]


def test_depth_beyond_spark_is_refused():
    with pytest.raises(ValueError):
        TR.make_classifier("random_forest", TR.TrainOptions(rf={"n_estimators": 1, "max_depth": 31}))


@pytest.mark.parametrize("more", [
    {"polynomial": True, "powers": True, "domain": False}, {"scaling": "none", "encoding": "label"},
    {"scaling": "minmax", "encoding": "target"}, {"scaling": "robust", "handle_missing": "median", "interactions": False},
])
def test_names_follow_the_options(spark, split, more):
    from pyspark.ml import Pipeline

    train, _ = split
    opts = TR.TrainOptions(**more)
    holes = train.withColumn("rpm", F.when(F.col("uid") % 7 > 0, F.col("rpm"))) if "handle_missing" in more else train
    rows = Pipeline(stages=TR.base_stages(opts)).fit(holes).transform(holes)
    names = [n.removesuffix("_scaled") for n in TR.slot_names(rows)]
    assert names[-len(TR.feature_columns(opts)):] == TR.feature_columns(opts)
    assert len(rows.first()["features"]) == len(names) and not {"twf", "machine_failure"} & set(names)


def test_selection_and_three_classes(spark, split):
    train, test = split
    bin3 = F.when(F.col("rpm") < 1450, 0).when(F.col("rpm") < 1600, 1).otherwise(2)
    opts = TR.TrainOptions(label="speed", enabled=("logistic_regression", "neural_network"), select_features=4)
    trained = TR.train_all(train.withColumn("speed", bin3), test.withColumn("speed", bin3), opts)
    rows = {r["model"]: r for r in trained.metrics.collect()}
    assert rows["logistic_regression"]["n_rows"] == test.count() and rows["logistic_regression"]["accuracy"] > 0.8
    scored = TR.predictions(trained.models["neural_network"], test.withColumn("speed", bin3), "speed", probabilities=True)
    assert scored.filter(F.size("probability") != 3).count() == 0


def test_tasks_follow_the_rows(split, monkeypatch):
    assert [TR.fit_tasks(n, 12) for n in (0, 19_999, 80_000, 4_800_000, 28_800_000)] == [1, 1, 8, 48, 240]
    assert TR.fit_tasks(500, 8, 8) == 8 and TR.fit_tasks(28_800_000, 12, 12) == 240
    train, _ = split
    n = train.count()
    for few, many in ((n // 4, n), (n, n // 40)):
        monkeypatch.setattr(TR, "FEW_ROWS", few)
        monkeypatch.setattr(TR, "MANY_ROWS", many)
        data = TR.prepare(train.coalesce(1), TR.TrainOptions())
        try:
            sizes = data.rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
        finally:
            data.release()
        assert sum(sizes) == n and len(sizes) >= 4 and max(sizes) <= max(few, many) + len(sizes)
