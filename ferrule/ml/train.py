"""Training, tuning and model choice (M1-M20, S9-S11) with Spark ML.

Every model is one ``Pipeline``: feature engineering -> one-hot type ->
population scaling -> assembler -> classifier, so the saved ``PipelineModel``
scores raw sensor rows directly.  Training is distributed by Spark ML; the
driver only sees parameters, metrics and per-feature vectors.
"""

from __future__ import annotations

import itertools
import random
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, PolynomialExpansion, UnivariateFeatureSelector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule import schema as S
from ferrule.ml import batched, boost, net
from ferrule.ml.stages import FeatureEngineer, preparation_stages
from ferrule.operators import evaluate as EV
from ferrule.operators import prep
from ferrule.session import ensure_checkpoint_dir

SPARK_MAX_DEPTH = 30
# Rows of one task in the fits' jobs: cores are used from FEW_ROWS each on; more
# than MANY_ROWS make more tasks, so that what one reads (a forest of 100 trees
# keeps about 1.6 KB a row) doesn't grow with the table
FEW_ROWS, MANY_ROWS = 10_000, 125_000


@dataclass
class TrainOptions:
    """Typed settings (one place instead of a nested YAML; defaults are the
    reference's configuration values)."""

    label: str = "machine_failure"
    seed: int = 42
    domain: bool = True
    interactions: bool = True
    polynomial: bool = False
    powers: bool = False
    rf: dict = field(default_factory=lambda: {"n_estimators": 100, "max_depth": 10, "min_samples_leaf": 1,
                                              "class_weight": "balanced"})
    gbt: dict = field(default_factory=lambda: {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 5,
                                               "subsample": 0.8, "colsample_bytree": 0.8, "scale_pos_weight": 3.0})
    lr: dict = field(default_factory=lambda: {"C": 1.0, "penalty": "l2", "class_weight": "balanced"})
    svm: dict = field(default_factory=lambda: {"C": 1.0, "kernel": "linear", "class_weight": "balanced"})
    mlp: dict = field(default_factory=lambda: {"architecture": [64, 32, 16], "epochs": 50, "batch_size": 32})
    enabled: tuple = ("random_forest", "xgboost", "logistic_regression", "neural_network")
    tune: bool = False  # the reference's configuration enables it; off by default here (cost)
    tune_method: str = "random"
    n_iter: int = 20
    cv: int = 3
    select_metric: str = "f1_weighted"
    # preparation: scaling none / standard / minmax / robust; missing none /
    # mean / median / mode; encoding onehot / label / target; the number of
    # features that an F test keeps (None: all)
    scaling: str = "standard"
    handle_missing: str = "none"
    encoding: str = "onehot"
    select_features: int | None = None
    # least partitions of the prepared rows.  Iterative fits run one job per step
    # over them; None: as the input has them, or by ``fit_tasks`` where there
    # are rows enough
    num_partitions: int | None = None


def feature_columns(opts: TrainOptions) -> list[str]:
    """Allow-list of numeric model inputs (labels and flags never leak in)."""
    return [*S.SENSORS, *_engineer(opts).output_names(list(S.SENSORS))]


def _engineer(opts: TrainOptions) -> FeatureEngineer:
    return FeatureEngineer(domain=opts.domain, interactions=opts.interactions,
                           polynomial=opts.polynomial, powers=opts.powers)


def base_stages(opts: TrainOptions) -> list:
    """The preparation that the options choose, up to the column ``features``."""
    stages: list = []
    if opts.handle_missing != "none":
        stages.append(Imputer(inputCols=list(S.SENSORS), outputCols=list(S.SENSORS), strategy=opts.handle_missing))
    out = "features_all" if opts.select_features else "features"
    stages += [_engineer(opts), *preparation_stages(
        feature_columns(opts), features_col=out, scaling=opts.scaling, encoding=opts.encoding, label=opts.label)]
    if opts.select_features:
        chooser = UnivariateFeatureSelector(
            featuresCol=out, outputCol="features", labelCol=opts.label, selectionMode="numTopFeatures")
        stages.append(chooser.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(opts.select_features))
    return stages


def with_weights(df: DataFrame, opts: TrainOptions) -> DataFrame:
    """M1/M2 weight columns (literal map from k class counts; no join)."""
    return _weighted(df, opts, prep.class_counts(df, opts.label))


def _weighted(df: DataFrame, opts: TrainOptions, counts: dict) -> DataFrame:
    n, k = sum(counts.values()), len(counts)
    if not k:
        raise ValueError("no row has a label")
    w = F.create_map(*[x for c, cnt in counts.items() for x in (F.lit(c), F.lit(n / (k * cnt)))])
    return df.select(
        "*",
        w[F.col(opts.label)].alias("w_balanced"),
        prep.positive_weight(opts.label, opts.gbt.get("scale_pos_weight", 1.0)).alias("w_positive"),
    )


@dataclass
class Prepared:
    """The preparation, fitted once, and the training rows it gave (persisted)."""

    stages: PipelineModel
    rows: DataFrame
    n_rows: int
    n_classes: int

    @property
    def width(self) -> int:
        return len(self.rows.first()["features"])

    def release(self) -> None:
        self.rows.unpersist()


def fit_tasks(n_rows: int, cores: int, least: int | None = None) -> int:
    """Partitions of ``n_rows`` prepared rows: ``least`` or one per FEW_ROWS up to
    the cores, and whole rounds of the cores beyond MANY_ROWS rows each."""
    tasks = max(least or 1, min(cores, n_rows // FEW_ROWS))
    most = -(-n_rows // MANY_ROWS)
    return tasks if tasks >= most else -(-most // cores) * cores


def prepare(train: DataFrame, opts: TrainOptions, stages: list | None = None, folds: bool = False) -> Prepared:
    """Fits the preparation stages (default: those of the options) and persists
    label, weights, features and, with ``folds``, the stratified fold: shared
    by every model, search candidate and fold that follows."""
    # tree ensembles checkpoint node ids / predictions into the shared folder
    ensure_checkpoint_dir(train.sparkSession)
    train = train.filter(F.col(opts.label).isNotNull())
    counts = prep.class_counts(train, opts.label)
    if folds:
        train = prep.stratified_folds(train, opts.label, opts.cv, seed=opts.seed)
    weighted = _weighted(train, opts, counts)
    model = Pipeline(stages=stages or base_stages(opts)).fit(weighted)
    rows = model.transform(weighted).select(opts.label, "w_balanced", "w_positive", *(["fold"] if folds else []), "features")
    tasks = fit_tasks(sum(counts.values()), train.sparkSession.sparkContext.defaultParallelism, opts.num_partitions)
    if opts.num_partitions or tasks > 1:
        rows = rows.repartition(tasks)
    top = int(max(counts)) + 1  # Spark's classes are 0 .. k-1
    return Prepared(model, rows.persist(), sum(counts.values()), max(2, top))


def _depth(d) -> int:
    """Spark's trees go to depth 30; None (no limit) means that, more is refused."""
    if d is None:
        return SPARK_MAX_DEPTH
    if int(d) > SPARK_MAX_DEPTH:
        raise ValueError(f"depth {d}: Spark's trees stop at {SPARK_MAX_DEPTH}")
    return int(d)


def make_classifier(name: str, opts: TrainOptions, n_rows_weight: float | None = None,
                    n_features: int | None = None, n_classes: int = 2):
    """Registry of estimators with the reference's settings mapped to Spark."""
    label = opts.label
    if name == "random_forest":
        c = opts.rf
        return RandomForestClassifier(
            labelCol=label, featuresCol="features", numTrees=int(c["n_estimators"]),
            maxDepth=_depth(c.get("max_depth")), minInstancesPerNode=int(c.get("min_samples_leaf", 1)),
            featureSubsetStrategy="sqrt", seed=opts.seed,
            weightCol="w_balanced" if c.get("class_weight") == "balanced" else None,
            # performance knobs only: node statistics per pass, cached node ids
            maxMemoryInMB=1024, cacheNodeIds=True,
        )
    if name == "xgboost":
        c = opts.gbt
        if n_classes > 2:
            raise ValueError("boosted trees are built for two classes")
        return boost.BoostedTrees(label, boost.Settings(**{**c, "seed": opts.seed}))
    if name in ("logistic_regression", "svm"):
        c = opts.lr if name == "logistic_regression" else opts.svm
        sum_w = n_rows_weight or 1.0
        reg = 1.0 / (float(c["C"]) * sum_w)
        weight = "w_balanced" if c.get("class_weight") == "balanced" else None
        if name == "logistic_regression":
            return LogisticRegression(
                labelCol=label, featuresCol="features", regParam=reg,
                elasticNetParam=1.0 if c.get("penalty") == "l1" else 0.0,
                standardization=False, weightCol=weight, maxIter=100, tol=1e-4,
            )
        return LinearSVC(labelCol=label, featuresCol="features", regParam=reg,
                         standardization=False, weightCol=weight, maxIter=100, tol=1e-4)
    if name == "neural_network":
        c = opts.mlp
        if n_features is None:
            raise ValueError("neural_network needs the input width")
        return net.NeuralNet(label, [n_features, *c["architecture"], max(n_classes, 2)], int(c["epochs"]), opts.seed)
    raise ValueError(f"unknown model {name}")


def classifier_stages(name: str, opts: TrainOptions, data: Prepared) -> list:
    """The estimator, after what it needs of its own (poly kernel)."""
    stages: list = []
    if name == "svm" and opts.svm.get("kernel") == "poly":
        stages.append(PolynomialExpansion(inputCol="features", outputCol="features_poly", degree=3))
    elif name == "svm" and opts.svm.get("kernel") == "rbf":
        raise ValueError("rbf kernel needs a single-machine solver; not built")
    # balanced weights sum to the number of rows
    clf = make_classifier(name, opts, float(data.n_rows), data.width if name == "neural_network" else None, data.n_classes)
    return [*stages, clf.setFeaturesCol("features_poly") if stages else clf]


def fit_prepared(name: str, data: Prepared, opts: TrainOptions) -> PipelineModel:
    """The classifier fitted on prepared rows, as a whole pipeline."""
    model = Pipeline(stages=classifier_stages(name, opts, data)).fit(data.rows)
    return PipelineModel(stages=[*data.stages.stages, *model.stages])


def fit(name: str, train: DataFrame, opts: TrainOptions | None = None, stages: list | None = None) -> PipelineModel:
    """Fit the preparation stages once, hand the prepared (label, weights,
    features) rows to the classifier, and return the whole pipeline as one
    PipelineModel.  ``stages``: another preparation, ending in ``features``."""
    opts = opts or TrainOptions()
    data = prepare(train, opts, stages)
    try:
        return fit_prepared(name, data, opts)
    finally:
        data.release()


def _scored(out: DataFrame, label: str, key: str = S.UID, probabilities: bool = False) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    if "probability" in out.columns:
        arr = vector_to_array("probability")
        # two classes: that of class 1; more: that of the predicted class
        p = F.when(F.size(arr) == 2, arr[1]).otherwise(F.array_max(arr))
    else:
        arr, p = F.lit(None).cast("array<double>"), F.lit(None).cast("double")
    return out.select(
        key, F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"),
        F.coalesce(p, F.col("prediction").cast("double")).alias("p"), *([arr.alias("probability")] if probabilities else []),
    )


def predictions(model: PipelineModel, df: DataFrame, label: str, key: str = S.UID, probabilities: bool = False) -> DataFrame:
    """(uid, y, pred, p) from a fitted pipeline; p = P(class 1) for two
    classes, P(predicted class) for more, or the hard label for models without
    probabilities (A2).  ``probabilities`` adds one array of all classes'."""
    return _scored(model.transform(df), label, key, probabilities)


def class_probabilities(scored: DataFrame, n_classes: int, prob_col: str = "probability",
                        prefix: str = "prob_class_") -> DataFrame:
    """The probability vector as one column per class."""
    from pyspark.ml.functions import vector_to_array

    arr = vector_to_array(prob_col)
    return scored.select("*", *[arr[i].alias(f"{prefix}{i}") for i in range(n_classes)])


def slot_names(df: DataFrame, col: str = "features") -> list[str]:
    """Names of the vector slots from the assembler's ML attribute metadata."""
    meta = df.schema[col].metadata.get("ml_attr", {})
    attrs = []
    for group in meta.get("attrs", {}).values():
        attrs.extend(group)
    names = [None] * meta.get("num_attrs", len(attrs))
    for a in attrs:
        names[a["idx"]] = a.get("name", f"f{a['idx']}")
    return [n or f"f{i}" for i, n in enumerate(names)]


def importance_table(spark: SparkSession, model: PipelineModel, sample: DataFrame) -> DataFrame:
    """M18 (trees: featureImportances) / M19 (linear: |coefficients|),
    (feature, importance) sorted descending.  Size = number of features."""
    clf = model.stages[-1]
    names = slot_names(model.transform(sample.limit(1)))
    if hasattr(clf, "featureImportances"):
        vals = clf.featureImportances.toArray().tolist()
        rows = [(n, float(v), float(v)) for n, v in zip(names, vals)]
    elif hasattr(clf, "coefficients"):
        vals = clf.coefficients.toArray().tolist()
        rows = [(n, float(v), abs(float(v))) for n, v in zip(names, vals)]
    else:
        raise ValueError("model has neither importances nor coefficients")
    df = spark.createDataFrame(rows, "feature string, value double, importance double")
    return df.orderBy(F.desc("importance"), F.asc("feature"))


# The reference's search grids (sklearn names), mapped below.
SEARCH_GRIDS = {
    "random_forest": {"n_estimators": [50, 100, 200], "max_depth": [None, 10, 20, 30],
                      "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4]},
    "xgboost": {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 5, 7],
                "subsample": [0.6, 0.8, 1.0], "colsample_bytree": [0.6, 0.8, 1.0],
                "scale_pos_weight": [1.0, 3.0, 5.0]},
    "logistic_regression": {"C": [0.1, 1.0, 10.0], "penalty": ["l1", "l2"], "solver": ["liblinear", "saga"]},
    "svm": {"C": [0.1, 1.0, 10.0], "kernel": ["linear", "rbf", "poly"], "gamma": ["scale", "auto", 0.1, 1.0]},
}


def _spark_settings(name: str, combo: dict, sum_w: float) -> dict:
    """Map one sklearn-style combination to Spark params (None when the
    combination has no Spark meaning; solver and min_samples_split drop out).
    Boosted trees take every setting of their grid as it is."""
    if name == "random_forest":
        return {"numTrees": combo["n_estimators"], "maxDepth": _depth(combo["max_depth"]),
                "minInstancesPerNode": combo["min_samples_leaf"]}
    if name == "xgboost":
        return dict(combo)
    if name == "logistic_regression":
        return {"regParam": 1.0 / (combo["C"] * sum_w), "elasticNetParam": 1.0 if combo["penalty"] == "l1" else 0.0}
    if name == "svm":
        if combo["kernel"] != "linear":
            return None
        return {"regParam": 1.0 / (combo["C"] * sum_w)}
    raise ValueError(name)


def candidates(name: str, sum_w: float, method: str = "random", n_iter: int = 20, seed: int = 42) -> tuple[list[dict], list[dict]]:
    """(Spark settings, combinations not run and why): all
    combinations (grid) or a seeded sample of n_iter of them (the whole grid
    when smaller); duplicates after mapping are run once."""
    grid = SEARCH_GRIDS[name]
    keys = list(grid)
    combos = [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]
    if method == "random" and len(combos) > n_iter:
        combos = random.Random(seed).sample(combos, n_iter)
    elif method not in ("random", "grid"):
        raise ValueError("method must be grid or random")
    settings, seen, not_run = [], set(), []
    for combo in combos:
        st = _spark_settings(name, combo, sum_w)
        if st is None:
            not_run.append({"model": name, "settings": combo, "reason": f"kernel {combo['kernel']} is not searched: only the linear one is a Spark solver"})
            continue
        frozen = tuple(sorted(st.items()))
        if frozen in seen:
            not_run.append({"model": name, "settings": combo, "reason": "the same Spark settings as an earlier candidate"})
            continue
        seen.add(frozen)
        settings.append(st)
    return settings, not_run


def candidate_maps(name: str, clf, sum_w: float, method: str = "random", n_iter: int = 20, seed: int = 42):
    """The candidates as param maps of ``clf``."""
    return [{getattr(clf, k): v for k, v in st.items()} for st in candidates(name, sum_w, method, n_iter, seed)[0]]


@dataclass
class Search:
    model: PipelineModel
    best: dict
    scored: list  # (settings, mean F1 of class 1 over the folds)
    not_run: list  # {model, settings, reason}


def _search(name: str, data: Prepared, opts: TrainOptions, parallelism: int) -> Search:
    """Logistic regression and boosted trees: all candidates and folds share
    their scans.  The others: one fit each, ``parallelism`` at a time."""
    total = float(data.n_rows)
    settings, not_run = candidates(name, total, opts.tune_method, opts.n_iter, opts.seed)
    clf = make_classifier(name, opts, total, data.width, data.n_classes)
    if name == "xgboost":
        tried = [boost.Settings(**st, seed=opts.seed) for st in settings]
        f1 = boost.cross_validated(data.rows, opts.label, tried, opts.cv)
    elif name == "logistic_regression" and data.n_classes == 2 and data.width <= batched.MAX_WIDTH:
        weight = "w_balanced" if opts.lr.get("class_weight") == "balanced" else None
        problems = [batched.Problem(st["regParam"], st["elasticNetParam"], k) for st in settings for k in range(opts.cv)]
        table = batched.blocks(data.rows, opts.label, weight, "fold")
        parts = batched.fold_f1(table, problems, batched.fit_many(table, problems, data.width))
        f1 = [sum(parts[i * opts.cv : (i + 1) * opts.cv]) / opts.cv for i in range(len(settings))]
    else:
        maps = [{getattr(clf, k): v for k, v in st.items()} for st in settings] or ParamGridBuilder().build()
        evaluator = MulticlassClassificationEvaluator(labelCol=opts.label, metricName="fMeasureByLabel", metricLabel=1.0)
        cv = CrossValidator(estimator=clf, estimatorParamMaps=maps, evaluator=evaluator,
                            numFolds=opts.cv, foldCol="fold", parallelism=parallelism, seed=opts.seed)
        cv_model = cv.fit(data.rows)
        best_i = max(range(len(maps)), key=lambda i: (cv_model.avgMetrics[i], -i))
        best = settings[best_i] if settings else {}
        return Search(PipelineModel(stages=[*data.stages.stages, cv_model.bestModel]), best,
                      list(zip(settings or [{}], cv_model.avgMetrics)), not_run)
    best_i = max(range(len(settings)), key=lambda i: (f1[i], -i))  # M15: the first of the best
    best = settings[best_i]
    if name == "xgboost":
        clf = boost.BoostedTrees(opts.label, tried[best_i])
        model = clf.fit(data.rows)
    else:
        model = clf.fit(data.rows, {getattr(clf, k): v for k, v in best.items()})
    return Search(PipelineModel(stages=[*data.stages.stages, model]), best, list(zip(settings, f1)), not_run)


def tune(name: str, train: DataFrame, opts: TrainOptions | None = None, parallelism: int = 8) -> Search:
    """Cross-validated search; folds are stratified by label
    (M14, ``foldCol``); score = F1 of class 1.

    The preparation stages are fitted once on the training data and the
    prepared (label, weights, fold, features) rows are persisted, so the
    candidates x folds fits only re-run the classifier (the reference's search
    pipelines likewise hold no fitted scaler)."""
    opts = opts or TrainOptions()
    data = prepare(train, opts, folds=True)
    try:
        return _search(name, data, opts, parallelism)
    finally:
        data.release()


@dataclass
class Trained:
    models: dict  # name -> PipelineModel
    metrics: DataFrame  # one row per model
    not_run: list  # {model, settings, reason}: models and candidates left out


def train_all(train: DataFrame, test: DataFrame, opts: TrainOptions | None = None, parallelism: int = 8) -> Trained:
    """Fit every enabled model in order, evaluate on ``test``,
    choose the best by ``opts.select_metric`` (strictly greater wins, so the
    earlier model keeps a tie).  One preparation serves all models, and the
    test part is prepared and scored once."""
    opts = opts or TrainOptions()
    models, frames, not_run = {}, [], []
    data = prepare(train, opts, folds=opts.tune)
    ready = data.stages.transform(test).select(S.UID, opts.label, "features").persist()
    try:
        for name in opts.enabled:
            if name == "svm" and opts.svm.get("kernel") == "rbf":
                not_run.append({"model": name, "settings": dict(opts.svm), "reason": "rbf kernel needs a single-machine solver; not built"})
                continue
            if name == "xgboost" and data.n_classes > 2:
                not_run.append({"model": name, "settings": dict(opts.gbt), "reason": "boosted trees are built for two classes"})
                continue
            if opts.tune and name in SEARCH_GRIDS:
                # Search first, then keep the refitted best pipeline
                found = _search(name, data, opts, parallelism)
                models[name] = found.model
                not_run += found.not_run
            else:
                models[name] = fit_prepared(name, data, opts)
            own = PipelineModel(stages=models[name].stages[len(data.stages.stages):])
            frames.append(_scored(own.transform(ready), opts.label).withColumn("model", F.lit(name)))
        if not frames:
            raise ValueError("no enabled model can be built")
        allp = frames[0]
        for f in frames[1:]:
            allp = allp.unionByName(f)
        allp = allp.persist()  # narrow; read for the counts and for the AUC
        try:
            order = {n: i for i, n in enumerate(opts.enabled)}
            ranked = EV.best_model(EV.model_metrics(allp), order, opts.select_metric)
            rows = ranked.collect()  # one row per model
        finally:
            allp.unpersist()
    finally:
        data.release()
        ready.unpersist()
    return Trained(models, train.sparkSession.createDataFrame(rows, ranked.schema), not_run)


def save(model: PipelineModel, path: str) -> None:
    """The whole fitted pipeline (features, encoder, scaler, model)."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    """Error when absent (no fallback to any other file)."""
    return PipelineModel.load(path)
