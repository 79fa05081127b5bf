"""Registered queries: training (M3-M7, M12-M20).  Fitted numbers are not SQL:
those queries have no oracle, and the pytest suite checks their invariants
(better than the majority rate, save/load equality).  What is exact about them
has queries of its own with oracles: the scored rows and the form of their
scores, the names of the features in order, the candidates, the models."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule import schema as S
from ferrule.functions import rules
from ferrule.ml import boost as BO
from ferrule.ml import train as TR
from ferrule.operators import evaluate as EV
from ferrule.operators import prep
from ferrule.plans.sqltext import with_base
from ferrule.sources import io
from ferrule.sources.readings import machine_readings, read_table


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """80/20 hash split of the rule-labelled readings."""
    df = prep.hash_split(rules.label_failures(machine_readings(spark, sf_dir)), (0.8, 0.2), ("train", "test"))
    return df.filter(F.col("split") == "train"), df.filter(F.col("split") == "test")


def _options(spark: SparkSession, trees: bool = False, **more) -> TR.TrainOptions:
    """The driver's tables are single files.  Trees do heavy work per pass, so
    their rows are spread over the cores whatever their number; the other fits run
    one light job per step and spread them where there are enough."""
    return TR.TrainOptions(num_partitions=spark.sparkContext.defaultParallelism if trees else None, **more)


def rf_test_accuracy(spark, sf_dir):
    """M3 + M20: the demo flow - fit the forest on the training part, score
    the test part, accuracy and weighted metrics."""
    train, test = _split(spark, sf_dir)
    model = TR.fit("random_forest", train, _options(spark, True))
    return EV.summary_metrics(TR.predictions(model, test, "machine_failure"), labels=[0, 1])


def rf_importance(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    model = TR.fit("random_forest", train, _options(spark, True))
    return TR.importance_table(spark, model, train)


def gbt_scores(spark, sf_dir):
    """M4: boosted trees (positive-class weight 3) scored on the test part."""
    train, test = _split(spark, sf_dir)
    model = TR.fit("xgboost", train, _options(spark))
    return TR.predictions(model, test, "machine_failure")


def lr_coefficients(spark, sf_dir):
    """M5 + M19: balanced logistic regression, |coefficient| ranking."""
    train, _ = _split(spark, sf_dir)
    model = TR.fit("logistic_regression", train, _options(spark))
    return TR.importance_table(spark, model, train)


def svm_scores(spark, sf_dir):
    """M6: linear SVM (no probabilities: p falls back to the hard label)."""
    train, test = _split(spark, sf_dir)
    model = TR.fit("svm", train, _options(spark))
    return TR.predictions(model, test, "machine_failure")


def _embedding_scores(spark, sf_dir, epochs: int):
    """M7/M8/M10/M11 by the library's ``fit``: the neural net on scaled
    64-dim embeddings, ten classes, the test part with all probabilities."""
    emb = read_table(spark, sf_dir, "embeddings")
    df = emb.select(
        F.col("vec_id").alias(S.UID),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("vector"),
        "label",
    )
    df = prep.hash_split(df, (0.8, 0.2), ("train", "test"))
    opts = _options(spark, label="label", mlp={"architecture": [64, 32, 16], "epochs": epochs, "batch_size": 32})
    scaler = StandardScaler(inputCol="vector", outputCol="features", withMean=True, withStd=True)
    model = TR.fit("neural_network", df.filter(F.col("split") == "train"), opts, [scaler])
    return TR.predictions(model, df.filter(F.col("split") == "test"), "label", probabilities=True)


def mlp_scores(spark, sf_dir):
    """Multilayer perceptron on the embeddings; the prediction is
    the argmax class, with its probability."""
    return _embedding_scores(spark, sf_dir, 50).select(S.UID, "y", "pred", F.col("p").alias("p_pred"))


def tuned_best(spark, sf_dir):
    """Random search (whole grid when smaller than n_iter) with
    stratified 3-fold CV on logistic regression; rows = candidates with
    their mean class-1 F1, best flagged."""
    train, _ = _split(spark, sf_dir)
    found = TR.tune("logistic_regression", train, _options(spark))
    rows = []
    for i, (st, metric) in enumerate(found.scored):
        rows.append((i, float(st.get("regParam", 0.0)), float(st.get("elasticNetParam", 0.0)), float(metric)))
    df = spark.createDataFrame(rows, "candidate int, reg_param double, elastic_net double, cv_f1 double")
    best_i = max(range(len(rows)), key=lambda i: (rows[i][3], -i))
    return df.withColumn("is_best", (F.col("candidate") == best_i).cast("int"))


def model_comparison(spark, sf_dir):
    """Every enabled model trained in order, evaluated on the
    test part, best by weighted F1 (first wins ties)."""
    train, test = _split(spark, sf_dir)
    return TR.train_all(train, test, _options(spark)).metrics


# --- exact facts of trained results, with oracles --------------------------
# (at the settings that the configuration has)

_HASH_SQL = "md5(concat(CAST(uid AS VARCHAR), '42'))"
_TEST_ROWS_SQL = f"""SELECT uid, machine_failure AS y, 1 AS pred_is_class, 1 AS p_is_share
FROM f WHERE substr({_HASH_SQL}, 1, 4) >= 'cccc'"""


def _facts(scored: DataFrame, classes: int) -> DataFrame:
    return scored.select(
        S.UID, "y", F.col("pred").between(0, classes - 1).cast("int").alias("pred_is_class"),
        F.col("p").between(0.0, 1.0).cast("int").alias("p_is_share"))


def _scored_facts(name: str, **more):
    def run(spark, sf_dir):
        train, test = _split(spark, sf_dir)
        model = TR.fit(name, train, _options(spark, name == "random_forest", **more))
        return _facts(TR.predictions(model, test, "machine_failure"), 2)

    return run


def embedding_predictions(spark, sf_dir):
    """S8 + M11 on ten classes: the sink's columns, checked for form."""
    sink = io.prediction_sink(_embedding_scores(spark, sf_dir, 50).withColumnRenamed("y", "label"), label="label", n_classes=10)
    probs = [F.col(f"probability_class_{i}") for i in range(10)]
    total = sum(probs[1:], probs[0])
    return sink.select(
        S.UID, F.col("true_value").cast("int").alias("y"), F.col("prediction").between(0, 9).cast("int").alias("pred_is_class"),
        (F.abs(total - 1) < 1e-6).cast("int").alias("probabilities_sum_to_one"))


EMBEDDING_PREDICTIONS_SQL = """SELECT vec_id AS uid, label AS y, 1 AS pred_is_class, 1 AS probabilities_sum_to_one
FROM embeddings WHERE substr(md5(concat(CAST(vec_id AS VARCHAR), '42')), 1, 4) >= 'cccc'"""


def _slot_names(**more):
    """The assembled features' names under these options, in order."""

    def run(spark, sf_dir):
        train, _ = _split(spark, sf_dir)
        opts = _options(spark, **more)
        rows = Pipeline(stages=TR.base_stages(opts)).fit(train).transform(train)
        return spark.createDataFrame(list(enumerate(TR.slot_names(rows))), "slot int, name string")

    return run


def _names_sql(names: list[str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(names)) + ") AS t(slot, name)"


_SENSORS = ["air_temp_k", "process_temp_k", "rpm", "torque_nm", "tool_wear_min"]
# features' names, written out
_DOMAIN = ["temp_diff", "power_w", "tool_wear_rate", "torque_per_rpm", "tool_wear_torque", "temp_efficiency", "critical_operation"]
_PAIRS = [
    "air_temp_k_process_temp_k_interaction", "rpm_torque_nm_interaction", "tool_wear_min_torque_nm_interaction",
    "tool_wear_min_rpm_interaction",
]
# monomials of degree 2, then square, cube and root of each sensor and of what was added
_MONOMIALS = [f"{a}^2" if a == b else f"{a} {b}" for i, a in enumerate(_SENSORS) for b in _SENSORS[i:]]
_POWERS = [f"{a}_{n}" for a in [*_SENSORS, *_MONOMIALS] for n in ("squared", "cubed", "sqrt")]
_PAIR_POWERS = [f"{a}_{n}" for a in [*_SENSORS, *_PAIRS] for n in ("squared", "cubed", "sqrt")]
_ONEHOT = ["type_ohe_H", "type_ohe_L", "type_ohe_M"]


def search_candidates(spark, sf_dir):
    """The logistic search's candidates in order, for this training set."""
    train, _ = _split(spark, sf_dir)
    n = train.count()
    rows = [(i, float(c["regParam"]), float(c["elasticNetParam"])) for i, c in enumerate(TR.candidates("logistic_regression", float(n))[0])]
    return spark.createDataFrame(rows, "candidate int, reg_param double, elastic_net double")


SEARCH_CANDIDATES_SQL = with_base(f"""SELECT candidate, 1.0 / (c * n) AS reg_param, elastic_net FROM
(VALUES (0, CAST(0.1 AS DOUBLE), CAST(1 AS DOUBLE)), (1, 0.1, 0), (2, 1, 1), (3, 1, 0), (4, 10, 1), (5, 10, 0)) AS t(candidate, c, elastic_net),
(SELECT CAST(count(*) AS DOUBLE) AS n FROM f WHERE substr({_HASH_SQL}, 1, 4) < 'cccc') AS k""")


def compared_models(spark, sf_dir):
    """Which models were trained, in which order, on how many test rows."""
    train, test = _split(spark, sf_dir)
    opts = _options(spark, enabled=("random_forest", "xgboost", "logistic_regression", "svm", "neural_network"))
    return TR.train_all(train, test, opts).metrics.select("model", "train_order", "n_rows")


COMPARED_MODELS_SQL = with_base(f"""SELECT model, train_order, n_rows FROM
(VALUES ('random_forest', 0), ('xgboost', 1), ('logistic_regression', 2), ('svm', 3), ('neural_network', 4)) AS t(model, train_order),
(SELECT count(*) AS n_rows FROM f WHERE substr({_HASH_SQL}, 1, 4) >= 'cccc') AS k""")



def boosted_first_tree(spark, sf_dir):
    """M4: the nodes of the first tree on the encoded type and the sensors as they
    are, with all rows and columns, so that its sums are exact."""
    train, _ = _split(spark, sf_dir)
    data = TR.prepare(train, _options(spark, domain=False, interactions=False, scaling="none"))
    try:
        cuts = BO.edges(data.rows)
        one = BO.Settings(**{**TR.TrainOptions().gbt, "n_estimators": 1, "subsample": 1.0, "colsample_bytree": 1.0})
        trees = BO.fit_many(BO.blocks(data.rows, cuts, "machine_failure"), cuts, [one])[0]
        names = TR.slot_names(data.rows)
    finally:
        data.release()
    rows = [(i, names[f] if f >= 0 else None, None if at is None else round(at, 9), cover, round(value, 9))
            for _, i, f, at, value, _, cover in BO.node_rows(trees, cuts)]
    return spark.createDataFrame(rows, "node int, feature string, threshold double, cover double, leaf_value double")


def _first_tree_sql(depth: int = 5, bins: int = BO.MAX_BINS, weight: float = 3.0, rate: float = 0.1) -> str:
    parts = [f"""tr AS MATERIALIZED (
SELECT uid, machine_failure AS y, CASE WHEN machine_failure = 1 THEN {weight} ELSE 1.0 END AS w,
       [CAST(type = 'H' AS DOUBLE), CAST(type = 'L' AS DOUBLE), CAST(type = 'M' AS DOUBLE), {", ".join(_SENSORS)}] AS xs
FROM f WHERE substr({_HASH_SQL}, 1, 4) < 'cccc'
), long AS MATERIALIZED (
SELECT uid, CAST(w * (0.5 - y) AS DOUBLE) AS g, CAST(w * 0.25 AS DOUBLE) AS h, j, xs[j] AS x FROM tr, range(1, {len(_SENSORS) + 4}) AS k(j)
), cuts AS MATERIALIZED (
SELECT DISTINCT j, x AS c FROM (SELECT j, x, row_number() OVER (PARTITION BY j ORDER BY x) AS rn, count(*) OVER (PARTITION BY j) AS n FROM long) AS o
WHERE EXISTS (SELECT 1 FROM range(1, {bins}) AS q(k) WHERE rn = CAST(ceil(k * n / CAST({bins} AS DOUBLE)) AS BIGINT))
), binned AS MATERIALIZED (
SELECT l.uid, l.j, g, h, coalesce(c, CAST('infinity' AS DOUBLE)) AS b FROM long AS l ASOF LEFT JOIN cuts AS k ON l.j = k.j AND l.x <= k.c
), n0 AS (
SELECT uid, 0 AS node FROM tr
)"""]
    for d in range(depth):
        parts.append(f"""h{d} AS MATERIALIZED (
SELECT node, j, b, sum(g) AS g, sum(h) AS h FROM n{d} JOIN binned USING (uid) GROUP BY ALL
), c{d} AS (
SELECT node, j, b, sum(g) OVER (PARTITION BY node, j ORDER BY b) AS gl, sum(h) OVER (PARTITION BY node, j ORDER BY b) AS hl,
       sum(g) OVER (PARTITION BY node, j) AS g, sum(h) OVER (PARTITION BY node, j) AS h
FROM h{d}
), g{d} AS (
SELECT *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) AS gain FROM c{d} WHERE hl >= 1 AND h - hl >= 1
), b{d} AS MATERIALIZED (
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, j, b) AS rn FROM g{d} WHERE gain > 0.000001) AS o WHERE rn = 1
), n{d + 1} AS MATERIALIZED (
SELECT n.uid, 2 * n.node + CASE WHEN r.b > s.b THEN 2 ELSE 1 END AS node
FROM n{d} AS n JOIN b{d} AS s USING (node) JOIN binned AS r ON r.uid = n.uid AND r.j = s.j
)""")
    splits = " UNION ALL ".join(f"SELECT node, j, b FROM b{d}" for d in range(depth))
    sums = " UNION ALL ".join(f"SELECT node, sum(g) AS g, sum(h) AS h FROM n{d} JOIN binned USING (uid) WHERE j = 1 GROUP BY node" for d in range(depth + 1))
    names = ", ".join(f"'{n}'" for n in [*_ONEHOT, *_SENSORS])
    return with_base("").rstrip() + ", " + ", ".join(parts) + f"""
SELECT CAST(node AS INTEGER) AS node, [{names}][j] AS feature, round(b, 9) AS threshold, h AS cover, round(-g / (h + 1) * {rate}, 9) AS leaf_value
FROM ({sums}) AS t LEFT JOIN ({splits}) AS s USING (node)"""


BOOSTED_FIRST_TREE_SQL = _first_tree_sql()


def boosted_candidates(spark, sf_dir):
    """The boosted search's candidates on this training set, all settings kept."""
    train, _ = _split(spark, sf_dir)
    found = TR.candidates("xgboost", float(train.count()))[0]
    names = ["n_estimators", "learning_rate", "max_depth", "subsample", "colsample_bytree", "scale_pos_weight"]
    kinds = ["int", "double", "int", "double", "double", "double"]
    return spark.createDataFrame(
        [(i, *(c[n] for n in names)) for i, c in enumerate(found)], "candidate int, " + ", ".join(map(" ".join, zip(names, kinds))))


# The seeded sample of the grid, written out
BOOSTED_CANDIDATES_SQL = """SELECT candidate, n_estimators, CAST(learning_rate AS DOUBLE) AS learning_rate, max_depth, CAST(subsample AS DOUBLE) AS subsample,
       CAST(colsample_bytree AS DOUBLE) AS colsample_bytree, CAST(scale_pos_weight AS DOUBLE) AS scale_pos_weight FROM (VALUES
(0, 200, 0.2, 3, 0.6, 1.0, 1), (1, 50, 0.1, 5, 0.6, 1.0, 1), (2, 50, 0.01, 3, 1.0, 1.0, 3), (3, 100, 0.01, 5, 0.8, 0.6, 5),
(4, 100, 0.01, 3, 0.6, 1.0, 3), (5, 50, 0.2, 7, 0.8, 0.8, 1), (6, 50, 0.1, 7, 0.6, 1.0, 3), (7, 50, 0.1, 3, 1.0, 0.8, 5),
(8, 200, 0.2, 5, 0.8, 1.0, 5), (9, 200, 0.01, 7, 1.0, 0.6, 1), (10, 50, 0.1, 3, 0.6, 1.0, 5), (11, 200, 0.1, 5, 0.8, 0.6, 3),
(12, 100, 0.2, 5, 0.6, 0.6, 1), (13, 50, 0.01, 5, 0.6, 0.8, 5), (14, 50, 0.01, 5, 0.6, 0.8, 1), (15, 50, 0.1, 3, 0.8, 0.8, 5),
(16, 50, 0.2, 7, 0.6, 1.0, 3), (17, 50, 0.2, 7, 1.0, 0.8, 3), (18, 200, 0.01, 5, 0.6, 0.8, 3), (19, 200, 0.1, 5, 1.0, 0.8, 3)
) AS t(candidate, n_estimators, learning_rate, max_depth, subsample, colsample_bytree, scale_pos_weight)"""

_SCALED = lambda names: [f"{n}_scaled" for n in names]

QUERIES = {
    "rf_test_accuracy": (rf_test_accuracy, None),
    "rf_importance": (rf_importance, None),
    "gbt_scores": (gbt_scores, None),
    "lr_coefficients": (lr_coefficients, None),
    "svm_scores": (svm_scores, None),
    "mlp_scores": (mlp_scores, None),
    "tuned_best": (tuned_best, None),
    "model_comparison": (model_comparison, None),
    "forest_test_rows": (_scored_facts("random_forest"), with_base(_TEST_ROWS_SQL)),
    "boosted_test_rows": (_scored_facts("xgboost"), with_base(_TEST_ROWS_SQL)),
    "boosted_first_tree": (boosted_first_tree, BOOSTED_FIRST_TREE_SQL),
    "boosted_candidates": (boosted_candidates, BOOSTED_CANDIDATES_SQL),
    "logistic_test_rows": (_scored_facts("logistic_regression", scaling="robust", handle_missing="mean", select_features=8), with_base(_TEST_ROWS_SQL)),
    "svm_test_rows": (_scored_facts("svm", scaling="minmax", encoding="target"), with_base(_TEST_ROWS_SQL)),
    "embedding_predictions": (embedding_predictions, EMBEDDING_PREDICTIONS_SQL),
    "model_slots": (_slot_names(), _names_sql([*_ONEHOT, *_SCALED([*_SENSORS, *_DOMAIN, *_PAIRS])])),
    "model_slots_plain": (_slot_names(domain=False, interactions=False, scaling="none", encoding="label"), _names_sql(["type_label", *_SENSORS])),
    "model_slots_expanded": (_slot_names(domain=False, interactions=False, polynomial=True, powers=True, scaling="none"),
                             _names_sql([*_ONEHOT, *_SENSORS, *_MONOMIALS, *_POWERS])),
    "model_slots_powers": (_slot_names(domain=False, powers=True, scaling="none"),
                           _names_sql([*_ONEHOT, *_SENSORS, *_PAIRS, *_PAIR_POWERS])),
    "search_candidates": (search_candidates, SEARCH_CANDIDATES_SQL),
    "compared_models": (compared_models, COMPARED_MODELS_SQL),
}
