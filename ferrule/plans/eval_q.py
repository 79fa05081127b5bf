"""Registered queries: evaluation (E1-E17, M17) on the rule label and the
fixed linear scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule import schema as S
from ferrule.operators import evaluate as EV
from ferrule.operators.scoring import evaluation_frame
from ferrule.plans.sqltext import POWER_SQL, with_base
from ferrule.sources.readings import machine_readings


def _pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation_frame(machine_readings(spark, sf_dir))


def accuracy_weighted_prf(spark, sf_dir):
    return EV.summary_metrics(_pred(spark, sf_dir), labels=[0, 1])


_PER_CLASS_SQL = """cells AS (
SELECT t.l AS true_label, q.l AS predicted_label, count(e.uid) AS cnt
FROM (VALUES (0), (1)) t(l) CROSS JOIN (VALUES (0), (1)) q(l)
LEFT JOIN e ON e.y = t.l AND e.pred = q.l
GROUP BY 1, 2
),
pc AS (
SELECT l.label,
       coalesce(sum(CASE WHEN c.true_label = l.label AND c.predicted_label = l.label THEN c.cnt END), 0) AS tp,
       coalesce(sum(CASE WHEN c.predicted_label = l.label THEN c.cnt END), 0) AS predicted,
       coalesce(sum(CASE WHEN c.true_label = l.label THEN c.cnt END), 0) AS support
FROM (VALUES (0), (1)) l(label), cells c
GROUP BY l.label
),
pm AS (
SELECT *,
       CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
       CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
       CASE WHEN predicted + support > 0 THEN 2 * tp / (predicted + support) ELSE 0.0 END AS f1
FROM pc
)"""

ACCURACY_PRF_SQL = with_base(
    f""",
{_PER_CLASS_SQL}
SELECT CAST(sum(support) AS BIGINT) AS n_rows,
       round(sum(tp) / sum(support), 6) AS accuracy,
       round(sum(precision * support) / sum(support), 6) AS precision_weighted,
       round(sum(recall * support) / sum(support), 6) AS recall_weighted,
       round(sum(f1 * support) / sum(support), 6) AS f1_weighted
FROM pm"""
)


def confusion_cells(spark, sf_dir):
    return EV.confusion_cells(_pred(spark, sf_dir), labels=[0, 1])


CONFUSION_SQL = with_base(
    f""",
{_PER_CLASS_SQL}
SELECT true_label, predicted_label, CAST(cnt AS BIGINT) AS count FROM cells"""
)


def classification_report(spark, sf_dir):
    return EV.classification_report(_pred(spark, sf_dir), labels=[0, 1])


CLASS_REPORT_SQL = with_base(
    f""",
{_PER_CLASS_SQL}
SELECT CAST(label AS VARCHAR) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM pm
UNION ALL
SELECT 'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), round(sum(tp) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM pm
UNION ALL
SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       CAST(sum(support) AS BIGINT) FROM pm
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM pm"""
)

# Grouped prefix sums in SQL: one row per distinct score, descending.
_PREFIX_SQL = """g AS (
SELECT p, CAST(sum(y) AS BIGINT) AS pos, CAST(count(*) - sum(y) AS BIGINT) AS neg FROM e GROUP BY p
),
c AS (
SELECT p, pos, neg,
       sum(pos) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos,
       sum(neg) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg,
       lead(pos) OVER (ORDER BY p DESC) AS next_pos,
       lead(neg) OVER (ORDER BY p DESC) AS next_neg,
       sum(pos) OVER () AS total_pos,
       sum(neg) OVER () AS total_neg,
       row_number() OVER (ORDER BY p DESC) AS k
FROM g
)"""


def roc_auc(spark, sf_dir):
    return EV.roc_auc(_pred(spark, sf_dir))


ROC_AUC_SQL = with_base(
    f""",
{_PREFIX_SQL}
SELECT sum(pos * (total_neg - cum_neg + neg * 0.5)) / (max(total_pos) * max(total_neg)) AS roc_auc,
       CAST(max(total_pos) AS BIGINT) AS n_pos, CAST(max(total_neg) AS BIGINT) AS n_neg
FROM c"""
)


def average_precision(spark, sf_dir):
    return EV.average_precision(_pred(spark, sf_dir))


AP_SQL = with_base(
    f""",
{_PREFIX_SQL}
SELECT round(sum(pos * cum_pos / (cum_pos + cum_neg)) / max(total_pos), 6) AS average_precision FROM c"""
)


def roc_curve(spark, sf_dir):
    return EV.roc_curve(_pred(spark, sf_dir))


ROC_CURVE_SQL = with_base(
    f""",
{_PREFIX_SQL}
SELECT CAST('Infinity' AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr
UNION ALL
SELECT p, CAST(cum_neg AS DOUBLE) / total_neg, CAST(cum_pos AS DOUBLE) / total_pos
FROM c
WHERE k = 1 OR next_pos IS NULL OR next_neg <> neg OR next_pos <> pos"""
)


def pr_curve(spark, sf_dir):
    return EV.pr_curve(_pred(spark, sf_dir))


PR_CURVE_SQL = with_base(
    f""",
{_PREFIX_SQL}
SELECT p AS threshold, cum_pos / (cum_pos + cum_neg) AS precision, cum_pos / total_pos AS recall FROM c
UNION ALL
SELECT CAST(NULL AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)"""
)

# Three fixed scorers compared as "models" (E9/M17); order = training order.
MODEL_SCORERS = {
    "linear": None,  # the fixed linear scorer p
    "wear_only": "round(least(CAST(1 AS DOUBLE), tool_wear_min / CAST(250 AS DOUBLE)), 6)",
    "critical": f"(CAST(process_temp_k - air_temp_k < 8.6 AS INT) * CAST({POWER_SQL} < 3500 AS INT) "
    f"+ CAST({POWER_SQL} > 9000 AS INT) + CAST(tool_wear_min > 200 AS INT)) / CAST(2 AS DOUBLE)",
}
MODEL_ORDER = {name: i for i, name in enumerate(MODEL_SCORERS)}


def _model_frame(spark, sf_dir) -> DataFrame:
    base = _pred(spark, sf_dir)
    parts = []
    for name, expr in MODEL_SCORERS.items():
        p = F.col("p") if expr is None else F.expr(expr)
        parts.append(F.struct(F.lit(name).alias("model"), p.alias("score")))
    return base.select(S.UID, "y", F.explode(F.array(*parts)).alias("m")).select(
        S.UID, "y", F.col("m.model").alias("model"), F.col("m.score").alias("p"),
        (F.col("m.score") > 0.5).cast("int").alias("pred"),
    )


def best_model(spark, sf_dir):
    m = EV.model_metrics(_model_frame(spark, sf_dir))
    ranked = EV.best_model(m, MODEL_ORDER, "accuracy")
    ranked = EV.best_model(ranked.drop("train_order"), MODEL_ORDER, "f1_weighted")
    return ranked.select(
        "model", "train_order", "n_rows", "accuracy", "precision_weighted", "recall_weighted",
        "f1_weighted", "roc_auc", "is_best_accuracy", "is_best_f1_weighted",
    )


def _best_model_sql() -> str:
    unions = []
    for name, expr in MODEL_SCORERS.items():
        p = "p" if expr is None else expr
        unions.append(f"SELECT uid, y, '{name}' AS model, {p} AS p FROM e")
    order = " ".join(f"WHEN '{n}' THEN {i}" for n, i in MODEL_ORDER.items())
    return with_base(
        f""",
mf0 AS ({' UNION ALL '.join(unions)}),
mf AS (SELECT *, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS pred FROM mf0),
cells AS (
SELECT m.model, t.l AS true_label, q.l AS predicted_label,
       (SELECT count(*) FROM mf x WHERE x.model = m.model AND x.y = t.l AND x.pred = q.l) AS cnt
FROM (SELECT DISTINCT model FROM mf) m, (VALUES (0), (1)) t(l), (VALUES (0), (1)) q(l)
),
pc AS (
SELECT c.model, l.label,
       sum(CASE WHEN c.true_label = l.label AND c.predicted_label = l.label THEN c.cnt ELSE 0 END) AS tp,
       sum(CASE WHEN c.predicted_label = l.label THEN c.cnt ELSE 0 END) AS predicted,
       sum(CASE WHEN c.true_label = l.label THEN c.cnt ELSE 0 END) AS support
FROM (VALUES (0), (1)) l(label), cells c GROUP BY c.model, l.label
),
pm AS (
SELECT *,
       CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
       CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
       CASE WHEN predicted + support > 0 THEN 2 * tp / (predicted + support) ELSE 0.0 END AS f1
FROM pc
),
sm AS (
SELECT model, CAST(sum(support) AS BIGINT) AS n_rows,
       round(sum(tp) / sum(support), 6) AS accuracy,
       round(sum(precision * support) / sum(support), 6) AS precision_weighted,
       round(sum(recall * support) / sum(support), 6) AS recall_weighted,
       round(sum(f1 * support) / sum(support), 6) AS f1_weighted
FROM pm GROUP BY model
),
g AS (SELECT model, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM mf GROUP BY model, p),
cu AS (
SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg,
       sum(pos) OVER (PARTITION BY model) AS tp_all, sum(neg) OVER (PARTITION BY model) AS tn_all
FROM g
),
auc AS (
SELECT model, round(sum(pos * (tn_all - cum_neg + neg * 0.5)) / (max(tp_all) * max(tn_all)), 6) AS roc_auc
FROM cu GROUP BY model
),
j AS (
SELECT sm.*, auc.roc_auc, CASE sm.model {order} END AS train_order FROM sm JOIN auc USING (model)
)
SELECT model, train_order, n_rows, accuracy, precision_weighted, recall_weighted, f1_weighted, roc_auc,
       CASE WHEN row_number() OVER (ORDER BY accuracy DESC, train_order) = 1 THEN 1 ELSE 0 END AS is_best_accuracy,
       CASE WHEN row_number() OVER (ORDER BY f1_weighted DESC, train_order) = 1 THEN 1 ELSE 0 END AS is_best_f1_weighted
FROM j"""
    )


def _errors(spark, sf_dir) -> DataFrame:
    return EV.error_frame(_pred(spark, sf_dir))


def error_frame(spark, sf_dir):
    return _errors(spark, sf_dir).drop(S.TS)


ERROR_FRAME_SQL = with_base(
    """SELECT uid, machine_id, type, air_temp_k, process_temp_k, rpm, torque_nm, tool_wear_min, y, pred, p,
       CASE WHEN y <> pred THEN 1 ELSE 0 END AS is_error,
       1.0 - p AS prob_class_0, p AS prob_class_1
FROM e"""
)


def error_rates(spark, sf_dir):
    return EV.error_rates(_errors(spark, sf_dir))


ERROR_RATES_SQL = with_base(
    """SELECT 'all' AS scope, CAST(NULL AS INT) AS label, count(*) AS n_rows,
       round(avg(CASE WHEN y <> pred THEN 1 ELSE 0 END), 6) AS error_rate FROM e
UNION ALL
SELECT 'class', y, count(*), round(avg(CASE WHEN y <> pred THEN 1 ELSE 0 END), 6) FROM e GROUP BY y"""
)


def top_misclassified(spark, sf_dir):
    return EV.top_misclassified(_errors(spark, sf_dir))


TOP_MISCLASSIFIED_SQL = with_base(
    """SELECT y AS true_label, pred AS predicted_label, count(*) AS count
FROM e WHERE y <> pred GROUP BY y, pred
ORDER BY count DESC, true_label, predicted_label LIMIT 5"""
)

KIND_COLUMNS = [S.TYPE, *S.SENSORS, "y", "pred"]


def column_kinds(spark, sf_dir):
    return EV.column_kinds(_errors(spark, sf_dir), KIND_COLUMNS)


def _column_kinds_sql() -> str:
    parts = []
    for c in KIND_COLUMNS:
        kind = (
            "'categorical'"
            if c == S.TYPE
            else f"CASE WHEN count(DISTINCT {c}) < 10 THEN 'categorical' ELSE 'numeric' END"
        )
        parts.append(f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_distinct, {kind} AS kind FROM e")
    return with_base("\nUNION ALL\n".join(parts))


def error_dist_categorical(spark, sf_dir):
    return EV.error_dist_categorical(_errors(spark, sf_dir), [S.TYPE, "y"])


ERROR_DIST_CAT_SQL = with_base(
    """SELECT 'type' AS feature, type AS value, CASE WHEN y <> pred THEN 1 ELSE 0 END AS is_error, count(*) AS n_rows
FROM e GROUP BY 1, 2, 3
UNION ALL
SELECT 'y', CAST(y AS VARCHAR), CASE WHEN y <> pred THEN 1 ELSE 0 END, count(*) FROM e GROUP BY 1, 2, 3"""
)


def error_dist_numeric(spark, sf_dir):
    return EV.error_dist_numeric(_errors(spark, sf_dir), S.SENSORS)


def _error_dist_numeric_sql() -> str:
    stacked = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, CASE WHEN y <> pred THEN 1 ELSE 0 END AS is_error FROM e"
        for c in S.SENSORS
    )
    return with_base(
        f""",
st AS ({stacked}),
rg AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM st GROUP BY feature),
b AS (
SELECT st.feature, st.is_error, lo, hi,
       CAST(CASE WHEN hi - lo = 0 THEN 0 ELSE least(floor((value - lo) / (hi - lo) * 20), 19) END AS INT) AS bin
FROM st JOIN rg USING (feature)
)
SELECT feature, bin, is_error, count(*) AS n_rows, round(min(lo) + bin * (min(hi) - min(lo)) / 20, 6) AS bin_start
FROM b GROUP BY feature, bin, is_error"""
    )


def _three_classes(spark, sf_dir):
    """Readings with three speed classes and two guesses at them by torque."""
    speed = F.when(F.col("rpm") < 1450, 0).when(F.col("rpm") < 1600, 1).otherwise(2)
    guess = F.when(F.col("torque_nm") > 45, 0).when(F.col("torque_nm") > 35, 1).otherwise(2)
    return machine_readings(spark, sf_dir).select("uid", "torque_nm", speed.alias("y"), guess.alias("pred"))


def three_class_metrics(spark, sf_dir):
    """E1/E3/E9 for more than two classes: no ROC AUC."""
    rows = _three_classes(spark, sf_dir).withColumn("p", F.lit(0.5))
    both = rows.withColumn("model", F.lit("torque")).unionByName(rows.withColumn("pred", F.lit(1)).withColumn("model", F.lit("constant")))
    return EV.model_metrics(both)


_THREE_SQL = """, t AS (
SELECT uid, torque_nm, CASE WHEN rpm < 1450 THEN 0 WHEN rpm < 1600 THEN 1 ELSE 2 END AS y,
       CASE WHEN torque_nm > 45 THEN 0 WHEN torque_nm > 35 THEN 1 ELSE 2 END AS pred
FROM f
)"""
THREE_CLASS_METRICS_SQL = with_base(_THREE_SQL + """, m AS (
SELECT 'torque' AS model, y, pred FROM t UNION ALL SELECT 'constant', y, 1 FROM t
), c AS (
SELECT model, k, count(*) FILTER (y = k AND pred = k) AS tp, count(*) FILTER (pred = k) AS g, count(*) FILTER (y = k) AS s, count(*) AS n
FROM m, range(3) AS r(k) GROUP BY model, k
)
SELECT model, any_value(n) AS n_rows, round(sum(tp) / any_value(n), 6) AS accuracy,
       round(sum(s * CASE WHEN g > 0 THEN tp / g ELSE 0 END) / any_value(n), 6) AS precision_weighted,
       round(sum(s * CASE WHEN s > 0 THEN tp / s ELSE 0 END) / any_value(n), 6) AS recall_weighted,
       round(sum(s * CASE WHEN g + s > 0 THEN 2 * tp / (g + s) ELSE 0 END) / any_value(n), 6) AS f1_weighted,
       CAST(NULL AS DOUBLE) AS roc_auc
FROM c GROUP BY model""")


def error_frame_classes(spark, sf_dir):
    """E10 for three classes: one probability column a class."""
    w = [F.abs(F.col("torque_nm") - c) + 1 for c in (50.0, 40.0, 30.0)]
    total = w[0] + w[1] + w[2]
    rows = _three_classes(spark, sf_dir).withColumn("probability", F.array(*[x / total for x in w]))
    out = EV.error_frame(rows, probability="probability", n_classes=3)
    return out.select("uid", "y", "pred", "is_error", *[F.round(f"prob_class_{i}", 9).alias(f"prob_class_{i}") for i in range(3)])


ERROR_FRAME_CLASSES_SQL = with_base(_THREE_SQL + """, w AS (
SELECT *, abs(torque_nm - 50.0) + 1 AS a, abs(torque_nm - 40.0) + 1 AS b, abs(torque_nm - 30.0) + 1 AS c FROM t
)
SELECT uid, y, pred, CASE WHEN y <> pred THEN 1 ELSE 0 END AS is_error,
       round(a / (a + b + c), 9) AS prob_class_0, round(b / (a + b + c), 9) AS prob_class_1, round(c / (a + b + c), 9) AS prob_class_2
FROM w""")

QUERIES = {
    "three_class_metrics": (three_class_metrics, THREE_CLASS_METRICS_SQL),
    "error_frame_classes": (error_frame_classes, ERROR_FRAME_CLASSES_SQL),
    "accuracy_weighted_prf": (accuracy_weighted_prf, ACCURACY_PRF_SQL),
    "confusion_cells": (confusion_cells, CONFUSION_SQL),
    "classification_report": (classification_report, CLASS_REPORT_SQL),
    "roc_auc": (roc_auc, ROC_AUC_SQL),
    "roc_curve": (roc_curve, ROC_CURVE_SQL),
    "pr_curve": (pr_curve, PR_CURVE_SQL),
    "average_precision": (average_precision, AP_SQL),
    "best_model": (best_model, _best_model_sql()),
    "error_frame": (error_frame, ERROR_FRAME_SQL),
    "error_rates": (error_rates, ERROR_RATES_SQL),
    "top_misclassified": (top_misclassified, TOP_MISCLASSIFIED_SQL),
    "column_kinds": (column_kinds, _column_kinds_sql()),
    "error_dist_categorical": (error_dist_categorical, ERROR_DIST_CAT_SQL),
    "error_dist_numeric": (error_dist_numeric, _error_dist_numeric_sql()),
}
