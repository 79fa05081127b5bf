"""Registered queries: declared options without code in the reference
(C1 robust scaling, C2 mode imputation, C3 label / target encoding,
C4 F-test feature selection), and the P2/P8 helpers."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from ferrule import schema as S
from ferrule.functions import rules
from ferrule.ml import select as SEL
from ferrule.ml import train as TR
from ferrule.ml.stages import encoding_stages
from ferrule.operators import prep
from ferrule.operators import quality as Q
from ferrule.plans.sqltext import RAW_CTE, with_base
from ferrule.sources.readings import machine_readings, raw_readings


def robust_scaled(spark, sf_dir):
    df = machine_readings(spark, sf_dir)
    out = Q.robust_scale(df, S.SENSORS)
    return out.select(S.UID, *[F.round(f"{c}_rs", 6).alias(f"{c}_rs") for c in S.SENSORS])


def _robust_sql() -> str:
    q = ",\n       ".join(
        f"quantile_cont({c}, 0.25) OVER () AS {c}_q1, quantile_cont({c}, 0.5) OVER () AS {c}_q2, "
        f"quantile_cont({c}, 0.75) OVER () AS {c}_q3" for c in S.SENSORS
    )
    out = ",\n       ".join(
        f"round(({c} - {c}_q2) / coalesce(nullif({c}_q3 - {c}_q1, 0), 1), 6) AS {c}_rs" for c in S.SENSORS
    )
    return with_base(f""", qq AS (SELECT *,
       {q}
FROM r)
SELECT uid,
       {out}
FROM qq""")


def imputed_mode(spark, sf_dir):
    """C2 'mode' on the raw feed: torque and machine type."""
    checked = Q.validate_requests(raw_readings(spark, sf_dir))
    df = Q.impute_mode(checked, [S.TORQUE, S.TYPE])
    return df.select(S.UID, S.TORQUE, S.TYPE)


IMPUTED_MODE_SQL = f"""WITH {RAW_CTE},
c AS (SELECT uid, machine_type AS type, TRY_CAST(torque AS DOUBLE) AS torque_nm FROM raw),
mt AS (SELECT torque_nm AS m FROM c WHERE torque_nm IS NOT NULL GROUP BY torque_nm
       ORDER BY count(*) DESC, torque_nm LIMIT 1),
ty AS (SELECT type AS m FROM c WHERE type IS NOT NULL GROUP BY type ORDER BY count(*) DESC, type LIMIT 1)
SELECT uid, coalesce(torque_nm, (SELECT m FROM mt)) AS torque_nm, coalesce(type, (SELECT m FROM ty)) AS type
FROM c"""


def encoded_type(spark, sf_dir):
    """Label encoding (sorted categories) and target encoding (per-type
    failure rate) of the machine type."""
    df = rules.label_failures(machine_readings(spark, sf_dir))
    stages = encoding_stages(S.TYPE, "target", label="machine_failure")
    out = Pipeline(stages=stages).fit(df).transform(df)
    return out.select(
        S.UID, S.TYPE,
        F.col("type_label").cast("int").alias("type_label"),
        F.round("type_target", 6).alias("type_target"),
    )


ENCODED_TYPE_SQL = with_base(
    """SELECT uid, type,
       CASE type WHEN 'H' THEN 0 WHEN 'L' THEN 1 WHEN 'M' THEN 2 ELSE 3 END AS type_label,
       round(avg(machine_failure) OVER (PARTITION BY type), 6) AS type_target
FROM f"""
)


def selected_features(spark, sf_dir):
    """C4 'f_test': the five prepared features with the highest ANOVA F
    against the failure label."""
    df = rules.label_failures(machine_readings(spark, sf_dir))
    opts = TR.TrainOptions()
    prepared = Pipeline(stages=TR.base_stages(opts)).fit(df).transform(df)
    return SEL.top_f(prepared, "machine_failure", 5).select("feature")


def _selected_sql() -> str:
    # feature expressions in assembler order (one-hot slots, then scaled numerics)
    power = "rpm * torque_nm * (2 * pi() / 60)"
    exprs = {
        "type_ohe_H": "CASE WHEN type = 'H' THEN 1.0 ELSE 0.0 END",
        "type_ohe_L": "CASE WHEN type = 'L' THEN 1.0 ELSE 0.0 END",
        "type_ohe_M": "CASE WHEN type = 'M' THEN 1.0 ELSE 0.0 END",
        "air_temp_k_scaled": "air_temp_k", "process_temp_k_scaled": "process_temp_k",
        "rpm_scaled": "rpm", "torque_nm_scaled": "torque_nm", "tool_wear_min_scaled": "tool_wear_min",
        "temp_diff_scaled": "process_temp_k - air_temp_k",
        "power_w_scaled": power,
        "tool_wear_rate_scaled": f"tool_wear_min / ({power} + 1)",
        "torque_per_rpm_scaled": "torque_nm / (rpm + 1)",
        "tool_wear_torque_scaled": "tool_wear_min * torque_nm",
        "temp_efficiency_scaled": "air_temp_k / (process_temp_k + 1)",
        "critical_operation_scaled": f"CAST(process_temp_k - air_temp_k < 8.6 AS INT) * CAST({power} < 3500 AS INT)"
        f" + CAST({power} > 9000 AS INT) + CAST(tool_wear_min > 200 AS INT)",
        "air_temp_k_process_temp_k_interaction_scaled": "air_temp_k * process_temp_k",
        "rpm_torque_nm_interaction_scaled": "rpm * torque_nm",
        "tool_wear_min_torque_nm_interaction_scaled": "tool_wear_min * torque_nm",
        "tool_wear_min_rpm_interaction_scaled": "tool_wear_min * rpm",
    }
    stacked = " UNION ALL ".join(
        f"SELECT '{n}' AS feature, CAST({e} AS DOUBLE) AS x, machine_failure AS y FROM f" for n, e in exprs.items()
    )
    return with_base(f""", st AS ({stacked}),
g AS (SELECT feature, y, count(*) AS ng, avg(x) AS mg, sum(x * x) AS s2 FROM st GROUP BY feature, y),
a AS (SELECT feature, sum(ng) AS n, sum(ng * mg) / sum(ng) AS m, count(*) AS k,
             sum(ng * mg * mg) AS sb2, sum(s2) AS ss FROM g GROUP BY feature),
fv AS (SELECT feature, ((sb2 - n * m * m) / (k - 1)) / ((ss - sb2) / (n - k)) AS fval FROM a)
SELECT feature FROM fv ORDER BY fval DESC, feature LIMIT 5""")


def cross_fitted_machine(spark, sf_dir):
    """Each machine's failure rate over the other folds, as a code."""
    df = rules.label_failures(machine_readings(spark, sf_dir))
    out = prep.cross_fitted_target(df, S.MACHINE_ID, "machine_failure", "machine_code")
    return out.select(S.UID, S.MACHINE_ID, F.round("machine_code", 9).alias("machine_code"))


CROSS_FITTED_SQL = with_base(""", x AS (
SELECT uid, machine_id, machine_failure AS y, CAST('0x' || substr(md5(concat(CAST(uid AS VARCHAR), '42')), 1, 7) AS BIGINT) % 5 AS fold FROM f
), c AS (
SELECT a.machine_id, k.fold, count(*) FILTER (a.fold <> k.fold) AS n, coalesce(sum(a.y) FILTER (a.fold <> k.fold), 0) AS s
FROM x AS a, range(5) AS k(fold) GROUP BY ALL
), m AS (
SELECT k.fold, avg(a.y) AS mean FROM x AS a, range(5) AS k(fold) WHERE a.fold <> k.fold GROUP BY k.fold
)
SELECT uid, machine_id, round((s + 10 * mean) / (n + 10), 9) AS machine_code FROM x JOIN c USING (machine_id, fold) JOIN m USING (fold)""")


def chi2_scores(spark, sf_dir):
    """C4: chi-squared of the sensors against the failure label."""
    out = SEL.chi_squared(rules.label_failures(machine_readings(spark, sf_dir)), list(S.SENSORS), "machine_failure")
    return out.select("feature", F.round("chi2", 4).alias("chi2"))


CHI2_SQL = with_base(", l AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, machine_failure AS y FROM f" for c in S.SENSORS) + """), o AS (
SELECT feature, y, sum(x) AS seen, count(*) AS n FROM l GROUP BY feature, y
), dues AS (
SELECT *, n / sum(n) OVER (PARTITION BY feature) * sum(seen) OVER (PARTITION BY feature) AS due FROM o
)
SELECT feature, round(sum((seen - due) * (seen - due) / due), 4) AS chi2 FROM dues GROUP BY feature""")


def eliminated_features(spark, sf_dir):
    """C4 'rfe': slots eliminated on boosted trees' importance, five at a time;
    five stay."""
    df = rules.label_failures(machine_readings(spark, sf_dir))
    prepared = Pipeline(stages=TR.base_stages(TR.TrainOptions())).fit(df).transform(df)
    return SEL.tree_elimination(prepared, "machine_failure", n=5, step=5)


QUERIES = {
    "eliminated_features": (eliminated_features, None),
    "cross_fitted_machine": (cross_fitted_machine, CROSS_FITTED_SQL),
    "chi2_scores": (chi2_scores, CHI2_SQL),
    "robust_scaled": (robust_scaled, _robust_sql()),
    "imputed_mode": (imputed_mode, IMPUTED_MODE_SQL),
    "encoded_type": (encoded_type, ENCODED_TYPE_SQL),
    "selected_features": (selected_features, _selected_sql()),
}
