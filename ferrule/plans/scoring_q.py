"""Registered queries: scoring (A1-A14), batch summary (B1-B7), monitoring
(N2-N6) with the fixed linear scorer standing in for a trained model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule import schema as S
from ferrule.operators import scoring as SC
from ferrule.operators import summary as SU
from ferrule.plans.sqltext import RECOMMENDATION_SQL, with_attribution, with_base
from ferrule.sources.readings import machine_readings


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.attribute(SC.with_linear_score(machine_readings(spark, sf_dir)))


def score_linear(spark, sf_dir):
    df = SC.with_linear_score(machine_readings(spark, sf_dir))
    return df.select(S.UID, "p", F.col("p").alias("failure_probability"),
                     (F.col("p") > 0.5).cast("int").alias("machine_failure_pred"))


SCORE_LINEAR_SQL = with_attribution(
    "SELECT uid, p, p AS failure_probability, machine_failure_pred FROM a"
)


def failure_attribution(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        S.UID, "prob_twf", "prob_hdf", "prob_pwf", "prob_osf", "prob_rnf", "most_likely_type",
        F.round(F.col("prob_twf") + F.col("prob_hdf") + F.col("prob_pwf") + F.col("prob_osf")
                + F.col("prob_rnf") - F.col("p"), 9).alias("sum_minus_p"),
    )


FAILURE_ATTRIBUTION_SQL = with_attribution(
    """SELECT uid, prob_twf, prob_hdf, prob_pwf, prob_osf, prob_rnf, most_likely_type,
       round(prob_twf + prob_hdf + prob_pwf + prob_osf + prob_rnf - p, 9) AS sum_minus_p
FROM a"""
)


def recommendations(spark, sf_dir):
    return _scored(spark, sf_dir).select(S.UID, "p", "most_likely_type", "maintenance_recommendation")


RECOMMENDATIONS_SQL = with_attribution(
    f"SELECT uid, p, most_likely_type, {RECOMMENDATION_SQL} AS maintenance_recommendation FROM a"
)


def risk_bands(spark, sf_dir):
    return SC.display_bands(_scored(spark, sf_dir)).select(
        S.UID, "risk_band", "bar_twf", "bar_hdf", "bar_pwf", "bar_osf", "bar_rnf"
    )


def _bar_sql(c: str) -> str:
    return f"CASE WHEN {c} > 0.3 THEN 'red' WHEN {c} > 0.1 THEN 'amber' ELSE 'green' END"


RISK_BANDS_SQL = with_attribution(
    f"""SELECT uid,
       CASE WHEN p >= 0.7 THEN 'high' WHEN p >= 0.3 THEN 'medium' ELSE 'low' END AS risk_band,
       {_bar_sql('prob_twf')} AS bar_twf, {_bar_sql('prob_hdf')} AS bar_hdf,
       {_bar_sql('prob_pwf')} AS bar_pwf, {_bar_sql('prob_osf')} AS bar_osf,
       {_bar_sql('prob_rnf')} AS bar_rnf
FROM a"""
)


def types_ranked(spark, sf_dir):
    return SC.ranked_types(_scored(spark, sf_dir))


TYPES_RANKED_SQL = with_attribution(
    """, u AS (
SELECT uid, 'TWF' AS failure_type, 0 AS ord, prob_twf AS prob FROM a
UNION ALL SELECT uid, 'HDF', 1, prob_hdf FROM a
UNION ALL SELECT uid, 'PWF', 2, prob_pwf FROM a
UNION ALL SELECT uid, 'OSF', 3, prob_osf FROM a
UNION ALL SELECT uid, 'RNF', 4, prob_rnf FROM a
)
SELECT uid, CAST(row_number() OVER (PARTITION BY uid ORDER BY prob DESC, ord) AS INT) AS rank,
       failure_type, prob
FROM u"""
)


def batch_summary(spark, sf_dir):
    return SU.batch_summary(_scored(spark, sf_dir))


BATCH_SUMMARY_SQL = with_attribution(
    """, t AS (
SELECT most_likely_type, count(*) AS n, min(uid) AS first_uid
FROM a WHERE machine_failure_pred = 1 GROUP BY most_likely_type
)
SELECT count(*) AS total_machines,
       CAST(coalesce(sum(machine_failure_pred), 0) AS BIGINT) AS failure_count,
       round(coalesce(sum(machine_failure_pred) / count(*), 0), 6) AS failure_rate,
       round(coalesce(avg(p), 0), 6) AS average_failure_probability,
       (SELECT most_likely_type FROM t ORDER BY n DESC, first_uid LIMIT 1) AS most_common_failure_type
FROM a"""
)


def result_table(spark, sf_dir):
    return SU.result_table(_scored(spark, sf_dir))


RESULT_TABLE_SQL = with_attribution(
    """SELECT uid AS machine, type AS machine_type,
       printf('%.1f', air_temp_k) AS air_temp, printf('%.1f', process_temp_k) AS process_temp,
       printf('%.0f', rpm) AS speed, printf('%.1f', torque_nm) AS torque, printf('%.0f', tool_wear_min) AS tool_wear,
       CASE WHEN machine_failure_pred = 1 THEN 'Yes' ELSE 'No' END AS failure,
       printf('%.1f', p * 100) || '%' AS probability,
       CASE WHEN machine_failure_pred = 1 THEN most_likely_type ELSE 'N/A' END AS most_likely_failure,
       p AS probability_value, machine_failure_pred AS is_failure
FROM a"""
)


def monitor_stats(spark, sf_dir):
    return SU.monitor_stats(_scored(spark, sf_dir))


MONITOR_STATS_SQL = with_attribution(
    """, k AS (
SELECT *, row_number() OVER (ORDER BY ts DESC, uid DESC) AS rk FROM a
), kept AS (SELECT * FROM k WHERE rk <= 1000)
SELECT count(*) AS total_predictions,
       CAST(coalesce(sum(machine_failure_pred), 0) AS BIGINT) AS failure_predictions,
       round(coalesce(avg(machine_failure_pred), 0), 6) AS failure_rate,
       round(coalesce(avg(p), 0), 6) AS average_failure_probability,
       round(coalesce(avg(CASE WHEN rk <= 100 THEN machine_failure_pred END), 0), 6) AS recent_failure_rate,
       CASE WHEN coalesce(avg(machine_failure_pred), 0) > 0.3 THEN 'high' ELSE 'low' END AS failure_rate_band
FROM kept"""
)


def monitor_type_dist(spark, sf_dir):
    return SU.monitor_type_distribution(_scored(spark, sf_dir))


MONITOR_TYPE_DIST_SQL = with_attribution(
    """, kept AS (SELECT * FROM a ORDER BY ts DESC, uid DESC LIMIT 1000)
SELECT most_likely_type AS failure_type, count(*) AS n_failures
FROM kept WHERE machine_failure_pred = 1 GROUP BY most_likely_type"""
)


def failure_type_counts(spark, sf_dir):
    return SU.failure_type_counts(_scored(spark, sf_dir))


FAILURE_TYPE_COUNTS_SQL = with_attribution(
    """SELECT most_likely_type AS failure_type, count(*) AS n_failures
FROM a WHERE machine_failure_pred = 1 GROUP BY most_likely_type"""
)


def dense_row_numbers(spark, sf_dir):
    """1..n over all readings, by torque and then id."""
    df = machine_readings(spark, sf_dir).select(S.UID, S.TORQUE)
    return SU.dense_row_number(df, S.TORQUE, ties=[S.UID]).select(S.UID, "row_no")


DENSE_ROW_NUMBERS_SQL = with_base("SELECT uid, row_number() OVER (ORDER BY torque_nm NULLS FIRST, uid) AS row_no FROM r")


QUERIES = {
    "dense_row_numbers": (dense_row_numbers, DENSE_ROW_NUMBERS_SQL),
    "score_linear": (score_linear, SCORE_LINEAR_SQL),
    "failure_attribution": (failure_attribution, FAILURE_ATTRIBUTION_SQL),
    "recommendations": (recommendations, RECOMMENDATIONS_SQL),
    "risk_bands": (risk_bands, RISK_BANDS_SQL),
    "types_ranked": (types_ranked, TYPES_RANKED_SQL),
    "batch_summary": (batch_summary, BATCH_SUMMARY_SQL),
    "failure_type_counts": (failure_type_counts, FAILURE_TYPE_COUNTS_SQL),
    "result_table": (result_table, RESULT_TABLE_SQL),
    "monitor_stats": (monitor_stats, MONITOR_STATS_SQL),
    "monitor_type_dist": (monitor_type_dist, MONITOR_TYPE_DIST_SQL),
}
