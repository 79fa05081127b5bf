"""Registered queries: features (F), failure rules (L), joins (J), schema work (P)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule import schema as S
from ferrule.functions import features as FE
from ferrule.functions import rules, scoring
from ferrule.operators import quality
from ferrule.plans.sqltext import POWER_SQL, RAW_CTE, with_base
from ferrule.session import scratch_path
from ferrule.sources import io
from ferrule.sources.readings import machine_readings, raw_readings


def failures_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: readings -> F1-F7 -> L1-L6 -> rates per machine type."""
    df = rules.label_failures(FE.with_columns(machine_readings(spark, sf_dir), FE.domain_columns()))
    return df.groupBy(S.TYPE).agg(
        F.count(F.lit(1)).alias("n_readings"),
        F.sum("twf").cast("long").alias("n_twf"),
        F.sum("hdf").cast("long").alias("n_hdf"),
        F.sum("pwf").cast("long").alias("n_pwf"),
        F.sum("osf").cast("long").alias("n_osf"),
        F.sum("rnf").cast("long").alias("n_rnf"),
        F.sum("machine_failure").cast("long").alias("n_failures"),
        F.round(F.avg("machine_failure"), 6).alias("failure_rate"),
        F.round(F.avg("power_w"), 6).alias("avg_power_w"),
        F.round(F.avg("temp_diff"), 6).alias("avg_temp_diff"),
    )


FAILURES_BY_TYPE_SQL = with_base(
    f"""SELECT type,
       count(*) AS n_readings,
       CAST(sum(twf) AS BIGINT) AS n_twf, CAST(sum(hdf) AS BIGINT) AS n_hdf,
       CAST(sum(pwf) AS BIGINT) AS n_pwf, CAST(sum(osf) AS BIGINT) AS n_osf,
       CAST(sum(rnf) AS BIGINT) AS n_rnf,
       CAST(sum(machine_failure) AS BIGINT) AS n_failures,
       round(avg(machine_failure), 6) AS failure_rate,
       round(avg({POWER_SQL}), 6) AS avg_power_w,
       round(avg(process_temp_k - air_temp_k), 6) AS avg_temp_diff
FROM f GROUP BY type"""
)


def domain_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = machine_readings(spark, sf_dir)
    cols = FE.domain_columns()
    return df.select(
        S.UID,
        *[c.alias(n) for n, c in cols.items()],
        FE.tool_wear_frac().alias("tool_wear_frac"),
    )


DOMAIN_FEATURES_SQL = with_base(
    f"""SELECT uid,
       process_temp_k - air_temp_k AS temp_diff,
       {POWER_SQL} AS power_w,
       tool_wear_min / ({POWER_SQL} + CAST(1 AS DOUBLE)) AS tool_wear_rate,
       torque_nm / (rpm + CAST(1 AS DOUBLE)) AS torque_per_rpm,
       tool_wear_min * torque_nm AS tool_wear_torque,
       air_temp_k / (process_temp_k + CAST(1 AS DOUBLE)) AS temp_efficiency,
       CAST(process_temp_k - air_temp_k < 8.6 AS INT) * CAST({POWER_SQL} < 3500 AS INT)
         + CAST({POWER_SQL} > 9000 AS INT) + CAST(tool_wear_min > 200 AS INT) AS critical_operation,
       tool_wear_min / CAST(250 AS DOUBLE) AS tool_wear_frac
FROM r"""
)


def interaction_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = machine_readings(spark, sf_dir)
    cols = FE.interaction_columns(df.columns)
    return df.select(S.UID, *[c.alias(n) for n, c in cols.items()])


INTERACTION_FEATURES_SQL = with_base(
    """SELECT uid,
       air_temp_k * process_temp_k AS air_temp_k_process_temp_k_interaction,
       rpm * torque_nm AS rpm_torque_nm_interaction,
       tool_wear_min * torque_nm AS tool_wear_min_torque_nm_interaction,
       tool_wear_min * rpm AS tool_wear_min_rpm_interaction
FROM r"""
)

POLY_INPUTS = S.SENSORS + ["temp_diff", "power_w", "tool_wear_torque"]


def _domain_sql_cols() -> dict[str, str]:
    return {
        S.AIR: S.AIR,
        S.PROCESS: S.PROCESS,
        S.RPM: S.RPM,
        S.TORQUE: S.TORQUE,
        S.WEAR: S.WEAR,
        "temp_diff": "(process_temp_k - air_temp_k)",
        "power_w": POWER_SQL,
        "tool_wear_torque": "(tool_wear_min * torque_nm)",
    }


def polynomial_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10 over the five sensors and three domain features (8 inputs -> 36
    degree-2 terms)."""
    df = FE.with_columns(machine_readings(spark, sf_dir), FE.domain_columns())
    cols = FE.polynomial_columns(POLY_INPUTS, 2)
    return df.select(S.UID, *[c.alias(n) for n, c in cols.items()])


def _polynomial_sql() -> str:
    src = _domain_sql_cols()
    parts = []
    for i, a in enumerate(POLY_INPUTS):
        for b in POLY_INPUTS[i:]:
            name = f"{a}^2" if a == b else f"{a} {b}"
            parts.append(f'CAST({src[a]} AS DOUBLE) * CAST({src[b]} AS DOUBLE) AS "{name}"')
    return with_base("SELECT uid,\n       " + ",\n       ".join(parts) + "\nFROM r")


POWER_INPUTS = S.SENSORS + ["temp_diff", "power_w"]


def power_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = FE.with_columns(machine_readings(spark, sf_dir), FE.domain_columns())
    cols = FE.power_columns(POWER_INPUTS)
    return df.select(S.UID, *[c.alias(n) for n, c in cols.items()])


def _power_sql() -> str:
    src = _domain_sql_cols()
    parts = []
    for c in POWER_INPUTS:
        x = f"CAST({src[c]} AS DOUBLE)"
        parts.append(f"{x} * {x} AS {c}_squared")
        parts.append(f"{x} * {x} * {x} AS {c}_cubed")
        parts.append(f"sqrt(abs({x})) AS {c}_sqrt")
    return with_base("SELECT uid,\n       " + ",\n       ".join(parts) + "\nFROM r")


def failure_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1-L6 with J2 (unknown type -> no overstrain) and both HDF forms."""
    df = machine_readings(spark, sf_dir)
    flags = rules.failure_flag_columns(signed_hdf=False)
    return df.select(
        S.UID,
        S.TYPE,
        *[c.alias(n) for n, c in flags.items()],
        rules.hdf(signed=True).cast("int").alias("hdf_signed"),
        rules.osf_threshold(S.TYPE).alias("osf_threshold"),
    )


FAILURE_RULES_SQL = with_base(
    f"""SELECT uid, type, twf, hdf, pwf, osf, rnf, machine_failure,
       CASE WHEN process_temp_k - air_temp_k < 8.6 AND rpm < 1380 THEN 1 ELSE 0 END AS hdf_signed,
       CASE type WHEN 'L' THEN CAST(11000 AS DOUBLE) WHEN 'M' THEN CAST(12000 AS DOUBLE)
            WHEN 'H' THEN CAST(13000 AS DOUBLE) END AS osf_threshold
FROM f"""
)


def _failure_type_query(order: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = rules.label_failures(machine_readings(spark, sf_dir))
        return df.select(S.UID, rules.failure_type(order).alias("failure_type"), "machine_failure")

    return q


def _failure_type_sql(order: str) -> str:
    names = [("twf", "TWF"), ("hdf", "HDF"), ("pwf", "PWF"), ("osf", "OSF"), ("rnf", "RNF")]
    if order == "last":
        names = names[::-1]
    whens = " ".join(f"WHEN {c} = 1 THEN '{n}'" for c, n in names)
    return with_base(
        f"SELECT uid, CASE {whens} ELSE 'No Failure' END AS failure_type, machine_failure FROM f"
    )


def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per label and per failure type (first-priority naming)."""
    df = rules.label_failures(machine_readings(spark, sf_dir))
    return (
        df.groupBy("machine_failure", rules.failure_type("first").alias("failure_type"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


CLASS_COUNTS_SQL = with_base(
    """SELECT machine_failure,
       CASE WHEN twf = 1 THEN 'TWF' WHEN hdf = 1 THEN 'HDF' WHEN pwf = 1 THEN 'PWF'
            WHEN osf = 1 THEN 'OSF' WHEN rnf = 1 THEN 'RNF' ELSE 'No Failure' END AS failure_type,
       count(*) AS n_rows
FROM f GROUP BY 1, 2"""
)


def features_targets_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature table and a target table bound by key.  Both sides are
    derived from the same readings and hash-partitioned on uid by the join;
    AQE keeps it a sort-merge join on equal partitioning."""
    readings = machine_readings(spark, sf_dir)
    feats = readings.select(S.UID, S.TYPE, *S.SENSORS)
    targets = rules.label_failures(readings).select(S.UID, "machine_failure", "twf", "osf")
    joined = feats.join(targets, S.UID, "inner")
    return joined.drop("twf", "osf", "not_there")  # P1: absent names are ignored


def features_targets_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two tables written in buckets of the key, and bound without a
    shuffle."""
    readings = machine_readings(spark, sf_dir)
    base = scratch_path(spark, f"bound-{uuid.uuid4().hex}")
    io.write_bucketed(readings.select(S.UID, S.TYPE, *S.SENSORS), f"{base}/features", buckets=16)
    io.write_bucketed(rules.label_failures(readings).select(S.UID, "machine_failure"), f"{base}/targets", buckets=16)
    return io.bind_bucketed(spark, f"{base}/features", f"{base}/targets")


FEATURES_TARGETS_SQL = with_base(
    """SELECT r.uid, r.type, r.air_temp_k, r.process_temp_k, r.rpm, r.torque_nm, r.tool_wear_min,
       f.machine_failure
FROM r JOIN f ON r.uid = f.uid"""
)


def valid_and_bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw request rows renamed, cast with try_cast, bad rows counted
    by reason; returns one row per reason plus the valid count."""
    return quality.validation_summary(quality.validate_requests(raw_readings(spark, sf_dir)))


VALID_AND_BAD_SQL = f"""WITH {RAW_CTE},
c AS (
SELECT uid, machine_type AS type,
       TRY_CAST(air_temperature AS DOUBLE) AS air_temp_k,
       TRY_CAST(process_temperature AS DOUBLE) AS process_temp_k,
       TRY_CAST(rotational_speed AS DOUBLE) AS rpm,
       TRY_CAST(torque AS DOUBLE) AS torque_nm,
       TRY_CAST(tool_wear AS DOUBLE) AS tool_wear_min,
       rotational_speed IS NOT NULL AND TRY_CAST(rotational_speed AS DOUBLE) IS NULL AS bad_cast,
       torque IS NULL AS missing
FROM raw
),
k AS (
SELECT *,
       CASE WHEN missing THEN 'missing_value'
            WHEN bad_cast THEN 'not_a_number'
            WHEN type IS NULL OR type NOT IN ('L', 'M', 'H') THEN 'unknown_type'
            ELSE 'valid' END AS status
FROM c
)
SELECT status, count(*) AS n_rows, round(avg(tool_wear_min), 6) AS avg_tool_wear
FROM k GROUP BY status"""


def unknown_machine_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, J3, A6 where the type is unknown or null: the rule is false without
    a default, the default threshold decides with one, and scores sum to p."""
    odd = F.when(F.col(S.UID) % 5 == 1, F.lit("X")).when(F.col(S.UID) % 5 != 3, F.col(S.TYPE))
    df = machine_readings(spark, sf_dir).withColumn(S.TYPE, odd)
    parts = scoring.raw_type_scores()
    return df.select(
        S.UID, S.TYPE,
        rules.osf_threshold().alias("threshold"), rules.osf_threshold(default=S.OSF_DEFAULT_THRESHOLD).alias("threshold_or_default"),
        rules.osf().cast("int").alias("osf"), rules.osf(S.OSF_DEFAULT_THRESHOLD).cast("int").alias("osf_or_default"),
        parts["OSF"].alias("osf_score"),
    )


_ODD_TYPES_SQL = with_base("""SELECT uid, type, t AS threshold, coalesce(t, 12000) AS threshold_or_default,
       CASE WHEN tool_wear_min * torque_nm > t THEN 1 ELSE 0 END AS osf,
       CASE WHEN tool_wear_min * torque_nm > coalesce(t, 12000) THEN 1 ELSE 0 END AS osf_or_default,
       CAST(CASE WHEN tool_wear_min * torque_nm > coalesce(t, 12000) THEN 0.8 ELSE 0.2 END AS DOUBLE) AS osf_score
FROM (SELECT *, CASE type WHEN 'L' THEN CAST(11000 AS DOUBLE) WHEN 'M' THEN CAST(12000 AS DOUBLE) WHEN 'H' THEN CAST(13000 AS DOUBLE) END AS t
      FROM (SELECT * REPLACE (CASE WHEN uid % 5 = 1 THEN 'X' WHEN uid % 5 <> 3 THEN type END AS type) FROM r))""")


def request_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw requests as JSON documents of 16 readings, every 17th cut
    short, written and read back: rows or documents by reason, good ones too."""
    raw = raw_readings(spark, sf_dir)
    docs = raw.groupBy(F.floor(F.col(S.UID) / 16).alias("doc")).agg(F.collect_list(F.struct("*")).alias("machines"))
    text = F.to_json(F.struct("machines"))
    cut = F.when(F.col("doc") % 17 == 0, F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text)
    path = scratch_path(spark, f"requests-{uuid.uuid4().hex}")
    docs.select(cut.alias("value")).write.text(path)
    good, dead = io.read_request_documents(spark, path)
    every = dead.select("reason", "request").unionByName(good.select(F.lit("valid").alias("reason"), "request"))
    return every.groupBy("reason").agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("request").alias("n_requests"))


REQUEST_DEAD_LETTERS_SQL = f"""WITH {RAW_CTE},
k AS (
SELECT uid // 16 AS doc,
       CASE WHEN torque IS NULL OR rotational_speed IS NULL OR air_temperature IS NULL OR process_temperature IS NULL OR tool_wear IS NULL THEN 'missing_value'
            WHEN TRY_CAST(rotational_speed AS DOUBLE) IS NULL THEN 'not_a_number'
            WHEN machine_type IS NULL OR machine_type NOT IN ('L', 'M', 'H') THEN 'unknown_type'
            ELSE 'valid' END AS status
FROM raw
)
SELECT status AS reason, count(*) AS n_records, count(DISTINCT doc) AS n_requests FROM k WHERE doc % 17 <> 0 GROUP BY status
UNION ALL
SELECT 'not_json', count(DISTINCT doc), count(DISTINCT doc) FROM k WHERE doc % 17 = 0 HAVING count(*) > 0"""


QUERIES = {
    "request_dead_letters": (request_dead_letters, REQUEST_DEAD_LETTERS_SQL),
    "unknown_machine_types": (unknown_machine_types, _ODD_TYPES_SQL),
    "failures_by_type": (failures_by_type, FAILURES_BY_TYPE_SQL),
    "domain_features": (domain_features, DOMAIN_FEATURES_SQL),
    "interaction_features": (interaction_features, INTERACTION_FEATURES_SQL),
    "polynomial_features": (polynomial_features, _polynomial_sql()),
    "power_features": (power_features, _power_sql()),
    "failure_rules": (failure_rules, FAILURE_RULES_SQL),
    "failure_type_first": (_failure_type_query("first"), _failure_type_sql("first")),
    "failure_type_last": (_failure_type_query("last"), _failure_type_sql("last")),
    "class_counts": (class_counts, CLASS_COUNTS_SQL),
    "features_targets_joined": (features_targets_joined, FEATURES_TARGETS_SQL),
    "features_targets_bucketed": (features_targets_bucketed, FEATURES_TARGETS_SQL),
    "valid_and_bad_rows": (valid_and_bad_rows, VALID_AND_BAD_SQL),
}
