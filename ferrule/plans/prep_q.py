"""Registered queries: preparation."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule import schema as S
from ferrule.functions import rules
from ferrule.ml.stages import preparation_stages
from ferrule.operators import prep
from ferrule.plans.sqltext import with_base
from ferrule.sources.readings import machine_readings

_HASH_SQL = "md5(CAST(uid AS VARCHAR) || '42')"


def _labelled(spark, sf_dir) -> DataFrame:
    return rules.label_failures(machine_readings(spark, sf_dir))


def hash_split(spark, sf_dir):
    df = prep.hash_split(_labelled(spark, sf_dir))
    df = prep.hash_split(df, (0.8, 0.2), ("train", "test"), out="split2")
    return df.select(S.UID, "machine_failure", "split", "split2")


HASH_SPLIT_SQL = with_base(
    f"""SELECT uid, machine_failure,
       CASE WHEN substr({_HASH_SQL}, 1, 4) < 'b333' THEN 'train'
            WHEN substr({_HASH_SQL}, 1, 4) < 'd999' THEN 'validation' ELSE 'test' END AS split,
       CASE WHEN substr({_HASH_SQL}, 1, 4) < 'cccc' THEN 'train' ELSE 'test' END AS split2
FROM f"""
)


def sensor_profile(spark, sf_dir):
    """Rows per split and class with subtotals (one rollup)."""
    df = prep.hash_split(_labelled(spark, sf_dir))
    g = df.rollup("split", "machine_failure").agg(F.count(F.lit(1)).alias("n_rows"))
    return g.select(F.coalesce("split", F.lit("all")).alias("split"), "machine_failure", "n_rows",
                    F.lit(len(S.SENSORS) + 1).alias("n_features"))


SENSOR_PROFILE_SQL = with_base(
    f""", sp AS (
SELECT *, CASE WHEN substr({_HASH_SQL}, 1, 4) < 'b333' THEN 'train'
               WHEN substr({_HASH_SQL}, 1, 4) < 'd999' THEN 'validation' ELSE 'test' END AS split
FROM f
)
SELECT coalesce(split, 'all') AS split, machine_failure, count(*) AS n_rows, 6 AS n_features
FROM sp GROUP BY ROLLUP (split, machine_failure)"""
)


def exact_stratified_split(spark, sf_dir):
    df = prep.exact_stratified_split(_labelled(spark, sf_dir), "machine_failure")
    return df.select(S.UID, "machine_failure", "split")


EXACT_SPLIT_SQL = with_base(
    f""", rk AS (
SELECT uid, machine_failure,
       row_number() OVER (PARTITION BY machine_failure ORDER BY {_HASH_SQL}, uid) AS rn,
       count(*) OVER (PARTITION BY machine_failure) AS nc
FROM f
)
SELECT uid, machine_failure,
       CASE WHEN rn * 100 <= nc * 70 THEN 'train' WHEN rn * 100 <= nc * 85 THEN 'validation' ELSE 'test' END AS split
FROM rk"""
)


def stratified_folds(spark, sf_dir):
    df = prep.stratified_folds(_labelled(spark, sf_dir), "machine_failure", k=3)
    return df.select(S.UID, "machine_failure", "fold")


STRATIFIED_FOLDS_SQL = with_base(
    f""", rk AS (
SELECT uid, machine_failure,
       row_number() OVER (PARTITION BY machine_failure ORDER BY {_HASH_SQL}, uid) AS rn
FROM f
)
SELECT uid, machine_failure, CAST((rn - 1) % 3 AS INT) AS fold FROM rk"""
)


def balanced_weights(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    return df.select(
        S.UID, "machine_failure",
        F.round(prep.balanced_weight(df, "machine_failure"), 6).alias("balanced_weight"),
        prep.positive_weight("machine_failure", 3.0).alias("pos_weight"),
    )


BALANCED_WEIGHTS_SQL = with_base(
    """, cc AS (SELECT machine_failure, count(*) AS nc FROM f GROUP BY machine_failure),
tot AS (SELECT sum(nc) AS n, count(*) AS k FROM cc)
SELECT f.uid, f.machine_failure,
       round(CAST(tot.n AS DOUBLE) / (tot.k * cc.nc), 6) AS balanced_weight,
       CASE WHEN f.machine_failure = 1 THEN 3.0 ELSE 1.0 END::DOUBLE AS pos_weight
FROM f JOIN cc USING (machine_failure), tot"""
)


def onehot_scaled(spark, sf_dir):
    """Fitted preparation stages; vector unpacked to named columns."""
    df = _labelled(spark, sf_dir)
    model = Pipeline(stages=preparation_stages(S.SENSORS)).fit(df)
    out = model.transform(df).select(S.UID, vector_to_array("features").alias("v"))
    names = ["type_h", "type_l", "type_m"] + [f"{c}_scaled" for c in S.SENSORS]
    return out.select(
        S.UID,
        *[(F.col("v")[i] if i < 3 else F.round(F.col("v")[i], 6)).alias(n) for i, n in enumerate(names)],
    )


def _onehot_sql() -> str:
    scaled = ",\n       ".join(
        f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 6) AS {c}_scaled"
        for c in S.SENSORS
    )
    return with_base(
        f"""SELECT uid,
       CASE WHEN type = 'H' THEN 1.0 ELSE 0.0 END::DOUBLE AS type_h,
       CASE WHEN type = 'L' THEN 1.0 ELSE 0.0 END::DOUBLE AS type_l,
       CASE WHEN type = 'M' THEN 1.0 ELSE 0.0 END::DOUBLE AS type_m,
       {scaled}
FROM f"""
    )


def class_switch(spark, sf_dir):
    """M8: number of distinct labels decides binary vs multiclass output."""
    df = _labelled(spark, sf_dir)
    return df.agg(F.countDistinct("machine_failure").alias("n_classes")).select(
        "n_classes", (F.col("n_classes") == 2).cast("int").alias("is_binary")
    )


CLASS_SWITCH_SQL = with_base(
    """SELECT count(DISTINCT machine_failure) AS n_classes,
       CASE WHEN count(DISTINCT machine_failure) = 2 THEN 1 ELSE 0 END AS is_binary FROM f"""
)


QUERIES = {
    "hash_split": (hash_split, HASH_SPLIT_SQL),
    "sensor_profile": (sensor_profile, SENSOR_PROFILE_SQL),
    "exact_stratified_split": (exact_stratified_split, EXACT_SPLIT_SQL),
    "stratified_folds": (stratified_folds, STRATIFIED_FOLDS_SQL),
    "balanced_weights": (balanced_weights, BALANCED_WEIGHTS_SQL),
    "onehot_scaled": (onehot_scaled, _onehot_sql()),
    "class_switch": (class_switch, CLASS_SWITCH_SQL),
}
