"""Batch scoring (A1-A11): model probability -> attribution -> recommendation.

One ``score`` function serves the single, batch and streaming paths; every
step is a column expression, so a scored batch is one narrow projection.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule import schema as S
from ferrule.functions import rules, scoring


def with_linear_score(df: DataFrame, p: str = "p") -> DataFrame:
    """Fixed linear scorer (A1 for a linear model written as an expression)."""
    return df.select("*", scoring.linear_score().alias(p))


def evaluation_frame(readings: DataFrame, signed_hdf: bool = False) -> DataFrame:
    """Rows of (keys, sensors, y, pred, p): rule label + fixed scorer."""
    flags = rules.failure_flag_columns(signed_hdf)
    p = scoring.linear_score()
    return readings.select(
        S.UID,
        S.MACHINE_ID,
        S.TS,
        S.TYPE,
        *S.SENSORS,
        flags["machine_failure"].alias("y"),
        scoring.decide(p).alias("pred"),
        p.alias("p"),
    )


def model_probability(scored: DataFrame, out: str = "p", prob_col: str = "probability",
                      pred_col: str = "prediction", positive_index: int = 1) -> DataFrame:
    """A1/A2 for a fitted Spark ML model's output: positive-class probability,
    or the hard label as 0.0/1.0 when the model has no probability column."""
    if prob_col in scored.columns:
        prob = vector_to_array(F.col(prob_col))[positive_index]
    else:
        prob = F.lit(None).cast("double")
    return scored.withColumn(out, scoring.probability_or_label(prob, F.col(pred_col)))


def attribute(df: DataFrame, p: str = "p", threshold: float = 0.5) -> DataFrame:
    """A3-A10 on a frame holding sensors and a probability column."""
    attr = scoring.attribution_columns(p)
    out = df.select("*", *[c.alias(n) for n, c in attr.items()])
    return out.select(
        "*",
        scoring.decide(F.col(p), threshold).alias("machine_failure_pred"),
        scoring.most_likely_type().alias("most_likely_type"),
    ).withColumn("maintenance_recommendation", scoring.recommendation(p))


def score(df: DataFrame, p: str = "p", threshold: float = 0.5, ts_col: str | None = S.TS) -> DataFrame:
    """Response rows (FIXTURES §4 'Scored row') plus the flat columns used by
    summaries.  ``prediction_time`` comes from the input, not the clock, so a
    re-run gives the same rows."""
    out = attribute(df, p, threshold)
    ts = F.col(ts_col).cast("timestamp") if ts_col and ts_col in df.columns else F.current_timestamp()
    return out.select(
        "*",
        (F.col("machine_failure_pred") == 1).alias("machine_failure"),
        F.col(p).alias("failure_probability"),
        ts.alias("prediction_time"),
        scoring.type_map().alias("failure_type"),
    )


def prediction_record(scored: DataFrame) -> DataFrame:
    """{input, output, timestamp} history rows."""
    return scored.select(
        F.struct(S.UID, S.TYPE, *S.SENSORS).alias("input"),
        F.struct(
            "machine_failure",
            "failure_probability",
            "failure_type",
            "maintenance_recommendation",
            "most_likely_type",
        ).alias("output"),
        F.col("prediction_time").alias("timestamp"),
    )


def display_bands(scored: DataFrame, p: str = "p") -> DataFrame:
    """A12/A13 columns."""
    return scored.select(
        "*",
        scoring.risk_band(p).alias("risk_band"),
        *[
            scoring.bar_band(F.col(f"prob_{k.lower()}")).alias(f"bar_{k.lower()}")
            for k in S.FAILURE_TYPES
        ],
    )


def ranked_types(scored: DataFrame, explode: bool = True) -> DataFrame:
    """(uid, rank, type, prob), highest first; sorting happens inside
    each row, so no shuffle."""
    ranked = scored.select(S.UID, scoring.ranked_types().alias("ranked"))
    if not explode:
        return ranked
    # posexplode_outer: the array always has five items, and the outer form
    # keeps the optimizer from adding a size() filter that rebuilds the array
    return ranked.select(S.UID, F.posexplode_outer("ranked").alias("pos", "item")).select(
        S.UID,
        (F.col("pos") + 1).alias("rank"),
        F.col("item.type").alias("failure_type"),
        (F.lit(0.0) - F.col("item.neg")).alias("prob"),
    )


def rule_label(readings: DataFrame, signed_hdf: bool = False) -> DataFrame:
    return rules.label_failures(readings, signed_hdf)
