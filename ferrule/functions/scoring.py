"""Scoring expressions (A2-A14): failure-type attribution, recommendation and
display bands, all as column expressions over a scored row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrule import schema as S
from ferrule.functions.features import power_w, temp_diff
from ferrule.functions.rules import osf_threshold

# Fixed scorer standing in for a trained model in oracle-checked queries:
# a logistic model over centred sensors, rounded to 6 digits.  Written as SQL
# text so Spark and the DuckDB oracle evaluate the identical expression.
LINEAR_SCORE_SQL = (
    "ROUND(1 / (1 + EXP(-(CAST(-0.9 AS DOUBLE)"
    " + CAST(0.012 AS DOUBLE) * (tool_wear_min - 125)"
    " + CAST(0.05 AS DOUBLE) * (torque_nm - 40)"
    " - CAST(0.002 AS DOUBLE) * (rpm - 1500)"
    " - CAST(0.12 AS DOUBLE) * (process_temp_k - air_temp_k - 10)))), 6)"
)


def linear_score() -> Column:
    return F.expr(LINEAR_SCORE_SQL)


def decide(p: Column, threshold: float = 0.5) -> Column:
    """M9: strict ``p > t``."""
    return (p > F.lit(threshold)).cast("int")


def probability_or_label(p: Column, pred: Column) -> Column:
    """A2: models without probabilities score 0.0 / 1.0."""
    return F.coalesce(p, pred.cast("double"))


def raw_type_scores() -> dict[str, Column]:
    """Un-normalised heuristic scores per failure type."""
    wear_frac = F.col(S.WEAR) / F.lit(S.WEAR_NORMALISER)
    pw = power_w()
    return {
        "TWF": F.when(F.col(S.WEAR) > S.TWF_WEAR_LIMIT, F.least(F.lit(S.TWF_SCORE_MAX), wear_frac))
        .otherwise(F.greatest(F.lit(S.TWF_SCORE_MIN), wear_frac)),
        "HDF": F.when(
            (temp_diff() < S.HDF_TEMP_DIFF_LIMIT) & (F.col(S.RPM) < S.HDF_RPM_LIMIT),
            F.lit(S.HDF_SCORE_HIT),
        ).otherwise(F.lit(S.HDF_SCORE_MISS)),
        "PWF": F.when((pw < S.PWF_POWER_LOW) | (pw > S.PWF_POWER_HIGH), F.lit(S.PWF_SCORE_HIT))
        .otherwise(F.lit(S.PWF_SCORE_MISS)),
        "OSF": F.when(
            F.col(S.WEAR) * F.col(S.TORQUE) > osf_threshold(S.TYPE, S.OSF_DEFAULT_THRESHOLD),
            F.lit(S.OSF_SCORE_HIT),
        ).otherwise(F.lit(S.OSF_SCORE_MISS)),
        "RNF": F.lit(S.RNF_SCORE),
    }


def attribution_columns(p: str = "p", prefix: str = "prob_") -> dict[str, Column]:
    """score_k / sum(scores) * p, so the five values sum to p."""
    raw = raw_type_scores()
    total = raw["TWF"] + raw["HDF"] + raw["PWF"] + raw["OSF"] + raw["RNF"]
    return {f"{prefix}{k.lower()}": raw[k] / total * F.col(p) for k in S.FAILURE_TYPES}


def most_likely_type(prefix: str = "prob_") -> Column:
    """Argmax, ties to the first of TWF, HDF, PWF, OSF, RNF (written out,
    because max_by leaves ties undefined)."""
    c = {k: F.col(f"{prefix}{k.lower()}") for k in S.FAILURE_TYPES}
    names = S.FAILURE_TYPES
    expr = None
    for i, k in enumerate(names[:-1]):
        cond = None
        for other in names[i + 1 :]:
            part = c[k] >= c[other]
            cond = part if cond is None else cond & part
        expr = (F.when if expr is None else expr.when)(cond, F.lit(k))
    return expr.otherwise(F.lit(names[-1]))


def recommendation(p: str = "p", likely: str = "most_likely_type") -> Column:
    """A10.  The 'other' text is unreachable with the fixed scores (RNF never
    wins); the branch is kept so user-supplied type scores can reach it."""
    R = S.RECOMMENDATIONS
    by_type = (
        F.when(F.col(likely) == "TWF", F.lit(R["TWF"]))
        .when(F.col(likely) == "HDF", F.lit(R["HDF"]))
        .when(F.col(likely) == "PWF", F.lit(R["PWF"]))
        .when(F.col(likely) == "OSF", F.lit(R["OSF"]))
        .otherwise(F.lit(R["other"]))
    )
    return (
        F.when(F.col(p) < S.RECOMMEND_NONE_BELOW, F.lit(R["none"]))
        .when(F.col(p) < S.RECOMMEND_URGENT_FROM, by_type)
        .otherwise(F.lit(R["urgent"]))
    )


def risk_band(p: str = "p") -> Column:
    """A12."""
    return (
        F.when(F.col(p) >= S.RISK_HIGH_FROM, F.lit("high"))
        .when(F.col(p) >= S.RISK_MEDIUM_FROM, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def bar_band(value: Column) -> Column:
    """Colour of one failure-type bar."""
    return (
        F.when(value > S.BAR_RED_ABOVE, F.lit("red"))
        .when(value > S.BAR_AMBER_ABOVE, F.lit("amber"))
        .otherwise(F.lit("green"))
    )


def type_map(prefix: str = "prob_") -> Column:
    """Response field ``failure_type`` as map<string,double>."""
    return F.create_map(
        *[x for k in S.FAILURE_TYPES for x in (F.lit(k), F.col(f"{prefix}{k.lower()}"))]
    )


def ranked_types(prefix: str = "prob_") -> Column:
    """A14 inside the row: array of (neg, ord, type) structs sorted so the
    highest probability comes first (ties: the fixed type order); prob =
    -neg.  ``sort_array`` on the natural struct order has generated code
    (a comparator lambda or ``array_sort`` would be interpreted per row)."""
    items = F.array(
        *[
            F.struct(
                (-F.col(f"{prefix}{k.lower()}")).alias("neg"),
                F.lit(i).alias("ord"),
                F.lit(k).alias("type"),
            )
            for i, k in enumerate(S.FAILURE_TYPES)
        ]
    )
    return F.sort_array(items)
