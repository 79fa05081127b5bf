"""Batch summary (B1-B7) and monitoring statistics.

All summaries are single aggregates over the scored rows (partial
aggregation per partition, one tiny final merge).  Retention of the last N
predictions is a top-k (TakeOrderedAndProject: each partition keeps N rows,
the merge sees partitions*N rows), never a global sort or window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule import schema as S
from ferrule.operators import ranking


def batch_summary(scored: DataFrame, digits: int = 6) -> DataFrame:
    """B1-B5 as one row: total, failures, rate (0 when empty), mean p (0 when
    empty), most common argmax type among predicted failures (null when none;
    ties -> the type seen first, i.e. with the smallest uid).

    Two aggregation levels: per argmax type (partial aggregation, at most five
    groups), then one merge over those few rows."""
    is_fail = F.col("machine_failure_pred") == 1
    per_type = scored.groupBy("most_likely_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(is_fail, 1).otherwise(0)).alias("nf"),
        F.sum("p").alias("sp"),
        F.min(F.when(is_fail, F.col(S.UID))).alias("first_uid"),
    )
    has_fail = F.col("nf") > 0
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    fails = F.coalesce(F.sum("nf"), F.lit(0)).cast("long")
    return per_type.agg(
        total.alias("total_machines"),
        fails.alias("failure_count"),
        F.round(F.coalesce(F.try_divide(fails, total), F.lit(0.0)), digits).alias("failure_rate"),
        F.round(F.coalesce(F.try_divide(F.sum("sp"), total), F.lit(0.0)), digits).alias(
            "average_failure_probability"
        ),
        F.min_by(
            F.when(has_fail, F.col("most_likely_type")),
            F.when(has_fail, F.struct(-F.col("nf"), F.col("first_uid"))),
        ).alias("most_common_failure_type"),
    )


def failure_type_counts(scored: DataFrame) -> DataFrame:
    """Argmax type counts among predicted failures."""
    return (
        scored.filter(F.col("machine_failure_pred") == 1)
        .groupBy(F.col("most_likely_type").alias("failure_type"))
        .agg(F.count(F.lit(1)).alias("n_failures"))
    )


def result_table(scored: DataFrame) -> DataFrame:
    """The display table.  Sensors formatted with one decimal, Yes/No,
    percentage, most likely type or N/A; ``machine`` is the row key (uid).

    Formatting goes through ``format_number`` (rounds the exact binary value,
    ties to even, like Python's and C's ``%.1f``) with the grouping commas
    removed; ``format_string`` would round the shortest decimal form instead
    (300.25 -> 300.3)."""
    fmt = lambda c, d: F.regexp_replace(F.format_number(c, d), ",", "")
    fmt1 = lambda c: fmt(F.col(c), 1)
    return scored.select(
        F.col(S.UID).alias("machine"),
        F.col(S.TYPE).alias("machine_type"),
        fmt1(S.AIR).alias("air_temp"),
        fmt1(S.PROCESS).alias("process_temp"),
        fmt(F.col(S.RPM), 0).alias("speed"),
        fmt1(S.TORQUE).alias("torque"),
        fmt(F.col(S.WEAR), 0).alias("tool_wear"),
        F.when(F.col("machine_failure_pred") == 1, F.lit("Yes")).otherwise(F.lit("No")).alias("failure"),
        F.concat(fmt(F.col("p") * 100, 1), F.lit("%")).alias("probability"),
        F.when(F.col("machine_failure_pred") == 1, F.col("most_likely_type")).otherwise(F.lit("N/A")).alias(
            "most_likely_failure"
        ),
        # unformatted values, for exact comparison and sorting
        F.col("p").alias("probability_value"),
        (F.col("machine_failure_pred") == 1).cast("int").alias("is_failure"),
    )


def dense_row_number(df: DataFrame, order_col: str, out: str = "row_no", ties: list[str] | None = None) -> DataFrame:
    """A dense 1..n number in the order of a column (``ranking``)."""
    return ranking.dense_row_number(df, order_col, out, ties)


def last_n(history: DataFrame, n: int = S.HISTORY_KEEP, ts_col: str = S.TS, key: str = S.UID) -> DataFrame:
    """The newest n predictions (ties on time broken by key)."""
    return history.orderBy(F.desc(ts_col), F.desc(key)).limit(n)


def monitor_stats(history: DataFrame, keep: int = S.HISTORY_KEEP, recent: int = S.RECENT_KEEP,
                  ts_col: str = S.TS, key: str = S.UID, digits: int = 6) -> DataFrame:
    """N2/N3/N5/N6 as one row over the retained history."""
    kept = last_n(history, keep, ts_col, key)
    # the kept frame has at most `keep` rows: a window over it is one small task
    w = Window.orderBy(F.desc(ts_col), F.desc(key))
    ranked = kept.withColumn("_rk", F.row_number().over(w))
    recent_flag = F.when(F.col("_rk") <= recent, F.col("machine_failure_pred"))
    agg = ranked.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.coalesce(F.sum("machine_failure_pred"), F.lit(0)).cast("long").alias("failure_predictions"),
        F.avg("machine_failure_pred").alias("_rate"),
        F.avg("p").alias("_avg_p"),
        F.avg(recent_flag).alias("_recent"),
    )
    return agg.select(
        "total_predictions",
        "failure_predictions",
        F.round(F.coalesce("_rate", F.lit(0.0)), digits).alias("failure_rate"),
        F.round(F.coalesce("_avg_p", F.lit(0.0)), digits).alias("average_failure_probability"),
        F.round(F.coalesce("_recent", F.lit(0.0)), digits).alias("recent_failure_rate"),
        F.when(F.coalesce("_rate", F.lit(0.0)) > S.MONITOR_HIGH_RATE_ABOVE, F.lit("high"))
        .otherwise(F.lit("low"))
        .alias("failure_rate_band"),
    )


def monitor_type_distribution(history: DataFrame, keep: int = S.HISTORY_KEEP, ts_col: str = S.TS,
                              key: str = S.UID) -> DataFrame:
    """Argmax type counts among failures of the retained history."""
    return failure_type_counts(last_n(history, keep, ts_col, key))
