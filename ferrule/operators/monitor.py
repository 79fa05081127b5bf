"""Time-based monitoring (C6 drift, C7 performance alert, W1 rolling
per-machine features, W2 daily trend).

Rolling windows per machine are split by time: a machine that holds a third
of all rows must not become one window partition.  Rows are cut into (machine,
bucket) partitions as long as the look-back, and the result equals the unsplit
window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule import schema as S

MICROS = 1_000_000


def ts_micros(ts_col: str = S.TS):
    """Microseconds since the epoch of the wall-clock value (TIMESTAMP_NTZ
    input: independent of the session time zone, no DST gaps; TIMESTAMP
    input is converted to the session zone's wall clock first)."""
    return F.unix_micros(F.from_utc_timestamp(F.col(ts_col).cast("timestamp_ntz").cast("timestamp"),
                                              F.current_timezone()))


def rolling_per_machine(df: DataFrame, lookback_s: int, values: dict, key: str = S.MACHINE_ID,
                        ts_col: str = S.TS) -> DataFrame:
    """For every row, aggregates over the same machine's rows with
    ts in [ts - lookback, ts] (range frame, peers included).

    ``values``: output name -> (``F.count``, ``F.sum``, ``F.avg``, ``F.min`` or
    ``F.max``, column expression).

    Time is cut into buckets as long as the look-back, so a frame is the end of
    one bucket and the beginning of the next: two running aggregates, one from
    each end, put together.  A moving frame would be aggregated anew for every
    row; this takes one step a row, however many rows a frame holds.  A bucket
    of one machine, with the values of the bucket before it, is one window
    partition, so rows are shuffled once."""
    span = lookback_s * MICROS
    us = ts_micros(ts_col)
    merge = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    parts = {}  # partial name -> (aggregate, expression)
    for name, (fn, expr) in values.items():
        if fn.__name__ not in (*merge, "avg"):
            raise ValueError(f"no rolling {fn.__name__}")
        for kind in ("sum", "count") if fn.__name__ == "avg" else (fn.__name__,):
            parts[f"_{kind}_{name}"] = (kind, expr)
    names = [f"_x{n}" for n in parts]
    base = df.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), us.alias("_us"), F.monotonically_increasing_id().alias("_rid"),
                     *[F.when(expr.isNotNull(), expr).alias(x) for x, (_, expr) in zip(names, parts.values())])
    bucket = F.floor(F.col("_us") / span)
    role = lambda name, t, b: F.struct(F.lit(name).alias("role"), t.alias("t"), b.alias("b"))
    own = role("own", F.col("_us"), bucket)
    # asks the bucket before for its rows from ts - lookback on
    probe = role("probe", F.col("_us") - span, bucket)
    # stands in the bucket after its own
    before = role("before", F.col("_us"), bucket + 1)
    all_ = F.explode(F.when(F.col("_us").isNotNull(), F.array(own, probe, before)).otherwise(F.array(own))).alias("_c")
    is_own, is_before = F.col("_c.role") == "own", F.col("_c.role") == "before"
    marked = base.select("*", all_).select(
        F.when(is_own, F.col("_row")).alias("_row"), "_key", "_rid", F.col("_c.t").alias("_t"), F.col("_c.b").alias("_b"), is_own.alias("_own"),
        is_before.alias("_before"), *[F.when(is_own | is_before, F.col(x)).alias(x) for x in names])
    place = Window.partitionBy("_key", "_b")
    begin = place.orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    end = place.orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = []
    for n, (kind, _) in parts.items():
        x = lambda of: merge[kind](F.when(F.col(of), F.col(f"_x{n}")))  # noqa: B023, E731
        pieces.append(F.when(F.col("_own"), x("_own").over(begin)).otherwise(x("_before").over(end)).alias(n))
    pair = Window.partitionBy("_key", "_b", "_rid")  # where its rows are already
    add = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    asked = marked.select("_row", "_key", "_b", "_rid", "_own", "_before", *pieces).filter("not _before")
    whole = asked.select("_row", "_own", *[add[kind](n).over(pair).alias(n) for n, (kind, _) in parts.items()])
    outs = []
    for name, (fn, _) in values.items():
        if fn.__name__ == "avg":
            outs.append((F.col(f"_sum_{name}") / F.when(F.col(f"_count_{name}") > 0, F.col(f"_count_{name}"))).alias(name))
        else:
            outs.append(F.col(f"_{fn.__name__}_{name}").alias(name))
    return whole.filter("_own").select("_row.*", *outs)


def daily_trend(scored: DataFrame, ts_col: str = S.TS, digits: int = 6) -> DataFrame:
    """Per day: readings, rule failures, predicted failures, mean p."""
    day = F.date_format(F.col(ts_col).cast("timestamp_ntz"), "yyyy-MM-dd")
    return scored.groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("n_readings"),
        F.sum("y").cast("long").alias("n_failures"),
        F.sum("pred").cast("long").alias("n_predicted"),
        F.round(F.avg("p"), digits).alias("avg_p"),
        F.round(F.avg("y"), digits).alias("failure_rate"),
    )


def stacked_features(columns: list[str]):
    """(feature, value), one row per column."""
    parts = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    return F.expr(f"stack({len(columns)}, {parts}) AS (feature, value)")


def drift_level(psi):
    return F.when(psi > 0.2, F.lit("significant")).when(psi > 0.1, F.lit("moderate")).otherwise(F.lit("none"))


def drift_psi(df: DataFrame, columns: list[str], ts_col: str = S.TS, bins: int = 10,
              floor: float = 1e-4, digits: int = 6) -> DataFrame:
    """Population stability index of the second half of the time range
    (current) against the first half (reference), per feature.

    Bins are equal-width over the reference range of each feature (current
    values outside it fall into the first / last bin); shares below ``floor``
    are raised to it.  One pass over the data after two tiny aggregates."""
    us = ts_micros(ts_col)
    mid = df.agg(((F.min(us) + F.max(us)) / 2).alias("mid")).first()["mid"]
    period = F.when(us < F.lit(mid), F.lit("reference")).otherwise(F.lit("current"))
    stacked = df.select(period.alias("period"), stacked_features(columns)).filter(F.col("value").isNotNull())
    rng = (
        stacked.filter(F.col("period") == "reference")
        .groupBy("feature")
        .agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    )
    width = F.col("hi") - F.col("lo")
    raw = F.floor((F.col("value") - F.col("lo")) / width * bins)
    b = F.when(width == 0, F.lit(0)).otherwise(F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))).cast("int")
    counts = (
        stacked.join(F.broadcast(rng), "feature")
        .select("feature", "period", b.alias("bin"))
        .groupBy("feature", "bin")
        .agg(
            F.sum(F.when(F.col("period") == "reference", 1).otherwise(0)).alias("n_ref"),
            F.sum(F.when(F.col("period") == "current", 1).otherwise(0)).alias("n_cur"),
        )
    )
    tot = Window.partitionBy("feature")
    shares = counts.select(
        "feature",
        F.greatest(F.col("n_ref") / F.sum("n_ref").over(tot), F.lit(floor)).alias("r"),
        F.greatest(F.col("n_cur") / F.sum("n_cur").over(tot), F.lit(floor)).alias("c"),
    )
    psi = shares.groupBy("feature").agg(
        F.round(F.sum((F.col("c") - F.col("r")) * F.ln(F.col("c") / F.col("r"))), digits).alias("psi")
    )
    return psi.select("feature", "psi", drift_level(F.col("psi")).alias("drift"))


def performance_alert(scored: DataFrame, ts_col: str = S.TS, base_days: int = 7,
                      alert_drop: float = 0.1, digits: int = 6) -> DataFrame:
    """Daily accuracy against the accuracy of the first ``base_days``
    days; alert when it falls by more than ``alert_drop`` (relative)."""
    day = F.to_date(F.col(ts_col).cast("timestamp_ntz"))
    daily = scored.groupBy(day.alias("d")).agg(
        F.count(F.lit(1)).alias("n_readings"),
        F.sum((F.col("y") == F.col("pred")).cast("int")).alias("n_correct"),
    )
    # one row per day: the base period is found and summed over those rows
    everything = Window.partitionBy()
    dated = daily.withColumn("_first", F.min("d").over(everything))
    is_base = F.col("d") < F.date_add(F.col("_first"), base_days)
    total = lambda c: F.sum(F.when(is_base, F.col(c))).over(everything)
    acc = F.col("n_correct") / F.col("n_readings")
    rated = dated.withColumn("_base", total("n_correct") / total("n_readings"))
    return rated.select(
        F.date_format("d", "yyyy-MM-dd").alias("day"),
        "n_readings",
        F.round(acc, digits).alias("accuracy"),
        F.round("_base", digits).alias("base_accuracy"),
        (acc < F.col("_base") * (1 - alert_drop)).cast("int").alias("alert"),
    )
