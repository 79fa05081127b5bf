"""Mergeable sketches of features by day (C6, E14): drift, quantiles and
distinct values of any period from stored sketches, without reading its rows
again.

A value sketch counts values in buckets whose bounds grow by a fixed factor, so
the values of a bucket lie within ``alpha`` of its middle, and keeps each
bucket's least and greatest value.  Counts add up, so a merged sketch is the
sketch of the merged rows, however these are dealt over files, days and tasks.
At the default ``alpha`` a feature has some 11,500 buckets for each factor of
ten between its values, 280,000 a day between 1e-9 and 1e15.

Nulls, NaN and infinite values are not counted; rows without a time have a
null day, which is in no period; an empty table gives an empty sketch.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule import schema as S
from ferrule.operators.monitor import drift_level, stacked_features

ALPHA = 0.0001
LEAST = 1e-9  # smaller magnitudes count as zero
LG_K = 12  # 2^12 registers: a standard error of 1.6 %


def log_growth(alpha: float = ALPHA) -> float:
    """Logarithm of the factor between the bounds of a bucket."""
    return math.log((1 + alpha) / (1 - alpha))


def first_bucket(alpha: float = ALPHA) -> int:
    return math.ceil(math.log(LEAST) / log_growth(alpha))


def bucket(value: Column, alpha: float = ALPHA) -> Column:
    """Number of a value's bucket: 0 about zero, and in the order of the values."""
    size = F.ceil(F.ln(F.abs(value)) / F.lit(log_growth(alpha))) - F.lit(first_bucket(alpha) - 1)
    number = F.when(F.abs(value) >= LEAST, F.greatest(size, F.lit(1))).otherwise(F.lit(0))
    return (F.when(value < 0, -number).otherwise(number)).cast("long")


def _long(df: DataFrame, columns: list[str], ts_col: str) -> DataFrame:
    day = F.to_date(F.col(ts_col).cast("timestamp_ntz")).alias("day")
    return df.select(day, stacked_features(columns)).filter("value is not null and not isnan(value) and abs(value) < double('infinity')")


def value_sketches(df: DataFrame, columns: list[str], ts_col: str = S.TS, alpha: float = ALPHA) -> DataFrame:
    """(feature, day, bucket, n, lo, hi), one row per bucket that holds values."""
    return _long(df, columns, ts_col).groupBy("feature", "day", bucket(F.col("value"), alpha).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def distinct_sketches(df: DataFrame, columns: list[str], ts_col: str = S.TS, lg_k: int = LG_K) -> DataFrame:
    """(feature, day, hll): HyperLogLog registers of the day's values."""
    return _long(df, columns, ts_col).groupBy("feature", "day").agg(
        F.hll_sketch_agg(F.col("value").cast("string"), F.lit(lg_k)).alias("hll"))


def _period(sketches: DataFrame, first: dt.date | None, last: dt.date | None) -> DataFrame:
    since = F.lit(True) if first is None else F.col("day") >= F.lit(first)
    until = F.lit(True) if last is None else F.col("day") <= F.lit(last)
    return sketches.filter(F.col("day").isNotNull() & since & until)


def merged(sketches: DataFrame, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """The value sketches of the days ``first`` to ``last`` as one: feature,
    bucket, n, lo, hi."""
    return _period(sketches, first, last).groupBy("feature", "bucket").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def distinct_values(sketches: DataFrame, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """(feature, n_distinct) of a period from its registers."""
    return _period(sketches, first, last).groupBy("feature").agg(
        F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("n_distinct"))


def quantiles(sketch: DataFrame, probs: list[float]) -> DataFrame:
    """Per feature and q: n, and ``low`` and ``high``, between which the value of
    rank ceil(q n) lies (the first for q = 0).  ``sketch``: as ``merged`` gives."""
    upto = F.sum("n").over(Window.partitionBy("feature").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("n").over(Window.partitionBy("feature"))
    ranked = sketch.select("feature", "n", "lo", "hi", upto.alias("_upto"), total.alias("_total"))
    asked = ranked.select("*", F.explode(F.array(*[F.lit(float(q)) for q in probs])).alias("q"))
    rank = F.greatest(F.ceil(F.col("q") * F.col("_total")), F.lit(1))
    return asked.filter((rank <= F.col("_upto")) & (rank > F.col("_upto") - F.col("n"))).select(
        "feature", "q", F.col("_total").alias("n"), F.col("lo").alias("low"), F.col("hi").alias("high"))


def _gap(r: Column, c: Column) -> Column:
    return (c - r) * F.ln(c / r)


def sketch_psi(sketches: DataFrame, split: dt.date, bins: int = 10, floor: float = 1e-4, digits: int = 6) -> DataFrame:
    """C6 from stored sketches: population stability index of the days from
    ``split`` on against the days before it, with the bins of ``drift_psi``:
    (feature, psi, psi_low, psi_high, drift).

    A bucket that lies across the edge of a bin is counted where its middle
    falls; ``psi_low`` and ``psi_high`` enclose the index of the values
    themselves, whichever side these lie on.  Features without reference values
    are left out."""
    early = F.col("day") < F.lit(split)
    merged_ = _period(sketches, None, None).groupBy("feature", early.alias("early"), "bucket").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # windows over buckets, not rows
    everything = Window.partitionBy("feature")
    known = merged_.select(
        "*", F.min(F.when(F.col("early"), F.col("lo"))).over(everything).alias("_lo"),
        F.max(F.when(F.col("early"), F.col("hi"))).over(everything).alias("_hi"),
        F.sum(F.when(F.col("early"), F.col("n"))).over(everything).alias("_ref"),
        F.sum(F.when(~F.col("early"), F.col("n"))).over(everything).alias("_cur")).filter("_lo is not null")
    width = F.col("_hi") - F.col("_lo")

    def bin_of(x: Column) -> Column:
        place = F.least(F.greatest(F.floor(F.try_divide(x - F.col("_lo"), width) * bins), F.lit(0)), F.lit(bins - 1))
        return F.when(width == 0, F.lit(0)).otherwise(place).cast("int")

    placed = known.select(
        "feature", "early", "n", "_ref", "_cur", bin_of(F.col("lo")).alias("_a"), bin_of(F.col("hi")).alias("_b"),
        bin_of((F.col("lo") + F.col("hi")) / 2).alias("_m")).select("*", F.explode(F.sequence("_a", "_b")).alias("bin"))

    def share(early: bool, condition: Column, of: str) -> Column:
        mine = F.sum(F.when((F.col("early") == early) & condition, F.col("n")).otherwise(0))
        return F.greatest(F.try_divide(mine, F.max(of)), F.lit(floor))

    here, sure, may = F.col("_m") == F.col("bin"), F.col("_a") == F.col("_b"), F.lit(True)
    shares = placed.groupBy("feature", "bin").agg(
        *[share(e, x, of).alias(f"{p}{k}") for e, of, p in ((True, "_ref", "r"), (False, "_cur", "c"))
          for k, x in (("", here), ("0", sure), ("1", may))])
    c = {k: F.col(k) for k in ("r", "r0", "r1", "c", "c0", "c1")}
    # the gap is convex in both shares: greatest at a corner, least where they meet
    most = F.greatest(*[_gap(c[r], c[x]) for r in ("r0", "r1") for x in ("c0", "c1")])
    least = F.when(c["c0"] > c["r1"], _gap(c["r1"], c["c0"])).when(c["r0"] > c["c1"], _gap(c["r0"], c["c1"])).otherwise(F.lit(0.0))
    out = shares.groupBy("feature").agg(
        F.round(F.sum(_gap(c["r"], c["c"])), digits).alias("psi"), F.round(F.sum(least), digits).alias("psi_low"),
        F.round(F.sum(most), digits).alias("psi_high"))
    return out.select("*", drift_level(F.col("psi")).alias("drift"))
