"""Exact running sums over a global order, without a single-task window.

A global ``ORDER BY`` window pulls every row into one task.  Here the work is
split in two levels, by one plan whatever the size of the input:

1. group by the ordering value (map-side partial aggregation: one row per
   distinct value, so a value held by a third of all rows is one row);
2. cut the value range into ``ranges`` ranges at approximate quantiles (a
   sketch of fixed error; cuts only balance the ranges, the result is exact);
3. per-range totals (at most ``ranges`` + 1 rows a group) get running offsets;
4. rows and offsets meet by (group, range), the partitioning that the window
   inside each range needs anyway.

Every task sees some ranges.  Groups may be null; a null group is a group.
Used by the exact ROC/PR/AUC/AP metrics, the exact quantiles, dense row numbers
and the exact per-class ranks of the stratified split and folds.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGES = 256  # plain parameter: how many ranges a value order is cut into
SKETCH_ERROR = 1.0 / 1024


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join in which null keys match; the keys come once."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(other, cond).drop(*[f"_r_{k}" for k in keys])


def _splits(edges: list[float]) -> list[float]:
    uniq = sorted(set(e for e in edges if e == e)) or [0.0]  # drop NaN, dedupe; >= 3 splits
    return [float("-inf")] + uniq + [float("inf")]


def _cuts(df: DataFrame, cols: list[str], ranges: int) -> list[list[float]]:
    probs = [i / ranges for i in range(1, ranges)]
    if not probs:
        return [_splits([]) for _ in cols]
    return [_splits(q) for q in df.approxQuantile(cols, probs, SKETCH_ERROR)]


def with_ranges(df: DataFrame, col: str, out: str, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``out``: a number that never falls as ``col`` (any type that
    sorts) rises, set by the value alone; null is -1."""
    kind = df.schema[col].dataType
    if isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        number = F.col(col)
        if isinstance(kind, T.DateType):
            number = F.unix_date(number)
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            number = F.unix_micros(number.cast("timestamp"))
        v = df.select("*", number.cast("double").alias("_rv"))
        splits = _cuts(v, ["_rv"], ranges)[0]
        cut = Bucketizer(splits=splits, inputCol="_rv", outputCol=out, handleInvalid="keep").transform(v).drop("_rv")
        return cut.withColumn(out, F.coalesce(F.when(F.col(col).isNotNull(), F.col(out)), F.lit(-1.0)))
    # other types: cuts at a bounded sample of distinct values
    sample = df.filter(F.col(col).isNotNull()).select(col).distinct().orderBy(F.xxhash64(col)).limit(ranges - 1).collect()
    marks = F.array(*[F.lit(r[0]) for r in sample]) if sample else None
    place = F.size(F.filter(marks, lambda m: m <= F.col(col))) if sample else F.lit(0)
    return df.withColumn(out, F.when(F.col(col).isNull(), F.lit(-1.0)).otherwise(place.cast("double")))


def ordered_prefix(
    df: DataFrame,
    order_col: str,
    sums: dict[str, Column],
    descending: bool = True,
    ranges: int = RANGES,
    groups: list[str] | None = None,
) -> DataFrame:
    """One row per (``groups``, distinct ``order_col`` value), null values dropped, with

    * ``<k>``       the group sum of each ``sums`` expression,
    * ``cum_<k>``   the running sum up to and including this value,
    * ``next_<k>``  the group sum of the following value (null for the last),
    * ``total_<k>`` the grand total,

    in ``descending`` (default) or ascending value order, restarted per group.
    """
    gs = list(groups or [])
    src = df.filter(F.col(order_col).isNotNull()).select(
        *gs, F.col(order_col).cast("double").alias("_v"), *[c.alias(k) for k, c in sums.items()]
    )
    keys = list(sums)
    v_order = F.desc("_v") if descending else F.asc("_v")
    bucketed = Bucketizer(splits=_cuts(src, ["_v"], ranges)[0], inputCol="_v", outputCol="_b", handleInvalid="keep").transform(src)
    grouped = bucketed.groupBy(*gs, "_b", "_v").agg(*[F.sum(k).alias(k) for k in keys])

    b_order = F.desc("_b") if descending else F.asc("_b")
    # per-range totals and the first value's sums of each range (ranges + 1 rows a group at most)
    first = F.max_by if descending else F.min_by
    per_range = grouped.groupBy(*gs, "_b").agg(
        *[F.sum(k).alias(f"_rt_{k}") for k in keys],
        *[first(F.col(k), F.col("_v")).alias(f"_rf_{k}") for k in keys],
    )
    nxt = Window.partitionBy(*gs).orderBy(b_order)
    before = nxt.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*gs)
    offsets = per_range.select(
        *gs,
        "_b",
        *[F.coalesce(F.sum(f"_rt_{k}").over(before), F.lit(0)).alias(f"_off_{k}") for k in keys],
        *[F.sum(f"_rt_{k}").over(everything).alias(f"total_{k}") for k in keys],
        *[F.lead(f"_rf_{k}").over(nxt).alias(f"_nf_{k}") for k in keys],
    )
    inside = Window.partitionBy(*gs, "_b").orderBy(v_order)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    joined = null_safe_join(grouped, offsets, [*gs, "_b"])
    return joined.select(
        *gs,
        F.col("_v").alias(order_col),
        *[F.col(k) for k in keys],
        *[(F.col(f"_off_{k}") + F.sum(k).over(running)).alias(f"cum_{k}") for k in keys],
        *[F.coalesce(F.lead(k).over(inside), F.col(f"_nf_{k}")).alias(f"next_{k}") for k in keys],
        *[F.col(f"total_{k}") for k in keys],
    )


def score_prefix(df: DataFrame, score: str = "p", label: str = "y", ranges: int = RANGES,
                 groups: list[str] | None = None) -> DataFrame:
    """Per distinct score, descending: pos, neg, cum_pos (tps), cum_neg (fps),
    next_pos, next_neg, total_pos (P), total_neg (N)."""
    y = F.col(label).cast("long")
    return ordered_prefix(df, score, {"pos": y, "neg": F.lit(1).cast("long") - y}, True, ranges, groups)


def exact_quantiles_multi(
    df: DataFrame, cols: list[str], probs: list[float], ranges: int = RANGES
) -> dict[str, list[float | None]]:
    """Exact continuous quantiles (linear interpolation between order
    statistics, as ``quantile_cont``) of several columns in one pass.

    Per-column range cuts come from one sketch job; values are unpivoted to
    (feature, value, range), counted per distinct value, and the running
    counts are built per (feature, range) as in ``ordered_prefix``.  Only the
    rows holding the needed order statistics reach the driver (at most two per
    column and probability)."""
    bcols = [f"_b{i}" for i in range(len(cols))]
    vals = df.select(*[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    vcols = [f"_v{i}" for i in range(len(cols))]
    bucketed = Bucketizer(
        inputCols=vcols, outputCols=bcols, splitsArray=_cuts(vals, vcols, ranges), handleInvalid="keep",
    ).transform(vals)
    parts = ", ".join(f"{i}, _v{i}, _b{i}" for i in range(len(cols)))
    stacked = bucketed.select(F.expr(f"stack({len(cols)}, {parts}) AS (_f, _v, _b)")).filter(
        F.col("_v").isNotNull()
    )
    grouped = stacked.groupBy("_f", "_b", "_v").agg(F.count(F.lit(1)).alias("n"))
    per_range = grouped.groupBy("_f", "_b").agg(F.sum("n").alias("_rt"))
    before = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        "_f", "_b",
        F.coalesce(F.sum("_rt").over(before), F.lit(0)).alias("_off"),
        F.sum("_rt").over(Window.partitionBy("_f")).alias("total_n"),
    )
    running = Window.partitionBy("_f", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    pre = grouped.join(offsets, ["_f", "_b"]).select(
        "_f", "_v", "n", "total_n", (F.col("_off") + F.sum("n").over(running)).alias("cum_n")
    )
    conds = None
    for q in probs:
        lo = F.floor((F.col("total_n") - 1) * F.lit(q))
        hi = F.least(lo + 1, F.col("total_n") - 1)
        for k in (lo, hi):
            c = (F.col("cum_n") - F.col("n") <= k) & (k < F.col("cum_n"))
            conds = c if conds is None else conds | c
    rows = pre.filter(conds).select("_f", "_v", "n", "cum_n", "total_n").collect()

    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        mine = [r for r in rows if r["_f"] == i]
        if not mine:
            out[c] = [None for _ in probs]
            continue
        total = mine[0]["total_n"]

        def at(k: int, mine=mine) -> float:
            for r in mine:
                if r["cum_n"] - r["n"] <= k < r["cum_n"]:
                    return r["_v"]
            raise RuntimeError("order statistic not found")

        vals_q = []
        for q in probs:
            h = (total - 1) * q
            lo = int(h)
            hi = min(lo + 1, total - 1)
            x_lo, x_hi = at(lo), at(hi)
            vals_q.append(x_lo + (h - lo) * (x_hi - x_lo))
        out[c] = vals_q
    return out


def exact_quantiles(df: DataFrame, col: str, probs: list[float], ranges: int = RANGES) -> list[float | None]:
    return exact_quantiles_multi(df, [col], probs, ranges)[col]


def _offsets(b: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Per (``keys``, range): rows in the ranges before it, and in all."""
    counts = b.groupBy(*keys, "_rb").agg(F.count(F.lit(1)).alias("_rc"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *keys, "_rb",
        F.coalesce(F.sum("_rc").over(before), F.lit(0)).alias("_ro"),
        F.sum("_rc").over(whole).alias(size),
    )


def rank_within_groups(
    df: DataFrame,
    group_col: str,
    hash_col: str,
    tie_col: str,
    range_expr: Column,
) -> DataFrame:
    """Exact 1-based rank of each row inside its group (a null group is one),
    ordered by (``hash_col``, ``tie_col``), without a window over a whole group.

    ``range_expr`` must never fall as ``hash_col`` rises (e.g. a hash prefix):
    rows are counted per (group, range), offsets come from a window over those
    counts, and the final ``row_number`` runs per (group, range).  A class
    holding most rows is thereby spread over all ranges.  Adds ``group_rank``
    and ``group_size``.
    """
    b = df.select("*", range_expr.alias("_rb"))
    w = Window.partitionBy(group_col, "_rb").orderBy(hash_col, tie_col)
    return (
        null_safe_join(b, _offsets(b, [group_col], "group_size"), [group_col, "_rb"])
        .withColumn("group_rank", F.col("_ro") + F.row_number().over(w))
        .drop("_rb", "_ro")
    )


def dense_row_number(df: DataFrame, order_col: str, out: str = "row_no", ties: list[str] | None = None,
                     ranges: int = RANGES) -> DataFrame:
    """1..n in ascending order of ``order_col`` (nulls first), equal values in
    order of ``ties``.  Offsets belong to ranges set by the value alone, never
    to physical partitions, so recomputing a stage can't change them."""
    b = with_ranges(df, order_col, "_rb", ranges)
    w = Window.partitionBy("_rb").orderBy(order_col, *(ties or []))
    return (
        null_safe_join(b, _offsets(b, [], "_all"), ["_rb"])
        .withColumn(out, (F.col("_ro") + F.row_number().over(w)).cast("long"))
        .drop("_rb", "_ro", "_all")
    )
