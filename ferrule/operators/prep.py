"""Splits, folds and class weights.

Splits are decided per row from a hash of the key: no shuffle, repeatable,
independent of partitioning (``randomSplit`` is not).  The exact stratified
form ranks rows inside their class by the same hash without a per-class
window (``ranking.rank_within_groups``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule import schema as S
from ferrule.operators import ranking

HEX_DIGITS = 3  # hash ranges per class: 16 ** digits


def key_hash(key: str = S.UID, seed: int = 42) -> Column:
    """md5 of key||seed as 32 hex digits (same text in DuckDB)."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))


HASH_RANGE = 1 << 16


def hash_split(df: DataFrame, fractions: tuple[float, ...] = (0.7, 0.15, 0.15),
               names: tuple[str, ...] = ("train", "validation", "test"),
               key: str = S.UID, seed: int = 42, out: str = "split") -> DataFrame:
    """Assign each row to a part by the first 4 hex digits of its hash,
    as a number.  A part with share 0 gets no row."""
    if len(fractions) != len(names) or abs(sum(fractions) - 1.0) > 1e-9 or min(fractions) < 0:
        raise ValueError("fractions must match names, not be negative and sum to 1")
    prefix = F.conv(F.substring(key_hash(key, seed), 1, 4), 16, 10).cast("int")
    last = max(i for i, f in enumerate(fractions) if f > 0)
    acc, expr = 0.0, None
    for frac, name in list(zip(fractions, names))[:last]:
        acc += frac
        cond = prefix < F.lit(int(acc * HASH_RANGE))
        expr = (F.when if expr is None else expr.when)(cond, F.lit(name))
    expr = expr.otherwise(F.lit(names[last])) if expr is not None else F.lit(names[last])
    return df.withColumn(out, expr)


def exact_stratified_split(df: DataFrame, label: str, fractions: tuple[float, ...] = (0.7, 0.15, 0.15),
                           names: tuple[str, ...] = ("train", "validation", "test"),
                           key: str = S.UID, seed: int = 42, out: str = "split",
                           hex_digits: int = HEX_DIGITS) -> DataFrame:
    """T6 exact: inside each class, rows ordered by (hash, key); the first
    floor(f1*n_c) go to the first part, up to floor((f1+f2)*n_c) to the
    second, the rest to the last.  Class shares are exact; rows without a
    label are a class of their own."""
    ranked = _class_rank(df, label, key, seed, hex_digits)
    pct = [int(round(f * 100)) for f in fractions]
    if sum(pct) != 100:
        raise ValueError("fractions must be whole percents summing to 1")
    acc, expr = 0, None
    for p, name in list(zip(pct, names))[:-1]:
        acc += p
        cond = F.col("group_rank") * 100 <= F.col("group_size") * acc
        expr = (F.when if expr is None else expr.when)(cond, F.lit(name))
    return ranked.withColumn(out, expr.otherwise(F.lit(names[-1]))).drop("_h", "group_rank", "group_size")


def stratified_folds(df: DataFrame, label: str, k: int = 3, key: str = S.UID, seed: int = 42,
                     out: str = "fold", hex_digits: int = HEX_DIGITS) -> DataFrame:
    """fold = (rank in class - 1) mod k, so every fold gets an equal
    share (+-1) of every class.  Usable as ``CrossValidator(foldCol=...)``."""
    ranked = _class_rank(df, label, key, seed, hex_digits)
    return ranked.withColumn(out, ((F.col("group_rank") - 1) % k).cast("int")).drop(
        "_h", "group_rank", "group_size"
    )


def _class_rank(df: DataFrame, label: str, key: str, seed: int, hex_digits: int) -> DataFrame:
    h = df.withColumn("_h", key_hash(key, seed))
    part = F.conv(F.substring(F.col("_h"), 1, hex_digits), 16, 10).cast("int")
    return ranking.rank_within_groups(h, label, "_h", key, part)


def class_counts(df: DataFrame, label: str) -> dict:
    """Label -> count, one row per class; rows without a label don't count."""
    return {r[label]: r["count"] for r in df.filter(F.col(label).isNotNull()).groupBy(label).count().collect()}


def balanced_weight(df: DataFrame, label: str) -> Column:
    """M1: n / (k * n_c) per class, as a literal map lookup (no join)."""
    counts = class_counts(df, label)
    n, k = sum(counts.values()), len(counts)
    m = F.create_map(*[x for c, cnt in counts.items() for x in (F.lit(c), F.lit(n / (k * cnt)))])
    return m[F.col(label)]


def positive_weight(label: str, weight: float = 3.0) -> Column:
    """M2: weight w for class 1, 1 otherwise."""
    return F.when(F.col(label) == 1, F.lit(float(weight))).otherwise(F.lit(1.0))


def n_classes(df: DataFrame, label: str) -> int:
    """M8: distinct labels (2 -> binary)."""
    return df.agg(F.countDistinct(label)).first()[0]


def hash_fold(key: str = S.UID, folds: int = 5, seed: int = 42) -> Column:
    """Fold 0 .. folds - 1 of a row, from the hash of its key: no shuffle."""
    return F.pmod(F.conv(F.substring(key_hash(key, seed), 1, 7), 16, 10).cast("long"), F.lit(folds)).cast("int")


def cross_fitted_target(df: DataFrame, column: str, label: str, out: str, folds: int = 5, smoothing: float = 10.0,
                        key: str = S.UID, seed: int = 42) -> DataFrame:
    """The mean label of a row's category over the *other* folds, pulled to
    their overall mean by ``smoothing`` rows; no row's own label is in its code.

    One aggregate per (category, fold), partial before its shuffle, gives every
    code; the rows take theirs by (category, fold).  Null is a category of its
    own, null labels count for none, and a category that the other folds don't
    have gets their overall mean (null if they have no label)."""
    rows = df.withColumn("_fold", hash_fold(key, folds, seed))
    seen = rows.groupBy(column, "_fold").agg(F.count(label).alias("_n"), F.coalesce(F.sum(F.col(label).cast("double")), F.lit(0.0)).alias("_s"))
    # at most folds rows a category from here on
    own, everything = Window.partitionBy(column), Window.partitionBy()
    per_fold = seen.groupBy("_fold").agg(F.sum("_n").alias("_fn"), F.sum("_s").alias("_fs"))
    per_fold = per_fold.select(
        F.col("_fold").alias("_f"), F.try_divide(F.sum("_fs").over(everything) - F.col("_fs"), F.sum("_fn").over(everything) - F.col("_fn")).alias("_mean"))
    n, s = F.sum("_n").over(own) - F.col("_n"), F.sum("_s").over(own) - F.col("_s")
    others = seen.select(column, "_fold", n.alias("_on"), s.alias("_os"))
    codes = others.join(F.broadcast(per_fold), F.col("_fold") == F.col("_f")).select(
        F.col(column).alias("_category"), F.col("_fold").alias("_f"),
        F.when((F.col("_on") > 0) | (F.lit(smoothing) > 0), F.try_divide(
            F.col("_os") + F.lit(smoothing) * F.col("_mean"), F.col("_on") + F.lit(smoothing))).otherwise(F.col("_mean")).alias(out))
    return rows.join(codes, F.col(column).eqNullSafe(F.col("_category")) & (F.col("_fold") == F.col("_f")), "left").drop(
        "_category", "_f", "_fold")
