"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import written
from ferrule.session import ensure_checkpoint_dir

MAX_ROUNDS = 60


def _cut(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id with an edge to another one; ``component``
    is the smallest id reachable.  Ids are longs; loops and nulls don't count.

    Alternates two star steps until the edges stand still: each id's larger
    neighbours are linked to its smallest one, then its smaller neighbours and
    itself.  Every step keeps what is connected connected, uses hash
    aggregates and joins only, and ends as stars around the smallest ids, in a
    number of rounds that grows with the logarithm of the longest path."""
    now = _cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter((F.col("u") > F.col("v")) & F.col(a).isNotNull() & F.col(b).isNotNull())
        .distinct()
    )
    mark = _mark(now)
    if mark[0] == 0:
        return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for _ in range(MAX_ROUNDS):
        # large star: link each larger neighbour to the smallest of the star
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        # small star: u > v everywhere, so all of an id's neighbours are smaller
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = _cut(
            small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        new = _mark(now)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first()
    return tuple(r)


def with_components(ids: DataFrame, edges: DataFrame, id_col: str, out: str = "component_id") -> DataFrame:
    """``ids`` with the component of each id (itself where it has no edge)."""
    comp = written(components(edges), "components")
    return (
        ids.join(comp.select(F.col("id").alias(id_col), F.col("component").alias("_c")), id_col, "left")
        .withColumn(out, F.coalesce("_c", id_col))
        .drop("_c")
    )
