"""Comparing the members of groups pair by pair, whatever the group's size.

A group of ``m`` members is dealt at random over ``ceil(m / size)`` blocks; a
*cell* is a pair of blocks of one group.  Each member goes to one cell per
block of its group, so a task holds two blocks at most, a hot group spreads
over many tasks, and no pair is ever a row: a cell answers with one row per
member (its links in that cell, and the smallest member it reaches there).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(df: DataFrame, group: list[str], member: Column, size: int, sizes: DataFrame | None = None) -> DataFrame:
    """``df`` with columns ``cell`` (a struct: tells the cells of the table apart),
    ``mine`` and ``other`` (this row's block and the cell's other block)."""
    if sizes is None:
        sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_m"))
    out = df.join(sizes, group).withColumn("_n", F.ceil(F.col("_m") / size).cast("int"))
    out = out.withColumn("mine", F.pmod(F.xxhash64(member), F.col("_n")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return out.withColumn(
        "cell", F.struct(*group, F.least("mine", "other").alias("_lo"), F.greatest("mine", "other").alias("_hi"))
    ).drop("_m", "_n")


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` indices over the pairs."""
    label = np.arange(n)
    if not len(left):
        return label
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def runs(keys: np.ndarray):
    """(start, stop) of the runs of equal values."""
    if not len(keys):
        return
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    at = [0, *cut.tolist(), len(keys)]
    yield from zip(at[:-1], at[1:])
