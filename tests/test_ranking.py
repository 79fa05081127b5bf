import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ferrule.operators import ranking


def test_prefix_equals_global_window(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 40) / 4.0, rnd.randint(0, 1), rnd.choice(["a", "b"])) for i in range(500)]
    df = spark.createDataFrame(rows, "uid long, v double, y int, g string")
    pre = ranking.ordered_prefix(df, "v", {"pos": F.col("y").cast("long")}, descending=True, ranges=5,
                                 groups=["g"])
    got = {(r["g"], r["v"]): (r["cum_pos"], r["next_pos"], r["total_pos"]) for r in pre.collect()}
    g = df.groupBy("g", "v").agg(F.sum("y").alias("pos"))
    w = Window.partitionBy("g").orderBy(F.desc("v"))
    ref = g.select("g", "v", F.sum("pos").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"),
                   F.lead("pos").over(w).alias("n"), F.sum("pos").over(Window.partitionBy("g")).alias("t"))
    want = {(r["g"], r["v"]): (r["c"], r["n"], r["t"]) for r in ref.collect()}
    assert got == want


def test_exact_quantiles(spark):
    rnd = random.Random(5)
    xs = [rnd.gauss(0, 1) for _ in range(1001)] + [0.5] * 300
    df = spark.createDataFrame([(x, x * 2) for x in xs], "a double, b double")
    qs = ranking.exact_quantiles_multi(df, ["a", "b"], [0.0, 0.25, 0.5, 0.9, 1.0], ranges=16)
    for q, v in zip([0, 25, 50, 90, 100], qs["a"]):
        assert v == pytest.approx(np.percentile(xs, q), abs=1e-12)
    assert qs["b"][2] == pytest.approx(2 * np.percentile(xs, 50), abs=1e-12)


def test_rank_within_groups(spark):
    rows = [(i, i % 3 == 0, format(random.Random(i).getrandbits(32), "08x")) for i in range(400)]
    df = spark.createDataFrame(rows, "uid long, g boolean, h string")
    got = ranking.rank_within_groups(df, "g", "h", "uid", F.conv(F.substring("h", 1, 1), 16, 10).cast("int"))
    w = Window.partitionBy("g").orderBy("h", "uid")
    ref = df.select("uid", F.row_number().over(w).alias("r"))
    a = {r["uid"]: r["group_rank"] for r in got.collect()}
    b = {r["uid"]: r["r"] for r in ref.collect()}
    assert a == b
