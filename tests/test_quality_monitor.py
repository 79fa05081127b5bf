import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ferrule.operators import monitor as MO
from ferrule.operators import quality as Q


def test_rolling_split_equals_plain_window(spark):
    # one hot machine with a third of the rows, readings spanning days
    rows, t0 = [], dt.datetime(2024, 1, 1)
    for i in range(900):
        m = 1 if i % 3 == 0 else 2 + i % 7
        rows.append((i, m, t0 + dt.timedelta(minutes=37 * i), float(i % 11)))
    df = spark.createDataFrame(rows, "uid long, machine_id long, ts timestamp, v double")
    df = df.unionByName(df.limit(40).withColumn("uid", F.col("uid") + 10_000).withColumn("v", F.lit(None).cast("double")))
    got = MO.rolling_per_machine(df, 6 * 3600, {
        "n": (F.count, F.lit(1)), "s": (F.sum, F.col("v")), "m": (F.avg, F.col("v")), "lo": (F.min, F.col("v")), "hi": (F.max, F.col("v"))})
    assert got.columns == [*df.columns, "n", "s", "m", "lo", "hi"]
    w = Window.partitionBy("machine_id").orderBy(F.unix_micros("ts")).rangeBetween(-6 * 3600 * 10**6, 0)
    ref = df.select("uid", F.count(F.lit(1)).over(w).alias("n"), F.sum("v").over(w).alias("s"), F.avg("v").over(w).alias("m"),
                    F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"))
    a = {r["uid"]: tuple(r[c] for c in ("n", "s", "m", "lo", "hi")) for r in got.collect()}
    b = {r["uid"]: tuple(r[c] for c in ("n", "s", "m", "lo", "hi")) for r in ref.collect()}
    assert a == b
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - ref._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_robust_mode_ids(spark):
    xs = [1.0, 2.0, 2.0, 3.0, 10.0, None]
    df = spark.createDataFrame([(i, x, "a" if i < 3 else "b") for i, x in enumerate(xs)],
                               "uid long, x double, c string")
    r = {row["uid"]: row["x_rs"] for row in Q.robust_scale(df, ["x"]).collect()}
    vals = np.array([v for v in xs if v is not None])
    q1, med, q3 = np.percentile(vals, [25, 50, 75])
    assert r[0] == pytest.approx((1.0 - med) / (q3 - q1))
    modes = Q.column_modes(df, ["x", "c"])
    assert modes == {"x": 2.0, "c": "a"}  # c: a=3, b=3 -> smallest wins
    filled = {row["uid"]: row["x"] for row in Q.impute_mode(df, ["x"]).collect()}
    assert filled[5] == 2.0
    assert Q.id_column(df) == "uid"
    assert Q.split_features_target(df, "x").columns == ["uid", "c", "x"]


def test_impute_mean_median_drop(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 10.0), (4, None)], "uid long, x double")
    mean = {r["uid"]: r["x"] for r in Q.impute(df, ["x"], "mean").collect()}
    med = {r["uid"]: r["x"] for r in Q.impute(df, ["x"], "median").collect()}
    assert mean[4] == pytest.approx(13 / 3) and med[4] == 2.0
    assert Q.impute(df, ["x"], "drop").count() == 3


def test_clip_and_minmax(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 100])], "uid long, x double")
    clipped = {r["uid"]: r["x"] for r in Q.clip_outliers(df, ["x"]).collect()}
    assert clipped[4] == pytest.approx(4 + 1.5 * 2)
    mm = {r["uid"]: r["x_mm"] for r in Q.minmax_scale(df, ["x"]).collect()}
    assert mm[0] == 0.0 and mm[4] == 1.0


def test_drift_detects_shift(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(hours=i), float(i % 10) + (5.0 if i >= 500 else 0.0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "uid long, ts timestamp, x double")
    r = MO.drift_psi(df, ["x"]).first()
    assert r["psi"] > 0.2 and r["drift"] == "significant"
