import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ferrule.ml.stages import PopulationStandardScaler, preparation_stages
from ferrule.operators import prep


def _labelled(spark, n=3000):
    # skewed classes: 10 % positives
    return spark.createDataFrame([(i, 1 if i % 10 == 0 else 0) for i in range(n)], "uid long, y int")


def test_hash_split_disjoint_complete(spark):
    df = prep.hash_split(_labelled(spark))
    counts = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    assert sum(counts.values()) == 3000
    assert set(counts) == {"train", "validation", "test"}
    assert 0.65 < counts["train"] / 3000 < 0.75
    # repeatable and independent of partitioning
    a = {r["uid"]: r["split"] for r in df.collect()}
    b = {r["uid"]: r["split"] for r in prep.hash_split(_labelled(spark).repartition(7)).collect()}
    assert a == b


def test_exact_stratified_shares(spark):
    df = prep.exact_stratified_split(_labelled(spark), "y")
    got = {(r["y"], r["split"]): r["count"] for r in df.groupBy("y", "split").count().collect()}
    assert got[(1, "train")] == 210 and got[(1, "validation")] == 45 and got[(1, "test")] == 45
    assert got[(0, "train")] == 1890 and got[(0, "validation")] == 405 and got[(0, "test")] == 405


def test_folds_balanced(spark):
    df = prep.stratified_folds(_labelled(spark), "y", k=3)
    got = {(r["y"], r["fold"]): r["count"] for r in df.groupBy("y", "fold").count().collect()}
    assert got[(1, 0)] == got[(1, 1)] == got[(1, 2)] == 100
    assert got[(0, 0)] == got[(0, 1)] == got[(0, 2)] == 900


def test_balanced_weights(spark):
    df = _labelled(spark)
    w = df.select("y", prep.balanced_weight(df, "y").alias("w"))
    per = {r["y"]: r["w"] for r in w.distinct().collect()}
    assert per[1] == pytest.approx(3000 / (2 * 300)) and per[0] == pytest.approx(3000 / (2 * 2700))
    assert w.agg(F.sum("w")).first()[0] == pytest.approx(3000)


def test_population_scaler_and_onehot(spark):
    rows = [(1, "L", 1.0, 5.0), (2, "M", 2.0, 5.0), (3, "H", 4.0, 5.0), (4, "Q", 7.0, 5.0)]
    df = spark.createDataFrame(rows, "uid long, type string, a double, b double")
    model = Pipeline(stages=preparation_stages(["a", "b"])).fit(df.filter("type != 'Q'"))
    out = {r["uid"]: r["v"] for r in model.transform(df).select("uid", vector_to_array("features").alias("v")).collect()}
    xs = np.array([1.0, 2.0, 4.0])
    assert out[1][:3] == [0.0, 1.0, 0.0]   # categories sorted H, L, M
    assert out[3][:3] == [1.0, 0.0, 0.0]
    assert out[4][:3] == [0.0, 0.0, 0.0]   # unknown -> all zero
    assert out[1][3] == pytest.approx((1.0 - xs.mean()) / xs.std(ddof=0))
    assert out[1][4] == 0.0                # zero std divides by 1


def test_scaler_persistence(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (3.0,)], "a double")
    m = PopulationStandardScaler(inputCols=["a"], outputCols=["z"]).fit(df)
    m.write().overwrite().save(str(tmp_path / "s"))
    from ferrule.ml.stages import PopulationStandardScalerModel
    m2 = PopulationStandardScalerModel.load(str(tmp_path / "s"))
    assert [r["z"] for r in m2.transform(df).collect()] == [-1.0, 1.0]


def test_cross_fitted_codes_leave_out_their_own_fold(spark):
    rows = [(i, "abc"[i % 3] if i % 7 else None, (i * i) % 5 % 2 if i % 11 else None) for i in range(200)] + [(900, "only here", 1)]
    df = spark.createDataFrame(rows, "uid long, kind string, y int").withColumn("_f", F.lit(1))
    got = {r["uid"]: r["code"] for r in prep.cross_fitted_target(df.drop("_f"), "kind", "y", "code", smoothing=3.0).collect()}
    fold = {r["uid"]: r["k"] for r in df.select("uid", prep.hash_fold().alias("k")).collect()}
    assert len(got) == len(rows) and len(set(fold.values())) == 5
    for i, kind, _ in rows:
        others = [(c, y) for j, c, y in rows if fold[j] != fold[i] and y is not None]
        mean = sum(y for _, y in others) / len(others)
        mine = [y for c, y in others if c == kind]
        assert abs(got[i] - (sum(mine) + 3 * mean) / (len(mine) + 3)) < 1e-12
    flipped = df.drop("_f").withColumn("y", F.when(F.col("uid") == 5, 1 - F.col("y")).otherwise(F.col("y")))
    again = {r["uid"]: r["code"] for r in prep.cross_fitted_target(flipped, "kind", "y", "code", smoothing=3.0).collect()}
    assert again[5] == got[5]  # its own label is not in its code
