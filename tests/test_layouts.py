"""The same results from one file, many files and small partitions; nulls,
many classes and replays."""

import pytest
from pyspark.sql import functions as F

from ferrule.operators import evaluate as EV
from ferrule.operators import monitor as MO
from ferrule.operators import prep, ranking
from ferrule.operators import summary as SU
from ferrule.sources import io
from ferrule.sources.readings import machine_readings
from ferrule.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """sf0.001 with events as a folder of eight files."""
    d = tmp_path_factory.mktemp("many")
    spark.read.parquet(f"{SF}/events.parquet").repartition(8).write.parquet(str(d / "events.parquet"))
    return str(d)


@pytest.mark.parametrize("name", ["roc_auc", "roc_curve", "pr_curve", "average_precision", "robust_scaled", "imputed",
                                  "outliers_clipped", "exact_stratified_split", "stratified_folds",
                                  "stream_scored", "stream_monitor_stats", "stream_failure_rate", "stream_closed_windows"])
def test_many_files_equal_one(spark, folders, name):
    import __spark_entry__ as E

    q = E.queries()[name]
    one, many = q(spark, SF), q(spark, folders)
    assert one.columns == many.columns
    # sums of doubles depend on the order of rows in their last digits
    order = [c for c, t in one.dtypes if t not in ("double", "float")] + [c for c, t in one.dtypes if t in ("double", "float")]
    a, b = ([tuple(r) for r in d.select(*order).orderBy(*order).collect()] for d in (one, many))
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert all(u == pytest.approx(v, abs=2e-6) if isinstance(u, float) else u == v for u, v in zip(x, y))


def test_curves_have_no_unpartitioned_window_over_rows(spark):
    df = spark.range(0, 5000, 1, 6).select(F.col("id").alias("uid"), (F.col("id") % 2).cast("int").alias("y"), F.rand(1).alias("p"))
    plan = EV.roc_auc(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in plan and "CartesianProduct" not in plan
    assert ranking.ordered_prefix(df, "p", {"n": F.lit(1)}).agg(F.max("cum_n")).first()[0] == 5000


def test_dense_row_number_is_dense(spark):
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        n = 1_000_000
        df = spark.range(0, n, 1, 8).select((F.col("id") * 7919 % n).alias("k"), F.expr("concat('s', id % 5000)").alias("s"))
        got = SU.dense_row_number(df, "k")
        r = got.agg(F.countDistinct("row_no"), F.min("row_no"), F.max("row_no"), F.sum((F.col("row_no") == F.col("k") + 1).cast("int"))).first()
        assert tuple(r) == (n, 1, n, n)
        got = SU.dense_row_number(df, "s", ties=["k"])
        r = got.agg(F.countDistinct("row_no"), F.min("row_no"), F.max("row_no")).first()
        assert tuple(r) == (n, 1, n)
        a, b = got.groupBy("s").agg(F.min("row_no").alias("a"), F.max("row_no").alias("b")).orderBy("s").limit(2).collect()
        assert a["b"] + 1 == b["a"]
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)


def test_dense_row_number_nulls_and_empty(spark):
    df = spark.createDataFrame([(3.0,), (None,), (1.0,), (None,)], "k double")
    assert [r["k"] for r in SU.dense_row_number(df, "k").orderBy("row_no").collect()] == [None, None, 1.0, 3.0]
    assert SU.dense_row_number(df.filter("false"), "k").count() == 0


@pytest.mark.parametrize("make", [prep.exact_stratified_split, prep.stratified_folds])
def test_many_classes_and_null_labels(spark, make):
    df = spark.range(0, 4000, 1, 6).select(F.col("id").alias("uid"), F.when(F.col("id") % 21 < 20, F.col("id") % 21).alias("label"))
    out = make(df, "label")
    assert out.count() == 4000
    if make is prep.stratified_folds:
        spread = out.groupBy("label").pivot("fold").count().collect()
        assert len(spread) == 21 and all(max(r[1:]) - min(r[1:]) <= 1 for r in spread)
    else:
        shares = out.groupBy("label").agg(F.avg((F.col("split") == "train").cast("int")).alias("t")).collect()
        assert len(shares) == 21 and all(abs(r["t"] - 0.7) < 0.01 for r in shares)


def test_hash_split_shares(spark):
    df = spark.range(10_000).withColumnRenamed("id", "uid")
    n = {r["split"]: r["count"] for r in prep.hash_split(df, (0.8, 0.2, 0.0)).groupBy("split").count().collect()}
    assert set(n) == {"train", "validation"} and abs(n["validation"] - 2000) < 200
    with pytest.raises(ValueError):
        prep.hash_split(df, (1.2, -0.2), ("a", "b"))


def test_three_labels_count_all_rows(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.1), (2, 1, 1, 0.9), (3, 2, 1, 0.6), (4, None, 1, 0.5)], "uid long, y int, pred int, p double")
    m = EV.summary_metrics(df, labels=[0, 1]).first()
    assert (m["n_rows"], m["accuracy"]) == (3, 0.666667)
    cells = {(r["true_label"], r["predicted_label"]): r["count"] for r in EV.confusion_cells(df, labels=[0, 1, 7]).collect()}
    assert len(cells) == 16 and cells[(2, 1)] == 1 and cells[(7, 7)] == 0
    many = spark.range(300).select(F.col("id").alias("uid"), (F.col("id") % 100).cast("int").alias("y"), (F.col("id") % 50).cast("int").alias("pred"))
    assert EV.confusion_cells(many).agg(F.sum("count"), F.count("*")).first()[:] == (300, 10_000)


def test_column_kinds_of_null_column(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (2.0, None, "b")], "x double, n double, s string")
    got = {r["feature"]: (r["n_distinct"], r["kind"]) for r in EV.column_kinds(df, ["x", "n", "s"], 2).collect()}
    assert got == {"x": (2, "numeric"), "n": (0, "categorical"), "s": (2, "categorical")}


def test_performance_alert_schema_of_empty_input(spark):
    full = spark.createDataFrame([(1, 1)], "y int, pred int").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    got = MO.performance_alert(full)
    assert got.count() == 1 and MO.performance_alert(full.filter("false")).schema == got.schema


def test_replay_of_an_epoch_loses_no_history(spark, folders, tmp_path):
    out = str(tmp_path / "job")
    preds, hist = jobs.run_scoring(spark, folders, out=out, keep=10_000, max_files=2)
    n = machine_readings(spark, SF).count()
    want = sorted(map(tuple, spark.read.parquet(hist).collect()))
    assert len(want) == n and spark.read.parquet(preds).count() == n
    last = sorted(int(p.name) for p in (tmp_path / "job/_checkpoint/commits").iterdir() if p.name.isdigit())[-1]
    for p in (tmp_path / "job/_checkpoint/commits").iterdir():
        if p.name in (str(last), f".{last}.crc"):
            p.unlink()  # as after a crash between the writes and the commit
    (tmp_path / f"job/history/v{last + 1}/_SUCCESS").unlink()  # and a half-written version
    preds, hist = jobs.run_scoring(spark, folders, out=out, keep=10_000, max_files=2)
    assert sorted(map(tuple, spark.read.parquet(hist).collect())) == want
    assert spark.read.parquet(preds).count() == n


def test_stream_without_rows(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    preds, hist = jobs.run_scoring(spark, str(tmp_path))
    assert spark.read.parquet(preds).count() == 0 and spark.read.parquet(hist).count() == 0


HEAD = ["Torque [Nm]", "uid", "Type", "Rotational speed [rpm]", "Product ID", "Air temperature [K]", "Process temperature [K]", "Tool wear [min]"]


def test_labelled_csv_is_bound_by_name(spark, tmp_path):
    row = ["40.5", "7", "L", "1500", "L1", "298", "308", "12"]
    for extra, value in (("Machine failure", "1"), ("machine_failure", "1")):
        path = tmp_path / f"{extra}.csv"
        path.write_text(",".join([*HEAD, extra]) + "\n" + ",".join([*row, value]) + "\n")
        r = io.read_sensor_csv(spark, str(path)).first()
        assert (r["rpm"], r["torque_nm"], r["uid"], r["machine_failure"]) == (1500.0, 40.5, 7, 1)
    bad = tmp_path / "bad.csv"
    bad.write_text(",".join([*HEAD[1:], "Colour"]) + "\n" + ",".join(row) + "\n")
    with pytest.raises(ValueError, match="torque_nm.*Colour"):
        io.read_sensor_csv(spark, str(bad))


def test_requests_have_keys(spark, tmp_path):
    line = '{"machines": [{"torque": 1.0, "machine_type": "L"}, {"torque": 2.0, "machine_type": "M"}]}\n'
    (tmp_path / "req.json").write_text(line * 3)
    rows = io.read_batch_request(spark, str(tmp_path / "req.json"))
    assert rows.select("request", "position").distinct().count() == rows.count() == 6


def test_prediction_sink_of_many_classes(spark):
    df = spark.createDataFrame([(1, 2, [0.1, 0.2, 0.7])], "uid long, pred int, probability array<double>")
    r = io.prediction_sink(df, n_classes=3).first()
    assert (r["probability_class_0"], r["probability_class_2"]) == (0.1, 0.7)
