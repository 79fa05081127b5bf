import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors

from ferrule.ml import boost as BO
from ferrule.ml import net
from ferrule.ml import train as TR


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 4))
    y = (x[:, 0] > 0.3).astype(int) + (x[:, 1] * x[:, 2] > 0.5)
    df = spark.createDataFrame([(Vectors.dense(v), float(k)) for v, k in zip(x, y)], ["features", "y"])
    return df.repartition(3).cache()


@pytest.mark.parametrize("epochs", [0, 15])
def test_the_fit_is_sparks(rows, monkeypatch, epochs):
    monkeypatch.setattr(net, "BLOCK_ROWS", 2 * net.STACK)
    layers = [4, 5, 3, 3]
    own = net.NeuralNet("y", layers, epochs, 7).fit(rows)
    spark_fit = MultilayerPerceptronClassifier(
        labelCol="y", layers=layers, maxIter=epochs, blockSize=net.STACK, seed=7).fit(rows)
    assert np.allclose(own.weights.toArray(), spark_fit.weights.toArray(), atol=1e-5)
    loss = net.objective(net.arrays(net.blocks(rows, "y", 4, 3)), layers)(own.weights.toArray())[0]
    assert loss == pytest.approx(spark_fit.summary().objectiveHistory[-1], rel=1e-6)


def test_gradient_is_the_slope_whatever_the_chunk(monkeypatch):
    rng = np.random.default_rng(3)
    layers, n = [3, 4, 2], 300  # the last stack has 44 rows
    x, y, w = rng.standard_normal((n, 3)), rng.integers(0, 2, n), rng.standard_normal(26)

    def loss(at):
        return net.add_gradient(np.zeros(26), x, y, at, layers)

    for chunk in (100, 1000):
        monkeypatch.setattr(net, "CHUNK_ROWS", chunk)
        grad = np.zeros(26)
        net.add_gradient(grad, x, y, w, layers)
        slope = [(loss(w + e) - loss(w - e)) / 2e-6 for e in 1e-6 * np.eye(26)]
        assert np.allclose(grad, slope, atol=1e-6)


def test_blocks_keep_rows_and_order(rows, monkeypatch):
    monkeypatch.setattr(net, "BLOCK_ROWS", net.STACK)
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        parts = net.arrays(net.blocks(rows, "y", 4, 3)).glom().collect()
    finally:
        rows.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = rows.rdd.map(lambda r: [*r["features"].toArray().tolist(), r["y"]]).glom().collect()
    for part, plain in zip(parts, want, strict=True):
        assert all(len(y) == net.STACK for _, y in part[:-1])
        assert np.concatenate([np.column_stack([x, y]) for x, y in part]).tolist() == plain


def test_bad_labels_are_refused(rows):
    with pytest.raises(Exception, match="whole numbers from 0 to 1"):
        net.NeuralNet("y", [4, 2, 2], 1, 7).fit(rows)


def test_the_registry_builds_the_network(rows):
    made = TR.make_classifier("neural_network", TR.TrainOptions(label="y"), n_features=4, n_classes=3)
    assert isinstance(made, net.NeuralNet) and made.layers == [4, 64, 32, 16, 3] and made.epochs == 50


def test_sketches_do_not_follow_the_partitions(rows):
    sc = rows.sparkSession.sparkContext
    many = rows.repartition(40).cache()
    many.count()
    sc.setJobGroup("cuts", "cuts of many partitions")
    try:
        cuts = BO.edges(many, max_bins=16)
        tracker = sc.statusTracker()
        stages = [s for j in tracker.getJobIdsForGroup("cuts") for s in tracker.getJobInfo(j).stageIds]
        tasks = [i.numTasks for i in map(tracker.getStageInfo, stages) if i]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert tasks and max(tasks) <= sc.defaultParallelism
    for a, b in zip(cuts, BO.edges(rows, max_bins=16), strict=True):
        assert a.tolist() == b.tolist()


def test_levels_run_in_whole_rounds_of_the_cores(rows):
    cores = rows.sparkSession.sparkContext.defaultParallelism
    few, odd = rows.repartition(cores - 1), rows.repartition(cores + 1)
    assert BO._even(few) is few
    assert BO._even(odd).rdd.getNumPartitions() == 2 * cores
    assert sorted(r["y"] for r in BO._even(odd).collect()) == sorted(r["y"] for r in rows.collect())
