"""Boosted trees by histograms, and many fits in one scan."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ferrule import schema as S
from ferrule.functions import rules
from ferrule.ml import batched as BA
from ferrule.ml import boost as BO
from ferrule.ml import select as SEL
from ferrule.ml import train as TR
from ferrule.operators import evaluate as EV
from ferrule.operators import prep
from ferrule.sources.readings import machine_readings

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split(spark):
    df = prep.hash_split(rules.label_failures(machine_readings(spark, SF)), (0.8, 0.2), ("train", "test"))
    return df.filter("split = 'train'").cache(), df.filter("split = 'test'").cache()


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((700, 5)), 2)
    x[:, 3] = x[:, 0] + x[:, 1]  # collinear
    y = (x[:, 0] - 0.5 * x[:, 2] + 0.7 * rng.standard_normal(700) > 0.3).astype(int)
    rows = [(int(k), x[k].tolist(), int(y[k]), int(k % 3), float(1 + k % 2)) for k in range(700)]
    df = spark.createDataFrame(rows, "uid long, v array<double>, y int, fold int, w double")
    return df.select("*", array_to_vector("v").alias("features")).repartition(4).cache(), x, y


def plain_tree(x, g, h, cuts, depth, l2=1.0, least=1.0):
    """Node -> (column, threshold) by trying every cut on every row."""
    out, rows = {}, {0: np.arange(len(x))}
    for node in range((1 << depth) - 1):
        r = rows.get(node)
        if r is None:
            continue
        best = (1e-6, None, None)
        score = lambda i: g[i].sum() ** 2 / (h[i].sum() + l2)
        for j in range(x.shape[1]):
            for c in cuts[j]:
                left = x[r, j] <= c
                a, b = r[left], r[~left]
                if min(h[a].sum(), h[b].sum()) >= least:
                    gain = score(a) + score(b) - score(r)
                    if gain > best[0] + 1e-9:
                        best = (gain, j, c)
        if best[1] is not None:
            left = x[r, best[1]] <= best[2]
            out[node], rows[2 * node + 1], rows[2 * node + 2] = best[1:], r[left], r[~left]
    return out


def test_trees_equal_a_plain_search(points):
    df, x, y = points
    cuts = BO.edges(df, max_bins=16)
    s = BO.Settings(n_estimators=3, learning_rate=0.3, max_depth=3, subsample=1.0, colsample_bytree=1.0, scale_pos_weight=2.0)
    trees = BO.fit_many(BO.blocks(df, cuts, "y"), cuts, [s])[0]
    margin = np.zeros(len(x))
    w = np.where(y > 0, 2.0, 1.0)
    for t in trees:
        p = 1 / (1 + np.exp(-margin))
        want = plain_tree(x, w * (p - y), w * p * (1 - p), cuts, 3)
        got = {i: (f, at) for _, i, f, at, *_ in BO.node_rows([t], cuts) if f >= 0}
        assert got == want
        margin += t.value[t.route(BO.binned(x, cuts), t.depth)]


def test_fits_in_one_scan_equal_fits_alone(points):
    df, _, _ = points
    cuts = BO.edges(df, max_bins=32)
    table = BO.blocks(df, cuts, "y", fold="fold")
    fits = [BO.Settings(n_estimators=n, max_depth=d, scale_pos_weight=w, fold=f)
            for n, d, w, f in [(4, 2, 1.0, 0), (2, 4, 3.0, 1), (3, 3, 5.0, None)]]
    together = BO.fit_many(table, cuts, fits)
    for s, trees in zip(fits, together):
        alone = BO.fit_many(table, cuts, [s])[0]
        assert len(trees) == s.n_estimators
        for a, b in zip(trees, alone):
            assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value, atol=1e-9)
    few = BO.Settings(max_depth=2, colsample_bytree=0.4)
    assert all(len(BO._draw_columns(few, r, 5)) == 2 for r in range(9))
    assert len({tuple(BO._draw_columns(few, r, 5)) for r in range(9)}) > 1  # drawn per tree


def test_scans_are_bounded(points):
    cuts = [np.arange(255.0)] * 20
    fits = [BO.Settings(max_depth=7)] * 60
    groups = BO.scans(fits, cuts)
    assert sorted(p for g in groups for p in g) == list(range(60))
    assert all(len(g) * 16 * 64 * 256 * 16 <= BO.SCAN_BYTES for g in groups)


def test_model_beats_majority_round_trips_and_ranks_columns(spark, split, tmp_path):
    train, test = split
    opts = TR.TrainOptions(gbt={**TR.TrainOptions().gbt, "n_estimators": 10})
    model = TR.fit("xgboost", train, opts)
    preds = TR.predictions(model, test, "machine_failure")
    acc = EV.summary_metrics(preds, labels=[0, 1]).first()["accuracy"]
    share = test.agg(F.avg("machine_failure")).first()[0]
    assert acc > max(share, 1 - share)
    TR.save(model, str(tmp_path / "boosted"))
    again = TR.predictions(TR.load(str(tmp_path / "boosted")), test, "machine_failure")
    assert sorted(map(tuple, preds.collect())) == sorted(map(tuple, again.collect()))
    imp = TR.importance_table(spark, model, train).collect()
    assert len(imp) == len(S.MACHINE_TYPES) + len(TR.feature_columns(opts)) and abs(sum(r["importance"] for r in imp) - 1) < 1e-9
    assert TR.predictions(model, test.limit(0), "machine_failure").count() == 0


def test_boosted_search_tries_every_weight(split, monkeypatch):
    train, _ = split
    monkeypatch.setitem(TR.SEARCH_GRIDS, "xgboost", {
        "n_estimators": [3], "learning_rate": [0.1], "max_depth": [2], "subsample": [1.0], "colsample_bytree": [1.0],
        "scale_pos_weight": [1.0, 3.0, 5.0]})
    found = TR.tune("xgboost", train, TR.TrainOptions(cv=2))
    assert [c["scale_pos_weight"] for c, _ in found.scored] == [1.0, 3.0, 5.0] and not found.not_run
    assert found.best == max(found.scored, key=lambda x: x[1])[0]


def test_logistic_problems_equal_single_fits_and_spark(points):
    from pyspark.ml.classification import LogisticRegression

    df, _, _ = points
    table = BA.blocks(df, "y", "w", "fold")
    problems = [BA.Problem(reg, l1, f) for reg in (0.001, 0.05) for l1 in (0.0, 1.0) for f in (0, 2, None)]
    together = BA.fit_many(table, problems, 5)
    for q, theta in zip(problems, together):
        assert np.abs(BA.fit_many(table, [q], 5)[0] - theta).max() < 1e-6
        rows = df if q.fold is None else df.filter(F.col("fold") != q.fold)
        lr = LogisticRegression(labelCol="y", weightCol="w", regParam=q.reg, elasticNetParam=q.l1, standardization=False, maxIter=3000, tol=1e-14)
        spark_fit = lr.fit(rows)
        if q.l1 == 0:  # with l1 and collinear columns the minimiser isn't single
            assert np.abs(np.append(spark_fit.coefficients.toArray(), spark_fit.intercept) - theta).max() < 1e-4
        x = np.array([r["v"] + [r["y"], r["w"]] for r in rows.collect()])
        z = x[:, :5] @ theta[:5] + theta[5]
        own = (x[:, 6] @ (np.logaddexp(0, z) - x[:, 5] * z)) / x[:, 6].sum() + q.reg * (
            q.l1 * np.abs(theta[:5]).sum() + (1 - q.l1) / 2 * (theta[:5] ** 2).sum())
        assert own <= spark_fit.summary.objectiveHistory[-1] + 1e-9


def test_minimiser_meets_its_conditions():
    rng = np.random.default_rng(1)
    for _ in range(50):
        d = rng.integers(1, 8)
        m = rng.standard_normal((d + 2, d))
        a, b, lasso = m.T @ m + 1e-10 * np.eye(d), rng.standard_normal(d), rng.choice([0.0, 0.3, 2.0], d)
        t = BA.lasso_minimiser(a, b, lasso, rng.standard_normal(d) * rng.integers(0, 2, d))
        slope = b - a @ t
        assert np.allclose(slope[t != 0], (lasso * np.sign(t))[t != 0], atol=1e-7) and (np.abs(slope) <= lasso + 1e-7).all()


def test_elimination_keeps_what_matters(points):
    df, _, _ = points
    got = SEL.tree_elimination(df, "y", n=2, step=2).collect()
    assert len(got) == 5 and sorted(r["round"] or 0 for r in got) == [0, 0, 1, 1, 2]
    stay = {r["feature"] for r in got if r["round"] is None}
    assert "slot_0" in stay and stay <= {"slot_0", "slot_2", "slot_3"}
    # a round's trees use the slots that are left only
    cuts = BO.edges(df)
    few = BO.Settings(n_estimators=3, max_depth=3, columns=(1, 4))
    trees = BO.fit_many(BO.blocks(df, cuts, "y"), cuts, [few])[0]
    assert {int(f) for t in trees for f in t.feature if f >= 0} <= {1, 4}


def test_reducers_share_what_many_tasks_send():
    assert BO.reducers(15, 16 * 256, 1) == 1
    assert all(15 * 16 * 256 * 16 * tasks <= 2 * BO.REDUCER_BYTES * BO.reducers(15, 16 * 256, tasks) for tasks in (8, 48, 240))
    assert BO.reducers(15, 16 * 256, 10**6) == 15  # one key is one reducer's


def test_state_joins_a_partitions_blocks(points, monkeypatch):
    df, x, _ = points
    cuts = BO.edges(df, max_bins=16)
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        table = BO.blocks(df, cuts, "y").coalesce(1).cache()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert table.count() > 4
    whole = BO._state(table, 5, 1).collect()
    assert len(whole) == 1 and sum(n for _, n in whole[0].keys) == 700
    assert sorted(map(tuple, whole[0].bins.T)) == sorted(map(tuple, BO.binned(x, cuts).T))
    fits = [BO.Settings(n_estimators=3, max_depth=3)]
    together = BO.fit_many(table, cuts, fits)[0]
    monkeypatch.setattr(BO, "STATE_CELLS", 1)
    assert BO._state(table, 5, 1).count() == table.count()
    for a, b in zip(together, BO.fit_many(table, cuts, fits)[0]):  # the same rows are drawn
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value, atol=1e-9)


def test_derivatives_equal_plain_sums_whatever_the_chunk(points, monkeypatch):
    df, _, _ = points
    table = BA.blocks(df, "y", "w", "fold")
    problems = [BA.Problem(0.1, 0.0, 1), BA.Problem(0.1)]
    at = {0: np.linspace(-1, 1, 6), 1: np.linspace(0.5, -40, 6)}
    rows = np.array([r["v"] + [1.0, r["y"], r["w"], r["fold"]] for r in df.collect()])
    x, y, w, fold = rows[:, :6], rows[:, 6], rows[:, 7], rows[:, 8]
    for chunk in (1000, 16):
        monkeypatch.setattr(BA, "CHUNK_ROWS", chunk)
        got = BA._derivatives(table, at, problems)
        for p, q in enumerate(problems):
            use, z = w * (fold != q.fold), x @ at[p]
            prob = 1 / (1 + np.exp(-z))
            assert got[p][0] == pytest.approx(use @ (np.logaddexp(0, z) - y * z) / use.sum())
            assert np.allclose(got[p][1], x.T @ (use * (prob - y)) / use.sum(), atol=1e-12)
            assert np.allclose(got[p][2], x.T @ (x * (use * prob * (1 - prob))[:, None]) / use.sum(), atol=1e-12)
