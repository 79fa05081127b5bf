"""Operator 11: against plain rounds of assignment and update in big integers."""

import hashlib
import math

import numpy as np
import pytest

from ferrule.llm import op11_centroids as cc

SCHEMA = "vec_id long, embedding array<float>, cluster int, vec string, distance double, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 9, "x", 0.5, 1) for i, v in rows], SCHEMA)


def brute(rows, k, rounds, dim, seed=3):
    kept = [(i, tuple(math.floor(1024 * x) for x in np.asarray(v, np.float32).astype(float).tolist())) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(x) <= 2**17 for x in v)]
    starts = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in starts]
    if not c:
        return []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                c[j] = tuple(sum(col) // len(mine) for col in zip(*mine))
    found = [nearest(v) for _, v in kept]
    total = sum(d for d, _ in found)
    part = [sum(d for d, o in found if o == j) for j in range(len(c))]
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, j, d, part[j], total, digest[j]) for (i, _), (d, j) in zip(kept, found)), key=repr)


def result(spark, rows, k, rounds, dim, parts=3):
    found, centroids, scans = cc.clusters(frame(spark, rows).repartition(parts), k=k, rounds=rounds, dim=dim)
    got = cc.digested(found, centroids).collect() if len(centroids) else found.collect()
    return sorted((tuple(r) for r in got), key=repr), scans


def mixture(n, dim, seed, groups=5, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    v = centres[rng.integers(0, groups, n)] + rng.standard_normal((n, dim)) * spread
    return [(int(i), x) for i, x in zip(rng.permutation(n), v.astype(np.float32).tolist())]


def test_equals_plain_rounds_and_spares_distances(spark):
    rows = mixture(600, 16, 0)
    rows += [(7000 + k, rows[0][1]) for k in range(200)]  # a large group of copies
    got, scans = result(spark, rows, 8, 10, 16)
    assert got == brute(rows, 8, 10, 16)
    assert scans[0] == 800 * 8 and sum(scans[1:]) < 0.5 * 10 * 800 * 8


def test_ties_go_to_the_smaller_number(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.integers(-2, 3, 2).astype(float).tolist()) for k in range(120)]
    got, _ = result(spark, rows, 6, 5, 2)
    assert got == brute(rows, 6, 5, 2)


EDGE = [(1, None), (2, []), (3, [0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, -0.5]),
        (7, [1.0, -0.5]), (None, [2.0, 2.0]), (8, [2.0, 0.001]), (9, [1.0, 2.0, 3.0]), (10, [3e38, 0.0]), (11, [131072.0, -131072.0])]


def test_edge_rows(spark):
    for rows in (EDGE, [(None, [1.0, 1.0])], [(1, [1.0, 1.0])], []):
        got, _ = result(spark, rows, 3, 4, 2)
        assert got == brute(rows, 3, 4, 2)


def test_empty_table_of_the_query(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = cc.op11_centroid_clusters(spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_rounds_equal_full_scans_whatever_the_centroids_do(seed):
    """Centroids that wander, return, stand still and coincide."""
    rng = np.random.default_rng(seed)
    k, dim, n = 6, 5, 400
    v = rng.integers(-40, 40, (n, dim))
    history = rng.integers(-40, 40, (1, k, dim))
    d2, seen, own, _ = cc.Round(history).start(v)
    spared = 0
    for t in range(12):
        step = rng.integers(-6, 7, (k, dim)) * (rng.random((k, 1)) < 0.5)
        new = history[-2] if t % 4 == 3 else history[-1] + step
        if t == 6:
            new = new.copy()
            new[1] = new[0]
        history = np.concatenate([history, new[None]])
        work = cc.Round(history)
        own, scans = work.assign(v, d2, seen, own)
        full = ((v[:, None, :] - new[None]) ** 2).sum(axis=2)
        assert (own == full.argmin(axis=1)).all()
        spared += n * k - scans
        ever = ((v[:, None, :] - history[seen, np.arange(k)]) ** 2).sum(axis=2)
        assert (d2 == ever).all()  # every stored distance is exact at its round
    assert spared > 0
    assert (work.settle(v, d2, seen, own) == full.min(axis=1)).all()


def test_a_centroid_that_returns_leaves_its_bounds_tight():
    history = np.array([[[0, 0], [100, 0]], [[50, 0], [100, 0]], [[0, 0], [100, 0]]])
    assert cc.Round(history).drift[0].tolist() == [0.0, 0.0]
    v = np.array([[40, 0]])
    d2, seen, own, _ = cc.Round(history[:1]).start(v)
    own, scans = cc.Round(history).assign(v, d2, seen, own)
    assert own.tolist() == [0] and scans == 0
