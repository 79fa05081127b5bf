"""Operators 4 and 6: against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm import op4_embedding_dedup as dedup
from ferrule.llm import op6_ann as ann

SCHEMA = "vec_id long, embedding array<float>, label int, id long, key string, weight int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "k", 2) for i, v in rows], SCHEMA)


def sample(n, dim=32, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 2, dim))
    near = base[rng.integers(0, n // 8, n - n // 2)] + rng.standard_normal((n - n // 2, dim)) * rng.uniform(0.02, 0.5, (n - n // 2, 1))
    return np.concatenate([base, near]).astype(np.float32)


def brute_links(ids, vectors, t):
    v = vectors.astype(np.float64)
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    close = v @ v.T >= t
    np.fill_diagonal(close, False)
    label = np.array(ids)
    while True:
        new = np.array([min(label[i], label[close[i]].min(initial=label[i])) for i in range(len(ids))])
        if (new == label).all():
            return close.sum(axis=1), label
        label = new


def test_dedup_equals_brute_force_with_copies(spark):
    v = sample(400)
    v = np.concatenate([v, v[:30], v[:1].repeat(40, axis=0)])
    ids = [int(i) for i in np.random.default_rng(1).permutation(len(v)) * 3]
    links, comp = brute_links(ids, v, 0.9)
    got = {r["vec_id"]: r for r in dedup.near_duplicates(frame(spark, zip(ids, v.tolist()))).collect()}
    assert len(got) == len(ids)
    found = sum(got[i]["n_links"] for i in ids)
    assert found >= 0.995 * links.sum() and all(got[i]["n_links"] <= n for i, n in zip(ids, links))
    if found == links.sum():
        assert all(got[i]["component_id"] == c and got[i]["kept"] == (i == c) for i, c in zip(ids, comp))


def test_hot_bucket_is_split_and_whole(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 16)
    rng = np.random.default_rng(5)
    v = (np.ones((120, 16)) + rng.standard_normal((120, 16)) * 0.01).astype(np.float32)
    got = dedup.near_duplicates(frame(spark, zip(range(120), v.tolist()))).collect()
    assert all(r["n_links"] == 119 and r["component_id"] == 0 for r in got)


def test_collision_probability_is_that_of_the_hash():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((1, 24))
    a /= np.linalg.norm(a)
    b = a + 0.4 * (d := rng.standard_normal((1, 24))) / np.linalg.norm(d)
    keys = dedup._keys(np.concatenate([a, b]), 1, 40000, 3, 2.5)
    assert abs((keys[0] == keys[1]).mean() - dedup.collision(0.4, 2.5)) < 0.01
    k, tables = dedup.plan(10**6)
    assert 1 - (1 - dedup.collision(np.sqrt(0.2)) ** k) ** tables >= 0.999


EDGE = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
        (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (7, [1.0, 0.0]), (None, [5.0, 0.1])]


def test_dedup_edge_rows(spark):
    got = sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["n_links"], r["component_id"], r["kept"])
                 for r in dedup.near_duplicates(frame(spark, EDGE)).collect())
    assert len(got) == len(EDGE)
    links = {k[1]: n for k, n, _, _ in got}
    assert [links[i] for i in (0, 1, 2, 3, 4, 5, 6, 9)] == [0] * 8
    assert links[7] == links[8] == 2  # both rows of 7, and 8
    assert all(c == 7 for k, _, c, _ in got if k[1] in (7, 8))
    assert dedup.near_duplicates(frame(spark, [])).count() == 0


def brute_nearest(ids, v, queries, k):
    v = v.astype(np.float64)
    out = {}
    for q in queries:
        s = np.zeros(len(v))
        for d in range(v.shape[1]):
            s += v[ids.index(q), d] * v[:, d]
        order = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-s[j], ids[j]))[:k]
        out[q] = [(ids[j], s[j]) for j in order]
    return out


@pytest.mark.parametrize("blocks", [(2048, 16384), (8, 64)])
def test_nearest_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(ann, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(ann, "ROW_BLOCK", blocks[1])
    v = sample(600, 64, 2) * np.random.default_rng(3).uniform(0.5, 2, (600, 1)).astype(np.float32)
    v[590:] = v[0]  # ties
    ids = list(range(0, 1200, 2))
    rows = ann.nearest(frame(spark, zip(ids, v.tolist())), F.col("vec_id") % 20 == 0, k=20).collect()
    want = brute_nearest(ids, v, [i for i in ids if i % 20 == 0], 20)
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = sum(len({x for x, _ in got[q]} & {x for x, _ in want[q]}) for q in want)
    assert hits >= 0.999 * 20 * len(want)
    assert sum(got[q] == want[q] for q in want) >= len(want) - 1


def test_error_bound_holds():
    rng = np.random.default_rng(7)
    rows, query = rng.standard_normal((3000, 48)), rng.standard_normal((20, 48))
    centre = rows.mean(axis=0)
    guess, bound = ann.estimates(query, ann.encode(rows, centre), centre, 4.0)
    assert (np.abs(guess - query @ rows.T) <= bound).mean() > 0.9999


def test_nearest_edge_rows(spark):
    got = ann.nearest(frame(spark, EDGE), F.lit(True), k=5).collect()
    assert {r["query_id"] for r in got} == {7, 8}
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(7, 1, 8), (7, 2, 8), (8, 1, 7), (8, 2, 7)] or \
        sorted({(r["query_id"], r["vec_id"]) for r in got}) == [(7, 8), (8, 7)]
    assert ann.nearest(frame(spark, []), F.lit(True)).count() == 0
