"""Operators 5 and 7: held-out accuracy, parts against brute force, edge rows."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferrule.llm import common as C
from ferrule.llm import op5_quality as quality
from ferrule.llm import op7_toxicity as toxicity
from tests.conftest import SF_SMALL

SF = SF_SMALL.replace("0.001", "0.1")
LABELS = "doc_id long, quality int, toxic int"


def held_out(spark, got, label, mod, out):
    rows = got.join(C.table(spark, SF, "labels").filter(f"{label} is not null"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == out) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    return np.mean([r["predicted"] == r[label] for r in held]), held


def test_quality_held_out(spark):
    got = quality.op5_quality_classifier(spark, SF)
    accuracy, held = held_out(spark, got, "quality", 3, 1)
    assert accuracy > 0.98 and all(r["predicted"] == (r["score"] >= 0.5) for r in held)
    assert sum(r["predicted"] == 0 for r in held if r["quality"] == 0) > 0.9 * sum(r["quality"] == 0 for r in held)


def test_toxicity_held_out(spark):
    got = toxicity.op7_toxicity(spark, SF)
    accuracy, held = held_out(spark, got, "toxic", 4, 2)
    assert accuracy > 0.96 and all(r["predicted"] == (r["score"] >= 0.3) for r in held)
    toxic = [r for r in held if r["toxic"] == 1]
    assert sum(r["predicted"] for r in toxic) > 0.85 * len(toxic)


def small(spark, make_docs):
    good = [" ".join(["This is a plain and friendly sentence about gardens"] * (1 + k % 4)) + f" number {k}." for k in range(60)]
    bad = [" ".join(["BUY!! NOW!!"] * (3 + k % 5)) + f" idiot {k}!!" for k in range(60)]
    rows = list(enumerate(good + bad)) + [(500, None), (501, ""), (502, "x " * 200_000), (None, "null id"), (3, good[3])]
    labels = [(k, int(k < 60), int(k >= 60)) for k in range(120)] + [(3, None, 0), (9999, 1, 1), (None, 1, 0), (4, 1, 0)]
    return make_docs(rows), spark.createDataFrame(labels, LABELS), len(rows)


def test_edge_rows(spark, make_docs, no_docs):
    docs, labels, n = small(spark, make_docs)
    model = quality.quality_model(docs, labels)
    got = {(r["doc_id"], r["text"]): r for r in quality.score(docs, model).collect()}
    assert sum(1 for _ in got) == n - 1 and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[k]["predicted"] == (k[0] < 60) for k in got if k[0] is not None and k[0] < 120)
    assert set(docs.columns) | {"predicted"} == set(next(iter(got.values())).asDict())
    assert quality.score(no_docs, model).count() == 0

    tox = toxicity.toxicity_model(docs, labels)
    got = {(r["doc_id"], r["text"]): r for r in toxicity.score(docs, tox).collect()}
    assert all(got[k]["predicted"] == (k[0] >= 60) for k in got if k[0] is not None and k[0] < 120)
    for (i, text), r in got.items():
        for s in r["segments"]:
            assert text[s["start"] : s["stop"]] and 60 <= (i or 0) < 120


def test_no_labels_or_one_class(spark, make_docs, no_docs):
    docs = make_docs(["some text", None])
    none = spark.createDataFrame([], LABELS)
    one = spark.createDataFrame([(k, 1, 1) for k in range(2)], LABELS)
    for labels in (none, one):
        q, t = quality.quality_model(docs, labels), toxicity.toxicity_model(docs, labels)
        for r in quality.score(docs, q).collect() + toxicity.score(docs, t).collect():
            assert 0 < r["score"] < 1
    assert quality.score(no_docs, quality.quality_model(no_docs, none)).count() == 0


def brute_segments(s):
    """All maximal segments, by the recursive definition."""
    best = max(((sum(s[a:b]), -(b - a), a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    _, _, a, b = best
    return brute_segments(s[:a]) + [(a, b)] + [(x + b, y + b) for x, y in brute_segments(s[b:])]


def test_segments_equal_definition():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.choice([-3.1, -2.03, -1.007, 0.5003, 1.0009, 2.0017, 4.0301]) + rng.random() * 1e-3 for _ in range(rng.randint(0, 25))]
        got = toxicity.maximal_segments(s)
        assert [(a, b) for a, b, _ in got] == brute_segments(s)
        assert all(math.isclose(x, sum(s[a:b]), abs_tol=1e-9) for a, b, x in got)


def test_dual_descent_reaches_the_optimum():
    """The hinge objective, against projected subgradient steps."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((120, 6))
    y = np.sign(x[:, 0] + 0.3 * rng.standard_normal(120))
    w, b = quality.descend([(np.arange(6), r) for r in x], y, 6, cost=1.0, rounds=400)
    cost = lambda w, b: 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()
    v, c, best = np.zeros(6), 0.0, 1e9
    for k in range(1, 20001):
        bad = y * (x @ v + c) < 1
        step = 1 / (k + 10)
        v, c = v - step * (v - (y[bad, None] * x[bad]).sum(axis=0)), c - step * (c - y[bad].sum())
        best = min(best, cost(v, c))
    assert cost(w, b) <= best * 1.001


def test_indicators_against_plain_python():
    """Equal n-gram sets give equal bins, and a row's bins don't depend on its neighbours."""
    texts = ["A dog.", "B cat.", "A dog. A dog.", "", "same same same same", "other other other other"]
    rows = {}
    for part in (texts, texts[::-1], texts[2:]):
        for c in C.chunks(pa.array(part)):
            got, first = quality.features(c)
            for k, r in enumerate(c.rows.tolist()):
                bins = set(got[first[k] : first[k + 1]].tolist())
                assert rows.setdefault(part[r], bins) == bins and len(bins) == first[k + 1] - first[k]
    assert rows["A dog."] == rows["B cat."] and rows["same same same same"] == rows["other other other other"]
    assert not rows[""] and rows["A dog. A dog."] != rows["A dog."]


@pytest.mark.parametrize("mod", [3, 4])
def test_fold_is_crc32(spark, mod):
    rows = spark.range(50).select("id", quality.fold("id", mod).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % mod for r in rows)
    assert spark.range(1).select(F.lit(None).cast("long").alias("id")).select(quality.fold("id", mod).alias("f")).first()["f"] is None
