"""Operator 13: against brute force, document by document and order by order."""

import itertools
import random
import re

import pytest

from ferrule.llm import op13_filter_audit as audit

LABELS = "doc_id long, quality int, toxic int, source string, text string"


def fails(docs):
    first = {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    out = []
    for d, text, _ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append({
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first.get(t, d)})
    return out


def brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    bad = fails(docs)
    out = {}
    shapley = {}
    for part in {s or "" for _, _, s in docs}:
        rows = [(d, f) for (d, _, s), f in zip(docs, bad) if (s or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, x in enumerate(order, 1):
                here = [r for r in left if r[1][x]]
                left = [r for r in left if not r[1][x]]
                n_bad = sum(f[x] for _, f in rows)
                only = sum(f[x] and sum(f.values()) == 1 for _, f in rows)
                out[part, order, step] = (len(left), len(here), n_bad - len(here), only,
                                          sum(d in good for d, _ in here), sum(d in toxic for d, _ in here))
                shapley[part, x] = shapley.get((part, x), 0) + len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run(spark, docs, labels):
    frame = spark.createDataFrame(
        [(d, t, s, 1, 2, "A", 0, 0) for d, t, s in docs],
        "doc_id long, text string, source string, step int, mask int, letter string, good int, quality int")
    marks = spark.createDataFrame([(*r, "z", "w") for r in labels], LABELS)
    got = audit.audit(frame, marks)
    rows = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got.collect()}
    assert got.count() == len(rows)
    return rows


def sample():
    rng = random.Random(1)
    docs = []
    for d in range(150):
        w = [rng.choice(["alpha", "beta", "Über", "GAMMA", "x", "é", f"w{rng.random()}"]) for _ in range(rng.choice([3, 150, 199, 200, 260]))]
        if rng.random() < 0.6:
            w = [f"{x}{k}" for k, x in enumerate(w)]
        docs.append((d, rng.choice([" ", "\t", "\n", "  "]).join(w) + rng.choice(["", "", " 5%", " |"]), rng.choice(["a", "b", None, ""])))
    for d in range(60):
        docs.append((d + 1000, docs[rng.choice([0, 0, 0, 7, 9])][1], rng.choice(["a", "c"])))
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d in range(0, 1060, 2)]
    return docs, labels


def test_equals_brute_force(spark):
    docs, labels = sample()
    got = run(spark, docs, labels)
    assert got == brute(docs, labels)
    assert len(got) == 600 * len({s or "" for _, _, s in docs})


def test_edge_rows(spark):
    docs = [(1, None, None), (2, "", ""), (3, " \n", "a"), (4, "A", "a"), (4, "A", "a"), (5, "A", "a"), (None, "A", "a"), (None, "z", "a"),
            (6, "x " * 200_000, "a"), (7, "x " * 200_000, "é"), (8, "word", "é")]
    labels = [(4, 1, 0), (4, 0, 1), (5, 1, 1), (None, 1, 1), (6, None, None), (6, None, None)]
    assert run(spark, docs, labels) == brute(docs, labels)
    assert run(spark, docs, []) == brute(docs, [])


def test_empty_table(spark):
    assert run(spark, [], [(1, 1, 1)]) == {}


def test_row_limit_is_restored(spark):
    before = spark.conf.get(audit.ROW_LIMIT)
    spark.conf.set(audit.ROW_LIMIT, "700")
    try:
        docs = [(k, "x", f"part {k}") for k in range(4)]  # 4 x 326 rows
        assert len(run(spark, docs, [])) == 2400
        assert spark.conf.get(audit.ROW_LIMIT) == "700"
    finally:
        spark.conf.set(audit.ROW_LIMIT, before)
