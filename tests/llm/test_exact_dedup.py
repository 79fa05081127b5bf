"""Operator 12: against brute force."""

import hashlib
import random
import re

import pytest

from ferrule.llm import op12_exact_dedup as dedup

SPACES = [" ", "\t", "\n", "\r\n", "  ", "\x0b\x0c", " \t\n "]


def brute(rows):
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    ids = {}
    for (i, _), t in zip(rows, texts):
        ids.setdefault(t, []).append(i)
    out = []
    for (i, _), t in zip(rows, texts):
        keep = min((x for x in ids[t] if x is not None), default=None)
        out.append((i, keep, len(ids[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df, **more):
    return sorted((tuple(r) for r in dedup.duplicates(df, **more).collect()), key=repr)


def copies(n, seed=3):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("ab é 漢 nul\x00 z".split(" ")) for _ in range(rng.randint(0, 12))) for _ in range(n // 3)]
    rows = []
    for k in range(n):
        text = base[0] if k % 3 == 0 else rng.choice(base)  # a third of all rows is one text
        rows.append((k, re.sub(" +", lambda m: rng.choice(SPACES), text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_brute_force(spark, make_docs, parts):
    rows = copies(900)
    assert result(make_docs(rows).repartition(parts)) == brute(rows)


def test_four_rounds_of_pairs_and_small_leaves(spark, make_docs):
    rows = copies(600, 4)
    assert result(make_docs(rows).repartition(5), share=60, fan=2, run_rows=16) == brute(rows)


def test_edge_rows(make_docs, no_docs):
    rows = [(1, None), (2, ""), (3, " "), (4, "\n\t"), (5, "a b"), (6, "a\tb"), (7, " a b"), (7, "a b"), (5, "a b"),
            (None, "a b"), (None, "only"), (None, "only"), (-9, "x " * 300_000), (8, "x\n" * 300_000), (2**63 - 1, "far"), (None, "far")]
    assert result(make_docs(rows)) == brute(rows)
    assert result(no_docs) == []


def test_kept_documents_carry_their_columns(make_docs):
    rows = [(3, "a b"), (1, "a  b"), (2, "c"), (None, "d"), (4, None), (5, "")]
    df = make_docs(rows)
    got = dedup.kept_documents(df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(
        [(1, "a  b"), (2, "c"), (None, "d"), (4, None)], key=repr)


def test_runs_stay_sorted_and_distinct_in_every_round():
    import numpy as np

    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 256, (4000, dedup.KEY_BYTES), dtype=np.uint8).view(dedup.KEY).ravel())
    keys = keys[dedup.digit(keys, 0) == 5]  # what partition 5 holds after round 0
    run = dedup.Run(keys, np.arange(len(keys)), np.ones(len(keys), np.int64), np.ones(len(keys), np.int64))
    batch = dedup.sent(run, 5, 1).to_pydict()
    total = 0
    for goal, block in zip(batch["target"], batch["keys"]):
        got = np.frombuffer(block, dedup.KEY)
        assert (np.sort(got) == got).all() and set(dedup.digit(got, 1).tolist()) <= {goal // dedup.FAN % dedup.FAN}
        assert goal % dedup.FAN == 5
        total += len(got)
    assert total == len(keys)
