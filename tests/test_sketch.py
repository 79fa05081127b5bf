"""Sketches by day: merged, they answer for any period."""

import datetime as dt

import numpy as np
import pytest

from ferrule.operators import sketch as SK

SPLIT = dt.date(2024, 1, 6)


@pytest.fixture(scope="module")
def feed(spark):
    rng = np.random.default_rng(5)
    n = 6000
    day = rng.integers(0, 10, n)
    a = np.where(rng.random(n) < 0.05, 0.0, rng.standard_normal(n) * 10 + 0.4 * day)  # zeros, both signs
    b = rng.lognormal(3, 2, n)
    rows = [(k, dt.datetime(2024, 1, 1 + int(day[k]), int(k % 24)), float(a[k]), float(b[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "uid long, ts timestamp, a double, b double")
    return df.repartition(5).cache(), day, {"a": a, "b": b}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def exact_psi(x, late, bins=10, floor=1e-4):
    ref, cur = x[~late], x[late]
    lo, hi = ref.min(), ref.max()
    share = lambda v: np.maximum(np.bincount(np.clip(np.floor((v - lo) / (hi - lo) * bins), 0, bins - 1).astype(int), minlength=bins) / len(v), floor)
    r, c = share(ref), share(cur)
    return float(((c - r) * np.log(c / r)).sum())


def test_buckets_hold_close_values_in_order(feed):
    df, _, values = feed
    got = SK.value_sketches(df, ["a", "b"]).collect()
    for r in got:
        big = max(abs(r["lo"]), abs(r["hi"]))
        assert r["hi"] - r["lo"] <= 2.001 * SK.ALPHA * big or big < SK.LEAST
    for f in "ab":
        whole = sorted(tuple(r) for r in SK.merged(SK.value_sketches(df, [f])).select("bucket", "lo", "hi", "n").collect())
        assert all(x[2] < y[1] for x, y in zip(whole, whole[1:]))
        assert sum(r[3] for r in whole) == len(values[f])


def test_merged_sketch_is_that_of_the_rows_whatever_their_layout(feed):
    df, _, _ = feed
    one = rows(SK.value_sketches(df.coalesce(1), ["a", "b"]))
    assert one == rows(SK.value_sketches(df.repartition(8, "uid"), ["a", "b"]))
    part = SK.merged(SK.value_sketches(df, ["a"]), dt.date(2024, 1, 3), dt.date(2024, 1, 7))
    direct = SK.value_sketches(df.filter("ts >= '2024-01-03' and ts < '2024-01-08'").selectExpr("a", "timestamp'2024-01-01' ts"), ["a"])
    assert rows(part) == rows(direct.drop("day"))


def test_quantiles_hold_the_exact_ones(feed):
    df, day, values = feed
    probs = [0.0, 0.01, 0.5, 0.9, 0.999, 1.0]
    got = {(r["feature"], r["q"]): r for r in SK.quantiles(SK.merged(SK.value_sketches(df, ["a", "b"]), first=SPLIT), probs).collect()}
    assert len(got) == 2 * len(probs)
    for f, x in values.items():
        late = np.sort(x[day >= 5])
        for q in probs:
            exact = late[max(int(np.ceil(q * len(late))), 1) - 1]
            r = got[f, q]
            assert r["n"] == len(late) and r["low"] <= exact <= r["high"]
            assert r["high"] - r["low"] <= 2.001 * SK.ALPHA * abs(exact) * 1.01 + SK.LEAST


def test_drift_lies_within_the_stated_bounds(feed):
    df, day, values = feed
    got = {r["feature"]: r for r in SK.sketch_psi(SK.value_sketches(df, ["a", "b"]), SPLIT, digits=12).collect()}
    for f, x in values.items():
        exact = exact_psi(x, day >= 5)
        assert got[f]["psi_low"] - 1e-9 <= exact <= got[f]["psi_high"] + 1e-9
        assert got[f]["psi_high"] - got[f]["psi_low"] < 0.05
        assert got[f]["psi"] == pytest.approx(exact, abs=0.02)


def test_distinct_values_of_a_period(feed):
    df, day, values = feed
    for layout in (df.coalesce(1), df.repartition(8, "uid")):
        stored = SK.distinct_sketches(layout, ["a", "b"])
        got = {r["feature"]: r["n_distinct"] for r in SK.distinct_values(stored, last=dt.date(2024, 1, 5)).collect()}
        for f, x in values.items():
            exact = len(np.unique(x[day < 5]))
            assert abs(got[f] - exact) <= 4 * 0.0163 * exact


def test_odd_rows(spark):
    t = dt.datetime(2024, 1, 1)
    odd = spark.createDataFrame(
        [(t, None), (t, float("nan")), (t, float("inf")), (t, float("-inf")), (t, 1e-12), (t, -2.0), (None, 7.0)], "ts timestamp, a double")
    got = rows(SK.merged(SK.value_sketches(odd, ["a"])).select("n", "lo", "hi"))
    assert got == [(1, -2.0, -2.0), (1, 1e-12, 1e-12)]
    none = SK.value_sketches(odd.limit(0), ["a"])
    assert rows(SK.sketch_psi(none, SPLIT)) == [] and rows(SK.quantiles(SK.merged(none), [0.5])) == []
    # days on one side only
    early = SK.sketch_psi(SK.value_sketches(odd, ["a"]), SPLIT).collect()
    assert [r["feature"] for r in early] == ["a"]
    assert rows(SK.sketch_psi(SK.value_sketches(odd, ["a"]), dt.date(2024, 1, 1))) == []
