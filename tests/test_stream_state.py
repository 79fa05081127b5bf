"""Streams with state of their own, against the batch results."""

import pytest
from pyspark.sql import functions as F

from ferrule.operators import scoring as SC
from ferrule.operators import summary as SU
from ferrule.plans import stream_q as Q
from ferrule.sources.readings import machine_readings
from ferrule.streaming import state as ST

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").cache()


def batch(spark):
    return SC.attribute(SC.with_linear_score(machine_readings(spark, SF)))


def test_retained_rows_survive_restarts(spark, events, tmp_path):
    base = str(tmp_path)
    feed = ST.arrivals(events, late=F.col("event_id") % 9)
    seen = []

    def start():
        seen.append(ST.retained(spark, base, 50).count())
        return ST.run_retained(ST._folder(spark, f"{base}/feed", events.schema), base, keep=50, shards=3)

    ST.in_turns([(feed, f"{base}/feed")], "_arrival", 3, start)
    got = [r["uid"] for r in ST.retained(spark, base, 50).collect()]
    assert got == [r["uid"] for r in SU.last_n(batch(spark), 50).select("uid").collect()]
    assert seen == [0, 50, 50]
    lists = spark.read.parquet(f"{base}/lists").groupBy("epoch", "shard").count()
    assert lists.agg(F.max("count")).first()[0] <= 50  # no shard holds more
    # nothing new: the state and the tables stay
    ST.run_retained(ST._folder(spark, f"{base}/feed", events.schema), base, keep=50, shards=3).awaitTermination()
    assert [r["uid"] for r in ST.retained(spark, base, 50).collect()] == got


def test_repeats_across_restarts_are_recorded_once(spark):
    got = Q.stream_recorded_once(spark, SF)
    want = batch(spark).select("uid", "p", "most_likely_type")
    mine = got.select("uid", "p", "most_likely_type")
    assert mine.exceptAll(want).count() == 0 and want.exceptAll(mine).count() == 0


def test_predictions_wait_for_their_truth(spark, tmp_path):
    base = str(tmp_path)
    hour = F.timestamp_micros((F.col("h") + 10_000) * 3_600_000_000).alias("ts")
    rows = lambda pairs: spark.createDataFrame(pairs, "uid long, h long")
    # 1: in time; 2: too late; 3: before the prediction; 4: in time; 5: pending
    pred = rows([(1, 0), (2, 1), (3, 2), (4, 200), (5, 201)]).select("uid", hour, F.lit(1).alias("pred"))
    truth = rows([(1, 23), (2, 26), (3, 1), (4, 202)]).select("uid", hour, F.lit(1).alias("y"))
    feeds = [(ST.arrivals(pred), f"{base}/p"), (ST.arrivals(truth), f"{base}/t")]
    ST.in_turns(feeds, "_arrival", 2, lambda: ST.append(ST.judged(
        ST._folder(spark, f"{base}/p", pred.schema), ST._folder(spark, f"{base}/t", truth.schema)), base, "out"))
    got = {r["uid"]: r["y"] for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {1: 1, 2: None, 3: None, 4: 1}


def test_sessions_equal_islands(spark):
    got = sorted(tuple(r) for r in Q.stream_machine_sessions(spark, SF).select("machine_id", "session_start", "n_readings").collect())
    rows = sorted((r["machine_id"], r["ts"]) for r in batch(spark).select("machine_id", "ts").collect())
    newest = max(t for _, t in rows)
    islands, last = [], None
    for m, t in rows:
        if last is None or last[0] != m or (t - last[1]).total_seconds() > 12 * 3600:
            islands.append([m, t, 0, t])
        islands[-1][2] += 1
        islands[-1][3] = t
        last = (m, t)
    want = sorted((m, s.strftime("%Y-%m-%d %H:%M:%S"), n) for m, s, n, e in islands if (newest - e).total_seconds() >= 13 * 3600)
    assert got == want and len(got) > 10


def test_empty_feeds(spark, events, tmp_path):
    none = str(tmp_path)
    events.limit(0).write.parquet(f"{none}/events.parquet")
    assert Q.stream_recorded_once(spark, none).count() == 0
    assert Q.stream_live_accuracy(spark, none).count() == 0
    assert Q.stream_machine_sessions(spark, none).count() == 0
    assert Q.stream_retained_state(spark, none).first()["total_predictions"] == 0
