"""Registered queries: streaming (N1, N2-N6 over the streamed history, W3).

Each runs a Structured Streaming job to completion (availableNow) into the
shared checkpoint folder and returns the written table.  The streamed
monitoring statistics have an oracle: they must equal the batch ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.operators import summary as SU
from ferrule.plans.scoring_q import MONITOR_STATS_SQL
from ferrule.plans.sqltext import RECOMMENDATION_SQL, with_attribution
from ferrule.streaming import jobs
from ferrule.streaming import state as ST


def stream_scored(spark, sf_dir):
    """Streamed predictions; equal to the batch scoring of the same rows."""
    preds, _ = jobs.run_scoring(spark, sf_dir)
    return spark.read.parquet(preds).drop("epoch", "ts")


STREAM_SCORED_SQL = with_attribution(
    f"""SELECT uid, machine_id, type, air_temp_k, process_temp_k, rpm, torque_nm, tool_wear_min, p,
       machine_failure_pred, most_likely_type, {RECOMMENDATION_SQL} AS maintenance_recommendation,
       prob_twf, prob_hdf, prob_pwf, prob_osf, prob_rnf
FROM a"""
)

_WINDOWS_SQL = """, wd AS (
SELECT date_trunc('day', ts) AS ws, count(*) AS n_readings, CAST(sum(machine_failure_pred) AS BIGINT) AS n_predicted,
       round(sum(machine_failure_pred) / count(*), 6) AS failure_rate, round(avg(p), 6) AS avg_p
FROM a GROUP BY 1
)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, n_readings, n_predicted, failure_rate, avg_p
FROM wd"""

STREAM_RATE_SQL = with_attribution(_WINDOWS_SQL)
# append mode: a window is emitted once the watermark (max ts - 1 hour) reaches its end
STREAM_CLOSED_SQL = with_attribution(
    _WINDOWS_SQL + "\nWHERE ws + INTERVAL 1 DAY <= (SELECT max(ts) FROM a) - INTERVAL 1 HOUR"
)


def stream_monitor_stats(spark, sf_dir):
    _, hist = jobs.run_scoring(spark, sf_dir)
    return SU.monitor_stats(spark.read.parquet(hist))


def stream_failure_rate(spark, sf_dir):
    table = jobs.run_windowed_rate(spark, sf_dir, output_mode="complete")
    return spark.read.parquet(table)


def stream_closed_windows(spark, sf_dir):
    table = jobs.run_windowed_rate(spark, sf_dir, output_mode="append")
    return spark.read.parquet(table).select("window_start", "n_readings", "n_predicted",
                                            F.col("failure_rate"), F.col("avg_p"))


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def stream_retained_state(spark, sf_dir):
    """Monitoring over the retained state of a stream that restarts twice."""
    base = ST._base(spark, None)
    feed = ST.arrivals(_events(spark, sf_dir))
    schema = feed.drop("_arrival").schema
    ST.in_turns([(feed, f"{base}/feed")], "_arrival", ST.TURNS,
                lambda: ST.run_retained(ST._folder(spark, f"{base}/feed", schema), base))
    return SU.monitor_stats(ST.retained(spark, base))


def stream_recorded_once(spark, sf_dir):
    """A feed in which one row in seven comes twice and one in five is hours
    late gives every prediction once."""
    base = ST._base(spark, None)
    events = _events(spark, sf_dir)
    late = F.when(F.col("event_id") % 5 == 0, 3).otherwise(0)
    once = ST.arrivals(events, late=late)
    feed = once.unionByName(ST.arrivals(events.filter("event_id % 7 = 0"), late=late + 1))
    ST.in_turns([(feed, f"{base}/feed")], "_arrival", ST.TURNS,
                lambda: ST.append(ST.recorded(ST._folder(spark, f"{base}/feed", events.schema)), base, "record"))
    return ST.table(spark, f"{base}/record", ST.recorded(events).schema).drop("ts")


def stream_live_accuracy(spark, sf_dir):
    """Daily accuracy from predictions joined with truths that come later."""
    base = ST._base(spark, None)
    pred, truth = ST.prediction_feed(_events(spark, sf_dir))
    feeds = [(ST.arrivals(df), f"{base}/{name}") for df, name in ((pred, "predictions"), (truth, "truths"))]

    def start():
        p, t = (ST._folder(spark, path, df.drop("_arrival").schema) for df, path in feeds)
        rows = ST.judged(p, t)
        day = F.date_format(F.to_utc_timestamp("ts", jobs._session_tz(rows)), "yyyy-MM-dd")
        return ST.append(rows.select("uid", day.alias("day"), "pred", "y"), base, "judged")

    ST.in_turns(feeds, "_arrival", ST.TURNS, start)
    return ST.daily_accuracy(ST.table(spark, f"{base}/judged", "uid long, day string, pred int, y int"))


# a reading without truth is told once both streams' watermark (newest - 1 hour) passes its day's wait
STREAM_LIVE_SQL = with_attribution(""", pr AS (
SELECT uid, ts, machine_failure_pred AS pred, CASE WHEN uid % 10 <> 3 THEN machine_failure END AS y FROM a
), wm AS (
SELECT least(max(ts), max(ts + INTERVAL 1 HOUR * (uid % 20)) FILTER (uid % 10 <> 3)) - INTERVAL 1 HOUR AS w FROM pr
)
SELECT strftime(ts, '%Y-%m-%d') AS day, count(y) AS n_judged, round(avg(CASE WHEN pred = y THEN 1 WHEN y IS NOT NULL THEN 0 END), 6) AS accuracy,
       count(*) FILTER (y IS NULL) AS n_unjudged
FROM pr, wm WHERE y IS NOT NULL OR ts + INTERVAL 1 DAY < w GROUP BY 1""")


def stream_machine_sessions(spark, sf_dir):
    """Machine sessions closed by the watermark, from a stream that restarts twice."""
    base = ST._base(spark, None)
    feed = ST.arrivals(_events(spark, sf_dir))
    schema = feed.drop("_arrival").schema
    ST.in_turns([(feed, f"{base}/feed")], "_arrival", ST.TURNS,
                lambda: ST.append(ST.sessions(ST._folder(spark, f"{base}/feed", schema)), base, "sessions"))
    return ST.table(spark, f"{base}/sessions", ST.sessions(_events(spark, sf_dir)).schema)


STREAM_SESSIONS_SQL = with_attribution(""", o AS (
SELECT *, CASE WHEN ts - lag(ts) OVER m <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS opens FROM a WINDOW m AS (PARTITION BY machine_id ORDER BY ts, uid)
), n AS (
SELECT *, sum(opens) OVER (PARTITION BY machine_id ORDER BY ts, uid) AS island FROM o
), i AS (
SELECT machine_id, min(ts) AS s, max(ts) + INTERVAL 12 HOUR AS e, count(*) AS n_readings, CAST(sum(machine_failure_pred) AS BIGINT) AS n_predicted,
       round(max(p), 6) AS max_p
FROM n GROUP BY machine_id, island
)
SELECT machine_id, strftime(s, '%Y-%m-%d %H:%M:%S') AS session_start, strftime(e, '%Y-%m-%d %H:%M:%S') AS session_end, n_readings, n_predicted, max_p
FROM i WHERE e <= (SELECT max(ts) FROM a) - INTERVAL 1 HOUR""")

QUERIES = {
    "stream_retained_state": (stream_retained_state, MONITOR_STATS_SQL),
    "stream_recorded_once": (stream_recorded_once, STREAM_SCORED_SQL),
    "stream_live_accuracy": (stream_live_accuracy, STREAM_LIVE_SQL),
    "stream_machine_sessions": (stream_machine_sessions, STREAM_SESSIONS_SQL),
    "stream_scored": (stream_scored, STREAM_SCORED_SQL),
    "stream_monitor_stats": (stream_monitor_stats, MONITOR_STATS_SQL),
    "stream_failure_rate": (stream_failure_rate, STREAM_RATE_SQL),
    "stream_closed_windows": (stream_closed_windows, STREAM_CLOSED_SQL),
}
