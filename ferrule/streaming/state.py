"""Streams with state of their own (N1, N2, C7, machine sessions).

* ``retained``: the newest rows of the feed as streaming state, sharded, each
  shard a list capped at the number retained (N2).
* ``recorded``: predictions recorded once, whatever is repeated or late (N1).
* ``judged``: predictions joined with the truth that comes later (C7).
* ``sessions``: each machine's runs of readings, closed by the watermark.

State and output live under the shared ``spark.checkpoint.dir``: a restarted job
goes on from its state store.  Each write of an epoch replaces the same epoch.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ferrule import schema as S
from ferrule.functions import rules
from ferrule.operators import scoring as SC
from ferrule.operators import summary as SU
from ferrule.session import scratch_path
from ferrule.sources.readings import readings_from_events
from ferrule.streaming.jobs import _fs, _session_tz, event_instant, scored_stream

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHARDS = 16
TURNS = 3
ROW_SCHEMA = "uid long, at long, p double, machine_failure_pred int, most_likely_type string"


def _base(spark: SparkSession, out: str | None) -> str:
    return out or scratch_path(spark, f"stream-{uuid.uuid4().hex}")


def _folder(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def table(spark: SparkSession, path: str, schema) -> DataFrame:
    """What a stream has written to ``path``; empty where nothing came yet."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def in_turns(feeds: list[tuple[DataFrame, str]], arrival: str, turns: int, run: Callable[[], StreamingQuery]) -> None:
    """Writes the feeds to their folders in ``turns`` parts by arrival (a column of
    micros, dropped), and runs the stream to completion after each: every part is
    one micro-batch, and every turn but the first is a restart."""
    first = feeds[0][0]
    cuts = first.agg(F.percentile_approx(arrival, [k / turns for k in range(1, turns)], 1000)).first()[0] or []
    for k in range(turns):
        part = F.lit(True)
        if k:
            part = part & (F.col(arrival) > (cuts[k - 1] if cuts else 0))
        if k < turns - 1 and cuts:
            part = part & (F.col(arrival) <= cuts[k])
        elif k < turns - 1:
            part = F.lit(False)  # an empty feed
        for df, path in feeds:
            df.filter(part).drop(arrival).write.mode("append").parquet(path)
        run().awaitTermination()


class Newest(StatefulProcessor):
    """The newest ``keep`` rows of a shard by (at, uid); gives the whole list when
    it changed."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", ROW_SCHEMA)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        before = [(r[1], r[0], *r[2:]) for r in self.rows.get()] if self.rows.exists() else []
        kept = before
        for frame in rows:
            new = zip(frame["at"].tolist(), frame["uid"].tolist(), frame["p"].tolist(),
                      frame["machine_failure_pred"].tolist(), frame["most_likely_type"].tolist())
            kept = heapq.nlargest(self.keep, [*kept, *new], key=lambda r: r[:2])
        if kept != before:
            self.rows.put([(r[1], r[0], *r[2:]) for r in kept])
            import pandas as pd

            yield pd.DataFrame([(int(key[0]), r[1], r[0], *r[2:]) for r in kept], columns=[
                "shard", "uid", "at", "p", "machine_failure_pred", "most_likely_type"])

    def close(self) -> None:
        pass


def run_retained(events: DataFrame, base: str, keep: int = S.HISTORY_KEEP, shards: int = SHARDS) -> StreamingQuery:
    """Starts the stream of readings into its retained state.  A row of the
    newest ``keep`` is among its shard's newest ``keep``, so no shard holds more,
    and no task sees all rows."""
    spark = events.sparkSession
    scored = scored_stream(events)
    rows = scored.select(
        F.pmod(F.xxhash64(S.UID), F.lit(shards)).cast("int").alias("shard"), F.col(S.UID).alias("uid"),
        F.unix_micros(S.TS).alias("at"), "p", "machine_failure_pred", "most_likely_type")
    lists = rows.groupBy("shard").transformWithStateInPandas(
        Newest(keep), outputStructType=f"shard int, {ROW_SCHEMA}", outputMode="Update", timeMode="None")

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/lists/epoch={epoch}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return (lists.writeStream.outputMode("update").foreachBatch(sink)
                .option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).start())
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def retained(spark: SparkSession, base: str, keep: int = S.HISTORY_KEEP) -> DataFrame:
    """The newest ``keep`` rows of all shards' newest lists."""
    lists = table(spark, f"{base}/lists", f"shard int, {ROW_SCHEMA}, epoch long")
    newest = lists.groupBy("shard").agg(F.max("epoch").alias("epoch"))  # one row a shard
    rows = lists.join(F.broadcast(newest), ["shard", "epoch"])
    return SU.last_n(rows.select(F.col("uid").alias(S.UID), F.timestamp_micros("at").alias(S.TS), "p", "machine_failure_pred",
                                 "most_likely_type"), keep)


def recorded(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Scored readings, each uid once while repeats come within ``delay`` of
    event time; rows later than that are not taken."""
    return scored_stream(events).withWatermark(S.TS, delay).dropDuplicatesWithinWatermark([S.UID])


def judged(predictions: DataFrame, truths: DataFrame, wait: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Predictions (uid, ts, pred) with the truth (uid, ts, y) that came within
    ``wait`` after them; a prediction whose time is up without one has y null."""
    p = predictions.select(F.col("uid"), F.col("ts"), "pred").withWatermark("ts", delay)
    t = truths.select(F.col("uid").alias("t_uid"), F.col("ts").alias("t_ts"), "y").withWatermark("t_ts", delay)
    cond = (F.col("uid") == F.col("t_uid")) & (F.col("t_ts") >= F.col("ts")) & (
        F.col("t_ts") <= F.col("ts") + F.expr(f"INTERVAL {wait}"))
    return p.join(t, cond, "left_outer").select("uid", "ts", "pred", "y")


def daily_accuracy(rows: DataFrame, digits: int = 6) -> DataFrame:
    """Per day of the prediction: rows with a truth, their accuracy, rows whose
    truth never came."""
    return rows.groupBy("day").agg(
        F.count("y").alias("n_judged"), F.round(F.avg((F.col("pred") == F.col("y")).cast("int")), digits).alias("accuracy"),
        F.count(F.when(F.col("y").isNull(), 1)).alias("n_unjudged"))


def sessions(events: DataFrame, gap: str = "12 hours", delay: str = "1 hour") -> DataFrame:
    """Readings of a machine that follow each other within ``gap``: one row per
    session, once the watermark has closed it."""
    scored = scored_stream(events)
    wall = lambda c: F.date_format(F.to_utc_timestamp(c, _session_tz(events)), "yyyy-MM-dd HH:mm:ss")
    return (
        scored.withWatermark(S.TS, delay)
        .groupBy(F.session_window(S.TS, gap).alias("w"), S.MACHINE_ID)
        .agg(F.count(F.lit(1)).alias("n_readings"), F.sum("machine_failure_pred").cast("long").alias("n_predicted"),
             F.round(F.max("p"), 6).alias("max_p"))
        .select(S.MACHINE_ID, wall("w.start").alias("session_start"), wall("w.end").alias("session_end"),
                "n_readings", "n_predicted", "max_p")
    )


def append(stream: DataFrame, base: str, name: str) -> StreamingQuery:
    """Starts the stream into the table ``base/name``; runs to what is there."""
    return (stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/{name}")
            .option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).start())


def arrivals(df: DataFrame, col: str = "ts", late: F.Column | None = None) -> DataFrame:
    """``df`` with ``_arrival``: micros of its time plus ``late`` hours."""
    micros = F.unix_micros(F.col(col).cast("timestamp"))
    return df.withColumn("_arrival", micros + (late if late is not None else F.lit(0)) * 3_600_000_000)


def prediction_feed(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(predictions, truths) of the readings: the truth of a reading comes hours
    after it (uid modulo 20), and never for one in ten."""
    rows = SC.with_linear_score(rules.label_failures(readings_from_events(events)))
    at = event_instant(rows)
    pred = rows.select(F.col(S.UID).alias("uid"), at.alias("ts"), (F.col("p") > 0.5).cast("int").alias("pred"))
    hours = F.col(S.UID) % 20
    truth = rows.filter(F.col(S.UID) % 10 != 3).select(
        F.col(S.UID).alias("uid"), (at + F.make_interval(hours=hours.cast("int"))).alias("ts"), F.col("machine_failure").alias("y"))
    return pred, truth
