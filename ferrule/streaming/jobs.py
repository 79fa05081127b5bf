"""Structured Streaming jobs (N1, N2 on a stream, W3).

The reference appends predictions to an in-process list and aggregates it on
demand; here scoring is a streaming query over the readings feed with a
checkpoint, predictions land in an append-only table, and monitoring reads
that table.  Output and checkpoint folders live under the session's shared
``spark.checkpoint.dir`` (never a machine-local folder), so a restarted job
resumes from its checkpoint after executor or driver loss.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule import schema as S
from ferrule.operators import scoring as SC
from ferrule.operators import summary as SU
from ferrule.session import scratch_path
from ferrule.sources.readings import readings_from_events


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def events_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """File stream over the events table, a folder of files or a single file
    (schema taken from the batch read, never inferred per micro-batch)."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    fs, p = _fs(spark, path)
    if fs.getFileStatus(p).isDirectory():
        return reader.parquet(path)
    # the file source watches a folder; a single file is picked by its exact name
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _session_tz(df: DataFrame) -> str:
    return df.sparkSession.conf.get("spark.sql.session.timeZone")


def event_instant(df: DataFrame, col: str = S.TS):
    """Event time as an instant whose UTC wall clock equals the reading's
    wall clock (``ts`` has no time zone).  Watermarks need an instant; this
    keeps windows aligned to the readings' days whatever the session zone."""
    return F.from_utc_timestamp(F.col(col).cast("timestamp"), _session_tz(df))


def scored_stream(events: DataFrame) -> DataFrame:
    """Readings -> fixed scorer -> attribution, per micro-batch (stateless)."""
    scored = SC.attribute(SC.with_linear_score(readings_from_events(events)))
    return scored.select(
        S.UID, S.MACHINE_ID, event_instant(scored).alias(S.TS), S.TYPE, *S.SENSORS,
        "p", "machine_failure_pred", "most_likely_type", "maintenance_recommendation",
        "prob_twf", "prob_hdf", "prob_pwf", "prob_osf", "prob_rnf",
    )


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete ``v<N>`` sub-folders (those with a success mark)."""
    fs, path = _fs(spark, folder)
    if not fs.exists(path):
        return []
    jvm = spark.sparkContext._jvm
    names = [st.getPath().getName() for st in fs.listStatus(path)]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()
                  and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


HISTORY_SCHEMA = f"{S.UID} long, {S.TS} timestamp, p double, machine_failure_pred int, most_likely_type string"


def run_scoring(spark: SparkSession, sf_dir: str, out: str | None = None,
                keep: int = S.HISTORY_KEEP, max_files: int | None = None) -> tuple[str, str]:
    """Run N1 to completion (availableNow) and maintain the retained history
    (N2) in the same micro-batch: the newest ``keep`` rows of (kept history
    + batch), rewritten by a top-k.  Returns (predictions path, history path).

    Both writes are idempotent per epoch: predictions go to ``epoch=<id>``, and
    history version ``v<id+1>`` is built from the newest complete version up to
    ``v<id>``, so a replayed or half-written batch is rebuilt from the same
    rows.  The two newest versions stay, for the replay.  A stream without
    input leaves an empty history and no predictions."""
    base = out or scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    preds, hist, ckpt = f"{base}/predictions", f"{base}/history", f"{base}/_checkpoint"

    def sink(batch: DataFrame, epoch_id: int) -> None:
        batch = batch.persist()  # written twice: scored once per micro-batch
        try:
            batch.write.mode("overwrite").parquet(f"{preds}/epoch={epoch_id}")
            merged = batch.select(S.UID, S.TS, "p", "machine_failure_pred", "most_likely_type")
            before = [v for v in _versions(spark, hist) if v <= epoch_id]
            if before:
                merged = spark.read.parquet(f"{hist}/v{before[-1]}").unionByName(merged)
            SU.last_n(merged, keep).write.mode("overwrite").parquet(f"{hist}/v{epoch_id + 1}")
            for v in before[:-1]:
                fs, path = _fs(spark, f"{hist}/v{v}")
                fs.delete(path, True)
        finally:
            batch.unpersist()

    q = (
        scored_stream(events_stream(spark, sf_dir, max_files))
        .writeStream.foreachBatch(sink)
        .option("checkpointLocation", ckpt)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    done = _versions(spark, hist)
    if not done:
        spark.createDataFrame([], HISTORY_SCHEMA).write.mode("overwrite").parquet(f"{hist}/v0")
        empty = scored_stream(spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")).limit(0)
        empty.write.mode("overwrite").parquet(f"{preds}/epoch=0")
        done = [0]
    return preds, f"{hist}/v{done[-1]}"


def windowed_failure_rate(events: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Predicted failure rate per event-time window, watermarked so the
    state of closed windows is dropped."""
    scored = scored_stream(events)
    return (
        scored.withWatermark(S.TS, watermark)
        .groupBy(F.window(S.TS, window).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n_readings"),
            F.sum("machine_failure_pred").cast("long").alias("n_predicted"),
            F.avg("p").alias("avg_p"),
        )
        .select(
            # render the UTC wall clock of the window start (session-zone independent)
            F.date_format(F.to_utc_timestamp("w.start", _session_tz(events)), "yyyy-MM-dd HH:mm:ss")
            .alias("window_start"),
            "n_readings", "n_predicted",
            F.round(F.col("n_predicted") / F.col("n_readings"), 6).alias("failure_rate"),
            F.round("avg_p", 6).alias("avg_p"),
        )
    )


def run_windowed_rate(spark: SparkSession, sf_dir: str, out: str | None = None,
                      output_mode: str = "append", window: str = "1 day") -> str:
    """Run W3 to completion.  ``append`` emits only windows closed by the
    watermark (streaming semantics: the newest, still open window is not
    emitted); ``complete`` rewrites the full window table every batch."""
    base = out or scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    table, ckpt = f"{base}/rates", f"{base}/_checkpoint"
    agg = windowed_failure_rate(events_stream(spark, sf_dir), window)
    writer = agg.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
    if output_mode == "append":
        q = writer.outputMode("append").format("parquet").option("path", table).start()
    elif output_mode == "complete":
        def sink(batch: DataFrame, epoch_id: int) -> None:
            batch.write.mode("overwrite").parquet(table)

        q = writer.outputMode("complete").foreachBatch(sink).start()
    else:
        raise ValueError("output_mode must be append or complete")
    q.awaitTermination()
    return table
