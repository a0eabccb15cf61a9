"""The audit log as a stream: counts per stage and window, payloads in force, calls with their outputs.

Lateness: all files that wait when a run starts are one batch, so nothing in
them is late, in whatever order and number of files they came. An event that
arrives in a later run is late, and left out, once its time is before the
latest time of earlier runs by more than the allowed lateness; a repeat within
the lateness is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from galley.operators import audit as A

LATEST = (
    "start timestamp, run_id string, stage string, whole struct<seq:bigint,payload:string>, "
    "last struct<seq:bigint,payload:string>"
)
SCHEMA = "event_id bigint, ts timestamp, run_id string, stage string, error string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path)


def stage_counts(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events and errors per window and stage; repeats of an event within the lateness are dropped."""
    return (
        events.withWatermark("ts", late)
        .dropDuplicatesWithinWatermark(["event_id"])
        .groupBy(F.window("ts", window), "stage")
        .agg(F.count(F.lit(1)).alias("events"), F.count("error").alias("errors"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "stage", "events", "errors")
    )


def write_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to parquet and stop when the log is read."""
    return (
        counts.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def pair_tools(events: DataFrame, late: str = "1 hour", how: str = "left") -> DataFrame:
    """Calls joined with their outputs as they arrive; calls without output come out last.

    An output must follow its call within the lateness, which bounds the state.
    A call with several outputs has a row for each. With ``how="full"`` outputs
    that came too late, or without a call, have rows too, with their
    ``output_id`` and no call; otherwise they are left out.
    """
    calls = events.where(F.col("kind") == "call").select(
        F.col("call_id"), F.col("ts").alias("called_at"), "tool_name"
    ).withWatermark("called_at", late)
    outputs = events.where(F.col("kind") == "output").select(
        F.col("call_id").alias("output_id"), F.col("ts").alias("done_at"), "payload"
    ).withWatermark("done_at", late)
    near = (
        (F.col("call_id") == F.col("output_id"))
        & (F.col("done_at") >= F.col("called_at"))
        & (F.col("done_at") <= F.col("called_at") + F.expr(f"interval {late}"))
    )
    joined = calls.join(outputs, near, how)
    return joined if how == "full" else joined.drop("output_id")


def latest_partials(payloads: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Per window of time, run and stage the last payload (seq, payload) and the last complete one so far.

    Rows hold ts, run_id, stage, seq and payload. State is kept for open windows
    only; parts of several windows and batches are put together by ``read_latest``.
    """
    bare = payloads.withWatermark("ts", late).withColumn("payload", A.unwrap(F.col("payload"), F.col("stage")))
    each = F.struct("seq", "payload")
    return (
        bare.withColumn("complete", A.is_complete(F.col("payload"), F.col("stage")))
        .groupBy(F.window("ts", window), "run_id", "stage")
        .agg(F.max(F.when(F.col("complete"), each)).alias("whole"), F.max(each).alias("last"))
        .select(F.col("window.start").alias("start"), "run_id", "stage", "whole", "last")
    )


def keep_latest(partials: DataFrame, path: str, checkpoint: str, writer: str = "latest") -> StreamingQuery:
    """Write the groups that a batch has changed, each batch once."""
    return (
        partials.writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, path, writer))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """Payload in force per run and stage: the last complete one, else the last one.

    A later state of a group is never smaller than an earlier one, so the
    largest of all that was written is the state now.
    """
    parts = spark.read.schema(LATEST).json(path)
    now = parts.groupBy("run_id", "stage").agg(F.max("whole").alias("whole"), F.max("last").alias("last"))
    return now.select(
        "run_id", "stage", F.when(F.col("whole").isNull(), F.col("last.payload")).otherwise(F.col("whole.payload")).alias("payload"),
        F.col("whole").isNotNull().alias("complete"),
    )


def write_batch(batch: DataFrame, batch_id: int, path: str, writer: str) -> None:
    """One batch of a writer as a folder of its own, replaced as a whole when the batch is run again."""
    batch.write.mode("overwrite").json(f"{path}/writer={writer}/batch={batch_id}")


def append_log(events: DataFrame, path: str, checkpoint: str, writer: str = "audit") -> StreamingQuery:
    """Append events to the log as they arrive, each once.

    A batch that is run again after a failure has the same number and the same
    events, and takes the place of what it wrote before. Several writers may
    share a log; each has a name and a checkpoint of its own.
    """
    return (
        events.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, path, writer))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
