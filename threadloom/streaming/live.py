"""Live jobs on Structured Streaming: throughput, state, responses, routing, logs, replay, incremental corpora."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.functions.checkpoints import ensure_checkpoint_dir
from threadloom.operators.batching import span_durations
from threadloom.operators.events import throughput
from threadloom.operators.messages import fan_out, notify_observers, route_events
from threadloom.operators.state import latest_state
from threadloom.sources.corpus import skip_unchanged


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for a run under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there, write it to files and read it back; nothing passes the driver."""
    spark = stream.sparkSession
    root = work_folder(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/data")
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")


class EndMarks:
    """Closes event time of live sources: one row far in the future, after everything else has been read.

    ``add`` gives a stream a second source, a folder without rows; ``close`` puts the mark there.  A mark has the given
    values, the time, and nulls.  Columns that are filtered or joined need a value: a mark that is filtered out does not
    move the watermark.  Drop what comes of the marks themselves.
    """

    def __init__(self, spark: SparkSession, at: str = "2100-01-01 00:00:00"):
        self.spark, self.at, self.folders = spark, at, []

    def add(self, stream: DataFrame, ts: str = "ts", **values) -> DataFrame:
        folder = work_folder(self.spark, "marks")
        self.spark.createDataFrame([], stream.schema).write.parquet(folder)
        self.folders.append((folder, stream.schema, values | {ts: self.at}))
        return stream.unionByName(self.spark.readStream.schema(stream.schema).parquet(folder))

    def close(self) -> None:
        for folder, schema, values in self.folders:
            row = [F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema]
            self.spark.range(1).select(*row).write.mode("append").parquet(folder)


def run_to_end(stream: DataFrame, name: str, marks: EndMarks, mode: str = "append") -> DataFrame:
    """As ``run_available``, then once more from the same checkpoint after the end marks: nothing stays in the state."""
    spark = stream.sparkSession
    root = work_folder(spark, name)
    for closing in (False, True):
        if closing:
            marks.close()
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/data").option(
            "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")


def run_complete(stream: DataFrame, name: str) -> DataFrame:
    """As ``run_available`` for an aggregate whose rows change: the last full result counts."""
    spark = stream.sparkSession
    root = work_folder(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/data")

    query = (
        stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")


def live_throughput(events: DataFrame, width: str, slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    return throughput(events.withWatermark("ts", watermark), width, slide)


def live_latest_state(changes: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Last value per key in complete or update mode."""
    return latest_state(changes, keys, value)


def dedupe_stream(messages: DataFrame, id_column: str, ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """One delivery per message id, also when it was streamed and sent."""
    if not messages.isStreaming:
        return messages.dropDuplicates([id_column])
    return messages.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([id_column])


def await_responses_live(invites: DataFrame, responses: DataFrame, key: str, timeout: str = "30 seconds", watermark: str = "10 seconds") -> DataFrame:
    """Status per invite; without a response inside the limit the watermark turns it into a timeout.

    An invite with several responses comes once for each, with the response's time; the first one counts.
    """
    left = invites.withWatermark("ts", watermark)
    right = responses.select(F.col(key).alias("_key"), F.col("ts").alias("_rts"), "accepted").withWatermark("_rts", watermark)
    joined = left.join(
        right, F.expr(f"{key} = _key AND _rts >= ts AND _rts <= ts + interval {timeout}"), "left_outer"
    )
    status = F.when(F.col("_key").isNull(), F.lit("timeout")).when(F.col("accepted"), F.lit("accepted")).otherwise(F.lit("rejected"))
    return joined.select(*invites.columns, status.alias("status"), F.col("_rts").alias("responded_at"))


def span_durations_live(starts: DataFrame, ends: DataFrame, key: str, bound: str, watermark: str = "10 seconds") -> DataFrame:
    """Durations of live start/end pairs: a start waits until the watermark is ``bound`` past it, an end until it is past it."""
    return span_durations(starts.withWatermark("ts", watermark), ends.withWatermark("end_ts", watermark), key, bound)


def deliver_live(
    stream: DataFrame, deliver: Callable[[DataFrame, DataFrame], DataFrame], members: Callable[[SparkSession], DataFrame], path: str, checkpoint: str,
) -> StreamingQuery:
    """Join each micro-batch with memberships that are read anew for it; a repeated micro-batch replaces its own folder.

    ``deliver`` is ``fan_out``, ``notify_observers`` or any join of a batch with members.  A stream-static join would keep
    the member files that were there when the query started.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        deliver(batch, members(batch.sparkSession)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fan_out_live(messages: DataFrame, members: Callable[[SparkSession], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """One delivery per current participant of the channel, the sender excluded."""
    return deliver_live(messages, fan_out, members, path, checkpoint)


def notify_observers_live(events: DataFrame, observers: Callable[[SparkSession], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Current observers of the channel see each live event that they may see."""
    return deliver_live(events, notify_observers, observers, path, checkpoint)


def route_stream(
    events: DataFrame, subscriptions: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], errors_path: str, checkpoint: str,
) -> StreamingQuery:
    """Deliver each micro-batch to every subscriber's sink; a failing one is recorded and stops no other."""

    def deliver(batch: DataFrame, batch_id: int) -> None:
        routed = route_events(batch, subscriptions).persist()
        failures = []
        try:
            for subscriber, sink in sinks.items():
                try:
                    sink(routed.filter(F.col("subscriber_id") == subscriber), batch_id)
                except Exception as error:  # noqa: BLE001 - any failure of one sink stays its own
                    failures.append((subscriber, batch_id, type(error).__name__, str(error)))
        finally:
            routed.unpersist()
        if failures:
            schema = "subscriber_id string, batch_id bigint, error_type string, error_text string"
            batch.sparkSession.createDataFrame(failures, schema).write.mode("append").parquet(errors_path)

    return (
        events.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_log_sink(items: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append log items to files; a repeated micro-batch replaces its own folder, so nothing is written twice."""
    shown = items.select(
        "event_id", "ts", "agent_id", F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.col("event_type").alias("type"), F.col("payload").alias("content"),
        F.create_map(F.lit("event_id"), F.col("event_id").cast("string")).alias("metadata"),
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return shown.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Written last, with the history's cut: a history without it was not finished.
COMMITTED = "_history_committed"


def replay_then_follow(
    history: DataFrame, live: DataFrame, path: str, checkpoint: str, id_column: str = "event_id", ts: str = "ts", watermark: str = "1 hour",
) -> StreamingQuery:
    """Write the history once, then follow the live stream without the events the history has.

    The history is committed by a marker with its latest time.  A start that finds no marker writes it again, whatever
    half of it is there; with a marker it is left as it is.  Live events up to the cut are compared with the history's
    ids, later ones cannot be in it and pass by.  Repeats inside the stream are dropped within the watermark, so the
    state does not grow with the stream.  Events without a time are compared as well.
    """
    spark = history.sparkSession
    target, marker = f"{path}/part=history", f"{path.rstrip('/')}.{COMMITTED}"
    if not _exists(spark, marker):
        history.write.mode("overwrite").parquet(target)
        spark.read.schema(history.schema).parquet(target).agg(F.max(ts).alias("cut")).write.mode("overwrite").parquet(marker)
    cut = spark.read.parquet(marker).first()["cut"]
    known = spark.read.schema(history.schema).parquet(target).select(id_column).distinct()
    fresh = live.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([id_column])

    def write(batch: DataFrame, batch_id: int) -> None:
        early = F.lit(False) if cut is None else F.coalesce(F.col(ts) <= F.lit(cut), F.lit(True))
        both = batch.filter(early).join(known, id_column, "left_anti").select(*batch.columns).unionAll(batch.filter(~early))
        both.write.mode("overwrite").parquet(f"{path}/part=live-{batch_id}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    """A folder that a finished write has marked."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def incremental_corpus(
    files: DataFrame, manifest_path: str, output_path: str, process: Callable[[DataFrame], DataFrame], checkpoint: str,
    key: str = "path", text: str = "text",
) -> StreamingQuery:
    """Process only new or changed files of a live listing; the manifest grows with each micro-batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = f"{key} {batch.schema[key].dataType.simpleString()}, content_hash string"
        spark.createDataFrame([], schema).write.mode("append").parquet(manifest_path)
        # folders of this very batch are left out, so a repeated batch does the same work again
        manifest = spark.read.schema(f"{schema}, batch_id bigint").parquet(manifest_path).filter(
            F.col("batch_id").isNotNull() & (F.col("batch_id") < batch_id)
        )
        fresh = skip_unchanged(batch, manifest, key, text)
        process(fresh.drop("content_hash")).write.mode("overwrite").parquet(f"{output_path}/batch_id={batch_id}")
        fresh.select(key, "content_hash").write.mode("overwrite").parquet(f"{manifest_path}/batch_id={batch_id}")

    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
