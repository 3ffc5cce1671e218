"""Typed readers for messages, event logs, corpora and captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The message kinds.
MESSAGE_TYPES = [
    "direct",
    "meeting_broadcast_request",
    "meeting_broadcast",
    "meeting_invitation",
    "meeting_invitation_response",
]

MESSAGE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("sender_id", T.StringType()),
    T.StructField("sender_klass", T.StringType()),
    T.StructField("recipient_id", T.StringType()),
    T.StructField("recipient_klass", T.StringType()),
    T.StructField("message_type", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("meeting_id", T.StringType()),
    T.StructField("target_agent_ids", T.ArrayType(T.StringType())),
    T.StructField("stream_id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("agent_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("payload", T.StringType()),
])

# The layout of the stored event table: the type column is open, unknown types keep their payload text.
EVENT_TABLE_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def use_utc(spark: SparkSession) -> None:
    """Zone-free parquet timestamps are read as UTC, so results do not depend on the machine."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def stream_table(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """A stored table as a live source, whether it is one file or a folder of files."""
    use_utc(spark)
    path = f"{root}/{name}.parquet"
    # as a pattern: Spark refuses a plain path to a single file as a live source
    return spark.readStream.schema(schema or spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def read_messages(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    use_utc(spark)
    return spark.read.schema(MESSAGE_SCHEMA).format(fmt).load(path)


def read_event_log(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    use_utc(spark)
    return spark.read.schema(EVENT_SCHEMA).format(fmt).load(path)


def stream_messages(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    use_utc(spark)
    return spark.readStream.schema(MESSAGE_SCHEMA).format(fmt).load(path)


def stream_event_log(spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    use_utc(spark)
    events = spark.readStream.schema(schema).format(fmt).load(path)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def messages_from_turns(conversations: DataFrame) -> DataFrame:
    """Stored conversation turns as messages: conversation = channel, turn = order, role = sender."""
    return conversations.select(
        F.col("conv_id").alias("channel_id"), F.col("turn").alias("seq"),
        F.col("role").alias("sender"), F.col("text").alias("content"),
    )


def event_log_from_table(events: DataFrame) -> DataFrame:
    """The stored event table with agent names and a zone-aware time."""
    return events.select(
        "event_id", F.col("user_id").alias("agent_id"), F.col("ts").cast("timestamp").alias("ts"),
        "event_type", "value", F.col("props").alias("payload"),
    )


def event_payload(events: DataFrame, schema: str) -> DataFrame:
    """Typed view of the payload; malformed payload text gives null fields and keeps the row."""
    return events.withColumn("fields", F.from_json("payload", schema))


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """Captured pages with a success flag: a page without a body is a failed capture."""
    pages = read_table(spark, root, "pages")
    ok = F.coalesce(F.length("html") > 0, F.lit(False))
    return pages.select(
        "page_id", "url", "html", ok.alias("success"), F.when(~ok, F.lit("empty body")).alias("error")
    )
