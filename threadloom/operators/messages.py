"""Message routing: fan-out, gating, membership, targets, queues and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.ordered import (
    ROWS_PER_TASK, Running, count_rows, index_block, running, settle, split_if_hot,
)
from threadloom.functions.skew import salted_join
from threadloom.functions.text import meeting_tag, parse_entity, strip

# Fixed value: the text of the marker that ends a batch.
END_MARKER = "<eom>"
# Fixed value: class name of human agents.
HUMAN_KLASS = "HumanAgent"


def fan_out(messages: DataFrame, members: DataFrame, salts: int = 8) -> DataFrame:
    """One delivery per participant of the channel, the sender excluded."""
    joined = salted_join(messages, members.select("channel_id", F.col("participant_id").alias("recipient")), ["channel_id"], salts=salts)
    return joined.filter(~F.col("sender").eqNullSafe(F.col("recipient")))


def notify_observers(stream_events: DataFrame, observers: DataFrame, salts: int = 8) -> DataFrame:
    """Observers of the channel see an event when their target or the recipient is null, or both are equal.

    One equi-join: an event without a recipient asks for all observers; any other asks for those of its recipient and
    for those without a target.  No pair is made that is not delivered.
    """
    own = lambda c: F.concat(F.lit("="), F.col(c))
    asked = F.when(F.col("recipient").isNull(), F.array(F.lit("all"))).otherwise(F.array(own("recipient"), F.lit("any")))
    known = F.array(F.lit("all"), F.when(F.col("target").isNull(), F.lit("any")).otherwise(own("target")))
    seen = observers.select("channel_id", "observer_id", "target", F.explode(known).alias("_wanted"))
    return salted_join(stream_events.withColumn("_wanted", F.explode(asked)), seen, ["channel_id", "_wanted"], salts=salts).drop("_wanted")


def normalise_prefs(prefs: DataFrame) -> DataFrame:
    """Apply the cross-field rules: a streaming channel streams, a buffered one buffers and does not stream.

    ``is_valid`` is false for a chunk size below 1, a negative timeout or a custom channel without a handler.
    """
    channel = F.coalesce(F.col("channel"), F.lit("streaming"))
    streaming = F.when(channel == "streaming", F.lit(True)).when(channel == "buffered", F.lit(False)).otherwise(
        F.coalesce("streaming_enabled", F.lit(True))
    )
    out = prefs.withColumns({
        "channel": channel,
        "streaming_enabled": streaming,
        "buffer_messages": F.when(channel == "buffered", F.lit(True)).otherwise(F.coalesce("buffer_messages", F.lit(False))),
        "meeting_notifications": F.coalesce("meeting_notifications", F.lit("targeted")),
        "streaming_chunk_size": F.coalesce("streaming_chunk_size", F.lit(1)),
        "buffer_timeout": F.coalesce("buffer_timeout", F.lit(5.0)),
    })
    handler = F.coalesce(F.col("has_handler"), F.lit(False)) if "has_handler" in prefs.columns else F.lit(False)
    return out.withColumn(
        "is_valid",
        (F.col("streaming_chunk_size") >= 1) & (F.col("buffer_timeout") >= 0) & ((channel != "custom") | handler),
    )


def gate_delivery(messages: DataFrame, members: DataFrame, prefs: DataFrame, salts: int = 8) -> DataFrame:
    """Members who get a meeting message at once, by their notification preference.

    Targeted members are in the target list, or their name or class appears in the text.
    """
    people = members.join(
        prefs.select("participant_id", "name", "klass", "streaming_enabled", "meeting_notifications"), "participant_id"
    )
    people = people.filter(F.col("streaming_enabled") & (F.col("meeting_notifications") != "none"))
    joined = salted_join(messages, people, ["channel_id"], salts=salts)
    text = F.lower("content")
    listed = (
        F.coalesce(F.array_contains("target_agent_ids", F.col("participant_id")), F.lit(False))
        if "target_agent_ids" in messages.columns else F.lit(False)
    )
    mentioned = text.contains(F.lower("name")) | text.contains(F.lower("klass"))
    return joined.filter(
        (F.col("meeting_notifications") == "all") | listed | F.coalesce(mentioned, F.lit(False))
    )


def route_events(events: DataFrame, subscriptions: DataFrame, salts: int = 8) -> DataFrame:
    """Events to subscribers of their type and to wildcard subscribers; repeated subscriptions repeat.

    Every event carries two routes, its type and ``*``, so this is one equi-join; ``is_wildcard``
    orders the deliveries of an event.
    """
    routed = events.withColumn("route", F.explode(F.array(F.col("event_type"), F.lit("*"))))
    joined = salted_join(routed, subscriptions.select(F.col("event_type").alias("route"), "subscriber_id"), ["route"], salts=salts, merge=False)
    return joined.withColumn("is_wildcard", F.col("route") == "*").drop("route")


def subscriber_counts(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.groupBy("event_type").agg(F.count(F.lit(1)).alias("subscribers"))


def reject_non_members(messages: DataFrame, members: DataFrame, salts: int = 8) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a sender must belong to the channel."""
    who = members.select("channel_id", F.col("participant_id").alias("sender")).distinct()
    keys = ["channel_id", "sender"]
    return salted_join(messages, who, keys, "left_semi", salts), salted_join(messages, who, keys, "left_anti", salts)


def select_for_listener(messages: DataFrame, spec: str, joined: DataFrame | None = None) -> DataFrame:
    """Messages a listener waits for.  The end marker always matches.

    ``*`` means everything except messages of meetings in ``joined(meeting_id)``; otherwise ``human``,
    ``meeting X``, ``agent X`` or a bare agent id.
    """
    marker = F.col("content") == END_MARKER
    if spec == "*":
        if joined is None:
            return messages
        kept = salted_join(messages.filter(~F.coalesce(marker, F.lit(False))), joined.select("meeting_id").distinct(), ["meeting_id"], "left_anti")
        return kept.unionByName(messages.filter(marker))
    wanted = parse_entity(F.lit(spec))
    match = F.when(wanted["kind"] == "meeting", F.col("meeting_id").cast("string") == wanted["id"]).otherwise(
        F.col("sender").cast("string") == wanted["id"]
    )
    return messages.filter(marker | match)


def resolve_targets(requests: DataFrame, directory: DataFrame, context: DataFrame) -> DataFrame:
    """Resolve the target text of each request to an agent or meeting.

    ``requests(request_id, agent_id, target)``, ``directory(agent_id, klass)``, ``context(agent_id,
    meeting_id, last_target)``.  A class name takes the first other agent by id.
    """
    by_class = directory.groupBy(F.col("klass").alias("_target")).agg(
        F.min("agent_id").alias("_first")
    )
    # the next agent of each class is the answer when the asker itself is the first one
    seconds = (
        directory.join(by_class, directory["klass"] == by_class["_target"])
        .filter(F.col("agent_id") > F.col("_first"))
        .groupBy("_target").agg(F.min("agent_id").alias("_second"))
    )
    lookup = by_class.join(seconds, "_target", "left")
    asked = requests.withColumn("_target", strip(F.col("target")))
    facts = asked.join(context, "agent_id", "left").join(lookup, "_target", "left")
    t = F.col("_target")
    meeting = F.when(F.col("meeting_id").isNotNull(), F.concat(F.lit("meeting "), F.col("meeting_id").cast("string")))
    last = F.col("last_target").cast("string")
    other = F.when(F.col("_first") == F.col("agent_id"), F.col("_second")).otherwise(F.col("_first")).cast("string")
    explicit = (
        F.when(F.lower(t).isin("human", "user"), F.lit("human"))
        .when(t == "meeting", meeting)
        .when(t.startswith("meeting "), t)
        .when(t.startswith("agent "), parse_entity(t)["id"])
        .when(t.rlike(r"^\d+\z"), t)
        .when(t == "last_non_human_agent", F.when(last != "human", last))
        .otherwise(other)
    )
    resolved = F.when(t.isNull(), F.coalesce(meeting, last, F.lit("human"))).otherwise(F.coalesce(explicit, F.lit("human")))
    return facts.select(*requests.columns, resolved.alias("resolved"))


def classify_channels(members: DataFrame) -> DataFrame:
    """Direct (two participants) or meeting; a direct channel is named by its sorted pair."""
    sized = members.select("channel_id", "participant_id").distinct().groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("participants"),
        F.min("participant_id").alias("_low"), F.max("participant_id").alias("_high"),
    )
    return sized.select(
        "channel_id", "participants",
        F.when(F.col("participants") == 2, F.lit("direct")).when(F.col("participants") > 2, F.lit("meeting")).otherwise(F.lit("single")).alias("kind"),
        F.when(F.col("participants") == 2, F.concat_ws("_", "_low", "_high")).alias("pair_id"),
    )


def group_agents(agents: DataFrame, block: Column | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Agents by class: the position of each agent in its class and the size of the class.

    One row per agent instead of one list per class, so a very large class stays spread out.
    """
    block = index_block(F.col("agent_id"), rows_per_task) if block is None else block
    block = split_if_hot(agents, ["klass"], block, rows_per_task)
    return running(
        agents.select("klass", "agent_id"), ["klass"], ["agent_id"], block,
        position=count_rows(), _after=count_rows(inclusive=False, reverse=True),
    ).select("klass", "agent_id", "position", (F.col("position") + F.col("_after")).alias("class_size"))


def drop_already_streamed(messages: DataFrame, streams: DataFrame, salts: int = 8) -> DataFrame:
    """A message that was already delivered as a stream is not delivered again."""
    return salted_join(messages, streams.select("stream_id").distinct(), ["stream_id"], "left_anti", salts)


def unread(messages: DataFrame, cursors: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Messages after each reader's last index.  A reader without a cursor has read nothing."""
    block = split_if_hot(messages, ["channel_id"], index_block(F.col("seq"), rows_per_task), rows_per_task)
    indexed = running(messages, ["channel_id"], ["seq"], block, _n=count_rows())
    joined = salted_join(indexed, cursors.select("channel_id", "reader", "last_index"), ["channel_id"])
    return joined.withColumn("position", F.col("_n") - 1).filter(
        F.col("position") >= F.coalesce("last_index", F.lit(0))
    ).drop("_n", "last_index")


def mark_read(messages: DataFrame, readers: DataFrame) -> DataFrame:
    """Cursors moved to the end of each channel's history."""
    totals = messages.groupBy("channel_id").agg(F.count(F.lit(1)).alias("last_index"))
    return readers.join(totals, "channel_id", "left").withColumn("last_index", F.coalesce("last_index", F.lit(0)))


def queue_order(
    messages: DataFrame, key: str = "recipient", order: list[str] | None = None,
    block: Column | None = None, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Reading position of an unread backlog: a priority message goes to the front, the others to the end."""
    order = order or ["seq"]
    block = index_block(F.col(order[0]), rows_per_task) if block is None else block
    block = split_if_hot(messages, [key], block, rows_per_task)
    first = F.coalesce(F.col("priority"), F.lit(False))
    ranked = running(
        messages, [key], order, block,
        _later_first=Running("sum", first.cast("bigint"), reverse=True),
        _earlier_first=Running("sum", first.cast("bigint"), inclusive=False),
        _normal=Running("sum", (~first).cast("bigint")),
    )
    position = F.when(first, F.col("_later_first")).otherwise(
        F.col("_earlier_first") + F.col("_later_first") + F.col("_normal")
    )
    return ranked.withColumn("position", position).drop("_later_first", "_earlier_first", "_normal")


def marker_batches(
    messages: DataFrame, is_marker: Column, key: str = "recipient", order: list[str] | None = None,
    block: Column | None = None, max_size: int = 100, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Batches closed by an end marker or at ``max_size``; markers are consumed.

    Adds ``segment`` (markers seen before) and ``batch`` within the segment, both from 0.
    """
    order = order or ["seq"]
    block = index_block(F.col(order[0]), rows_per_task) if block is None else block
    block = split_if_hot(messages, [key], block, rows_per_task)
    marker = F.coalesce(is_marker, F.lit(False))
    counted = running(
        messages.withColumn("_marker", marker), [key], order, block,
        segment=Running("sum", F.col("_marker").cast("bigint"), inclusive=False),
        _n=Running("sum", (~F.col("_marker")).cast("bigint")),
    )
    placed = running(
        settle(counted, block), [key], order, block,
        _base=Running("max", F.when(F.col("_marker"), F.col("_n")), inclusive=False),
    ).filter(~F.col("_marker"))
    batch = F.floor((F.col("_n") - F.coalesce("_base", F.lit(0)) - 1) / max_size).cast("bigint")
    return placed.withColumn("batch", batch).drop("_marker", "_n", "_base")


def merge_batch_text(batches: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """One text per batch, one line per message.  Batches are bounded, so is each list."""
    tag = meeting_tag(F.col("message_type"), F.col("meeting_id").cast("string")) if "message_type" in batches.columns else F.lit("")
    line = F.concat(
        F.lit("Received message from "), F.col("sender_klass"), F.lit("("), F.col("sender").cast("string"), F.lit(")"),
        tag, F.lit(": "), F.col("content"),
    )
    rows = batches.select(*keys, F.struct(F.col(order).alias("o"), line.alias("line")).alias("r"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("messages"),
        F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["line"]), "\n").alias("text"),
    )


def queue_stats(messages: DataFrame, reads: DataFrame, key: str = "recipient", ts: str = "ts", max_size: int | None = None) -> DataFrame:
    """Totals, outstanding size and rate per queue; a queue without duration has rate 0."""
    put = messages.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_messages"),
        (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))).alias("span_us"),
    )
    got = reads.groupBy(key).agg(F.count(F.lit(1)).alias("total_gets"))
    out = put.join(got, key, "left").withColumn("total_gets", F.coalesce("total_gets", F.lit(0)))
    size = F.col("total_messages") - F.col("total_gets")
    return out.select(
        key, "total_messages", "total_gets", size.alias("size"),
        F.when(F.col("span_us") > 0, F.round(F.col("total_messages") * 1e6 / F.col("span_us"), 6)).otherwise(F.lit(0.0)).alias("messages_per_second"),
        (size >= max_size if max_size is not None else F.lit(False)).alias("is_full"),
    )


def lookup_cached(requests: DataFrame, cache: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of requests by a content key: 32 hex digits of the SHA-256 of their JSON form.

    Of several responses to one key the latest (column ``ts``, if there is one) counts, then the largest.
    """
    keyed = requests.withColumn("cache_key", request_key(fields))
    order = F.struct(*(["ts"] if "ts" in cache.columns else []), "response")
    known = cache.groupBy("cache_key").agg(F.max_by("response", order).alias("response"))
    return keyed.join(known, "cache_key"), keyed.join(known, "cache_key", "left_anti")


def request_key(fields: list[str]) -> Column:
    return F.substring(F.sha2(F.to_json(F.struct(*fields)), 256), 1, 32)
