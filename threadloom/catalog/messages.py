"""Message routing queries: ``conversations`` as channels, ``events`` as queues."""

from pyspark.sql import functions as F

from threadloom.functions.ordered import time_block
from threadloom.operators import messages as ops
from threadloom.operators import queues
from threadloom.sources.tables import event_log_from_table, messages_from_turns, read_table


def messages(spark, d):
    return messages_from_turns(read_table(spark, d, "conversations"))


def members(spark, d):
    return messages(spark, d).select("channel_id", F.col("sender").alias("participant_id")).distinct()


def observed(m):
    """Messages as stream events: every third one is for everybody."""
    return m.withColumn(
        "recipient", F.when(F.col("seq") % 3 == 0, F.lit(None).cast("string")).when(F.col("sender") == "user", "assistant").otherwise("user"))


def watchers(s, d):
    each = F.array(
        F.struct(F.lit("all").alias("observer_id"), F.lit(None).cast("string").alias("target")),
        F.struct(F.lit("of_user").alias("observer_id"), F.lit("user").alias("target")),
        F.struct(F.lit("of_assistant").alias("observer_id"), F.lit("assistant").alias("target")),
    )
    return messages(s, d).select("channel_id").distinct().select("channel_id", F.inline(each))


def _notify_observers(s, d):
    return ops.notify_observers(observed(messages(s, d)), watchers(s, d)).select("channel_id", "seq", "recipient", "observer_id")


def _gate_delivery(s, d):
    m = messages(s, d).withColumn(
        "target_agent_ids", F.when(F.col("seq") % 4 == 0, F.array(F.lit("user"))).otherwise(F.array().cast("array<string>"))
    )
    people = members(s, d)
    prefs = people.select("participant_id").distinct().select(
        "participant_id", F.lit("tion").alias("name"), F.lit("WH").alias("klass"),
        F.when(F.col("participant_id") == "system", "buffered").otherwise("streaming").alias("channel"),
        F.lit(None).cast("boolean").alias("streaming_enabled"), F.lit(None).cast("boolean").alias("buffer_messages"),
        F.lit(None).cast("int").alias("streaming_chunk_size"), F.lit(None).cast("double").alias("buffer_timeout"),
        F.when(F.col("participant_id") == "assistant", "all").alias("meeting_notifications"),
    )
    return ops.gate_delivery(m, people, ops.normalise_prefs(prefs)).select("channel_id", "seq", "participant_id")


def subscriptions(spark, d):
    kinds = F.array(*[F.lit(k) for k in ("view", "click", "purchase", "*", "view")])
    return read_table(spark, d, "region").select(
        F.col("r_name").alias("subscriber_id"), kinds[F.col("r_regionkey") % 5].alias("event_type")
    )


def _route_events(s, d):
    e = read_table(s, d, "events").select("event_id", "event_type")
    return ops.route_events(e, subscriptions(s, d)).select("event_id", "event_type", "subscriber_id", "is_wildcard")


def _senders(s, d):
    """Members are those who spoke in the first two turns of a channel."""
    return messages(s, d).filter(F.col("seq") < 2).select("channel_id", F.col("sender").alias("participant_id")).distinct()


def _meeting_messages(s, d):
    return messages(s, d).select(
        "channel_id", "seq", "sender", "content",
        F.when(F.col("channel_id") % 3 == 0, F.col("channel_id").cast("string")).alias("meeting_id"),
    )


def _select_all(s, d):
    m = _meeting_messages(s, d)
    joined = m.filter(F.col("sender") == "system").select("meeting_id").filter("meeting_id is not null")
    return ops.select_for_listener(m, "*", joined).drop("content")


def _resolve_targets(s, d):
    customers = read_table(s, d, "customer")
    directory = customers.select(F.col("c_custkey").alias("agent_id"), F.col("c_mktsegment").alias("klass"))
    orders = read_table(s, d, "orders")
    key = F.col("o_orderkey") % 9
    target = (
        F.when(key == 0, F.lit("User")).when(key == 1, F.lit(" meeting ")).when(key == 2, F.concat(F.lit("meeting "), F.col("o_custkey")))
        .when(key == 3, F.concat(F.lit("agent "), F.col("o_custkey"))).when(key == 4, F.col("o_custkey").cast("string"))
        .when(key == 5, F.lit("last_non_human_agent")).when(key == 6, F.lit("BUILDING")).when(key == 7, F.lit("nobody"))
    )
    requests = orders.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("agent_id"), target.alias("target"))
    context = customers.select(
        F.col("c_custkey").alias("agent_id"),
        F.when(F.col("c_nationkey") % 3 == 0, F.col("c_nationkey")).alias("meeting_id"),
        F.when(F.col("c_nationkey") % 2 == 0, F.lit("human")).when(F.col("c_nationkey") % 5 == 0, F.col("c_nationkey").cast("string")).alias("last_target"),
    )
    return ops.resolve_targets(requests, directory, context)


def _group_agents(s, d):
    return ops.group_agents(read_table(s, d, "customer").select(F.col("c_mktsegment").alias("klass"), F.col("c_custkey").alias("agent_id")))


def _drop_streamed(s, d):
    m = messages(s, d).withColumn("stream_id", F.sha2("content", 256))
    streams = m.filter(F.col("sender") == "assistant").select("stream_id")
    return ops.drop_already_streamed(m, streams).select("channel_id", "seq", "sender")


def _cursors(s, d):
    own = messages(s, d).groupBy("channel_id", F.col("sender").alias("reader"))
    return own.agg(F.count(F.lit(1)).alias("last_index"))


def queue(spark, d):
    e = event_log_from_table(read_table(spark, d, "events"))
    return e.select(F.col("agent_id").alias("recipient"), F.col("event_id").alias("seq"), "ts", "event_type", "payload", "value")


def _queue_order(s, d):
    q = queue(s, d).withColumn("priority", F.col("event_type") == "error")
    return ops.queue_order(q, order=["ts", "seq"], block=time_block(F.col("ts"), 86400)).select("recipient", "seq", "priority", "position")


def _bounded_queue(s, d):
    """Sign-ups come first, purchases read, a queue holds two; blocks of a week, so that a queue spans several."""
    op = F.when(F.col("event_type") == "signup", "priority").when(F.col("event_type") == "purchase", "get").otherwise("put")
    q = queue(s, d).select("recipient", "ts", "seq", op.alias("op"))
    out = queues.bounded_queue(q, 2, "recipient", ["ts", "seq"], time_block(F.col("ts"), 7 * 86400))
    return out.select("recipient", "seq", "priority", "fate", F.col("by.seq").alias("by_seq"))


def batches(spark, d, max_size=5):
    return ops.marker_batches(
        queue(spark, d), F.col("event_type") == "purchase", order=["ts", "seq"], block=time_block(F.col("ts"), 86400), max_size=max_size
    )


def _merge_batch_text(s, d):
    b = batches(s, d).select(
        "recipient", "segment", "batch", "seq", F.lit("Agent").alias("sender_klass"), F.col("event_type").alias("sender"),
        F.col("payload").alias("content"),
        F.when(F.col("event_type") == "error", "meeting_broadcast").otherwise("direct").alias("message_type"),
        F.col("recipient").alias("meeting_id"),
    )
    return ops.merge_batch_text(b, ["recipient", "segment", "batch"])


def _queue_stats(s, d):
    q = queue(s, d)
    return ops.queue_stats(q, q.filter(F.col("event_type").isin("view", "click")), max_size=20)


def _requests(s, d):
    return messages(s, d).select(
        "channel_id", "seq", F.lit("base").alias("model"), F.lit("0").alias("temperature"), F.col("sender").alias("role"), "content"
    )


_FIELDS = ["model", "role", "content", "temperature"]


def _lookup(s, d, side):
    requests = _requests(s, d)
    cache = requests.filter(F.col("seq") < 2).select(ops.request_key(_FIELDS).alias("cache_key"), F.lit("kept").alias("response"))
    return ops.lookup_cached(requests, cache, _FIELDS)[side].select("channel_id", "seq", "cache_key")


QUERIES = {
    "read_messages": messages,
    "fan_out": lambda s, d: ops.fan_out(messages(s, d), members(s, d)).select("channel_id", "seq", "sender", "recipient"),
    "notify_observers": _notify_observers,
    "gate_delivery": _gate_delivery,
    "route_events": _route_events,
    "subscriber_counts": lambda s, d: ops.subscriber_counts(subscriptions(s, d).unionByName(
        read_table(s, d, "events").select(F.col("user_id").cast("string").alias("subscriber_id"), "event_type").distinct())),
    "accepted_messages": lambda s, d: ops.reject_non_members(messages(s, d), _senders(s, d))[0].select("channel_id", "seq", "sender"),
    "rejected_messages": lambda s, d: ops.reject_non_members(messages(s, d), _senders(s, d))[1].select("channel_id", "seq", "sender"),
    "select_for_listener_all": _select_all,
    "select_for_listener_agent": lambda s, d: ops.select_for_listener(_meeting_messages(s, d), "agent assistant").drop("content"),
    "select_for_listener_meeting": lambda s, d: ops.select_for_listener(_meeting_messages(s, d), "meeting 3").drop("content"),
    "resolve_targets": _resolve_targets,
    "classify_channels": lambda s, d: ops.classify_channels(members(s, d)),
    "group_agents": _group_agents,
    "drop_already_streamed": _drop_streamed,
    "unread": lambda s, d: ops.unread(messages(s, d), _cursors(s, d)).select("channel_id", "reader", "seq", "position"),
    "mark_read": lambda s, d: ops.mark_read(messages(s, d), _cursors(s, d).drop("last_index")),
    "queue_order": _queue_order,
    "bounded_queue": _bounded_queue,
    "marker_batches": lambda s, d: batches(s, d).select("recipient", "seq", "segment", "batch"),
    "merge_batch_text": _merge_batch_text,
    "queue_stats": _queue_stats,
    "lookup_cached_hits": lambda s, d: _lookup(s, d, 0),
    "lookup_cached_misses": lambda s, d: _lookup(s, d, 1),
}

_MEMBERS = "members AS (SELECT DISTINCT conv_id AS channel_id, role AS participant_id FROM conversations)"
_KEY = "substr(sha256(CAST(to_json({'model': 'base', 'role': role, 'content': text, 'temperature': '0'}) AS VARCHAR)), 1, 32)"
_BATCHES = """
a AS (SELECT user_id AS recipient, event_id AS seq, ts, event_type, props, event_type = 'purchase' AS m FROM events),
b AS (SELECT *, coalesce(sum(CASE WHEN m THEN 1 ELSE 0 END) OVER (PARTITION BY recipient ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM a),
batches AS (SELECT recipient, seq, event_type, props, CAST(segment AS BIGINT) AS segment,
  (row_number() OVER (PARTITION BY recipient, segment ORDER BY ts, seq) - 1) // 5 AS batch FROM b WHERE NOT m)
"""

SQL = {
    "read_messages": "SELECT conv_id AS channel_id, turn AS seq, role AS sender, text AS content FROM conversations",
    "fan_out": f"WITH {_MEMBERS} SELECT c.conv_id AS channel_id, c.turn AS seq, c.role AS sender, m.participant_id AS recipient FROM conversations c JOIN members m ON m.channel_id = c.conv_id AND m.participant_id <> c.role",
    "notify_observers": """
WITH e AS (SELECT conv_id AS channel_id, turn AS seq, CASE WHEN turn % 3 = 0 THEN NULL WHEN role = 'user' THEN 'assistant' ELSE 'user' END AS recipient FROM conversations),
o(observer_id, target) AS (VALUES ('all', NULL), ('of_user', 'user'), ('of_assistant', 'assistant'))
SELECT channel_id, seq, recipient, observer_id FROM e, o WHERE target IS NULL OR recipient IS NULL OR target = recipient""",
    "gate_delivery": f"""
WITH {_MEMBERS} SELECT c.conv_id AS channel_id, c.turn AS seq, m.participant_id FROM conversations c JOIN members m ON m.channel_id = c.conv_id
WHERE m.participant_id <> 'system' AND (m.participant_id = 'assistant' OR (c.turn % 4 = 0 AND m.participant_id = 'user')
  OR contains(lower(c.text), 'tion') OR contains(lower(c.text), 'wh'))""",
    "route_events": """
WITH s AS (SELECT r_name AS subscriber_id, CASE r_regionkey % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'purchase' WHEN 3 THEN '*' ELSE 'view' END AS kind FROM region)
SELECT event_id, event_type, subscriber_id, kind = '*' AS is_wildcard FROM events JOIN s ON kind = event_type OR kind = '*'""",
    "subscriber_counts": """
WITH s AS (SELECT CASE r_regionkey % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'purchase' WHEN 3 THEN '*' ELSE 'view' END AS event_type FROM region
  UNION ALL SELECT event_type FROM (SELECT DISTINCT user_id, event_type FROM events))
SELECT event_type, count(*) AS subscribers FROM s GROUP BY event_type""",
    "accepted_messages": "SELECT conv_id AS channel_id, turn AS seq, role AS sender FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.role = c.role AND x.turn < 2)",
    "rejected_messages": "SELECT conv_id AS channel_id, turn AS seq, role AS sender FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.role = c.role AND x.turn < 2)",
    "select_for_listener_all": """
WITH m AS (SELECT conv_id AS channel_id, turn AS seq, role AS sender, CASE WHEN conv_id % 3 = 0 THEN CAST(conv_id AS VARCHAR) END AS meeting_id FROM conversations)
SELECT * FROM m WHERE meeting_id IS NULL OR meeting_id NOT IN (SELECT meeting_id FROM m WHERE sender = 'system' AND meeting_id IS NOT NULL)""",
    "select_for_listener_agent": "SELECT conv_id AS channel_id, turn AS seq, role AS sender, CASE WHEN conv_id % 3 = 0 THEN CAST(conv_id AS VARCHAR) END AS meeting_id FROM conversations WHERE role = 'assistant'",
    "select_for_listener_meeting": "SELECT conv_id AS channel_id, turn AS seq, role AS sender, CAST(conv_id AS VARCHAR) AS meeting_id FROM conversations WHERE conv_id = 3",
    "resolve_targets": """
WITH r AS (SELECT o_orderkey AS request_id, o_custkey AS agent_id, o_orderkey % 9 AS k,
  CASE o_orderkey % 9 WHEN 0 THEN 'User' WHEN 1 THEN ' meeting ' WHEN 2 THEN 'meeting ' || o_custkey WHEN 3 THEN 'agent ' || o_custkey
    WHEN 4 THEN CAST(o_custkey AS VARCHAR) WHEN 5 THEN 'last_non_human_agent' WHEN 6 THEN 'BUILDING' WHEN 7 THEN 'nobody' END AS target FROM orders),
c AS (SELECT c_custkey AS agent_id, CASE WHEN c_nationkey % 3 = 0 THEN 'meeting ' || c_nationkey END AS meeting,
  CASE WHEN c_nationkey % 2 = 0 THEN 'human' WHEN c_nationkey % 5 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS last_target FROM customer)
SELECT request_id, r.agent_id, target, CASE
  WHEN k = 8 THEN coalesce(meeting, last_target, 'human') WHEN k = 0 THEN 'human' WHEN k = 1 THEN coalesce(meeting, 'human')
  WHEN k = 2 THEN 'meeting ' || r.agent_id WHEN k IN (3, 4) THEN CAST(r.agent_id AS VARCHAR)
  WHEN k = 5 THEN coalesce(last_target, 'human')
  WHEN k = 6 THEN coalesce(CAST((SELECT min(c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey <> r.agent_id) AS VARCHAR), 'human')
  ELSE 'human' END AS resolved
FROM r LEFT JOIN c ON c.agent_id = r.agent_id""",
    "classify_channels": f"""
WITH {_MEMBERS}, n AS (SELECT channel_id, count(*) AS participants, min(participant_id) AS a, max(participant_id) AS b FROM members GROUP BY channel_id)
SELECT channel_id, participants, CASE WHEN participants = 2 THEN 'direct' WHEN participants > 2 THEN 'meeting' ELSE 'single' END AS kind,
  CASE WHEN participants = 2 THEN a || '_' || b END AS pair_id FROM n""",
    "group_agents": "SELECT c_mktsegment AS klass, c_custkey AS agent_id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS position, count(*) OVER (PARTITION BY c_mktsegment) AS class_size FROM customer",
    "drop_already_streamed": "SELECT conv_id AS channel_id, turn AS seq, role AS sender FROM conversations WHERE text NOT IN (SELECT text FROM conversations WHERE role = 'assistant')",
    "unread": """
WITH m AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations),
c AS (SELECT conv_id, role AS reader, count(*) AS last_index FROM conversations GROUP BY conv_id, role)
SELECT m.conv_id AS channel_id, reader, turn AS seq, position FROM m JOIN c USING (conv_id) WHERE position >= last_index""",
    "mark_read": "SELECT conv_id AS channel_id, role AS reader, max(n) AS last_index FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) GROUP BY conv_id, role",
    "queue_order": """
WITH q AS (SELECT user_id AS recipient, event_id AS seq, ts, event_type = 'error' AS priority FROM events),
r AS (SELECT *, CASE WHEN priority THEN -row_number() OVER (PARTITION BY recipient ORDER BY ts, seq) ELSE row_number() OVER (PARTITION BY recipient ORDER BY ts, seq) END AS k FROM q)
SELECT recipient, seq, priority, row_number() OVER (PARTITION BY recipient ORDER BY priority DESC, k) AS position FROM r""",
    "bounded_queue": """
WITH RECURSIVE m AS (SELECT user_id AS k, event_id AS seq, CASE event_type WHEN 'signup' THEN 'priority' WHEN 'purchase' THEN 'get' ELSE 'put' END AS op,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
q AS (SELECT k, 0::BIGINT AS n, []::BIGINT[] AS held, NULL::BIGINT AS gone, NULL::VARCHAR AS fate, NULL::BIGINT AS by_seq FROM (SELECT DISTINCT k FROM m)
  UNION ALL SELECT m.k, m.n,
    CASE m.op WHEN 'get' THEN q.held[2:] WHEN 'put' THEN (CASE WHEN len(q.held) = 2 THEN q.held[2:] ELSE q.held END) || [m.seq] ELSE [m.seq] || (CASE WHEN len(q.held) = 2 THEN q.held[:1] ELSE q.held END) END,
    CASE WHEN m.op = 'get' THEN q.held[1] WHEN len(q.held) = 2 THEN CASE m.op WHEN 'put' THEN q.held[1] ELSE q.held[2] END END,
    CASE m.op WHEN 'get' THEN 'read' ELSE 'evicted' END, m.seq
  FROM q JOIN m ON m.k = q.k AND m.n = q.n + 1)
SELECT m.k AS recipient, m.seq, m.op = 'priority' AS priority, coalesce(g.fate, 'waiting') AS fate, g.by_seq FROM m LEFT JOIN (SELECT * FROM q WHERE gone IS NOT NULL) g ON g.gone = m.seq AND g.k = m.k WHERE m.op <> 'get'""",
    "marker_batches": f"WITH {_BATCHES} SELECT recipient, seq, segment, batch FROM batches",
    "merge_batch_text": f"""WITH {_BATCHES} SELECT recipient, segment, batch, count(*) AS messages,
  string_agg('Received message from Agent(' || event_type || ')' || CASE WHEN event_type = 'error' THEN ' [in meeting ' || recipient || ']' ELSE '' END || ': ' || props, chr(10) ORDER BY seq) AS text
FROM batches GROUP BY recipient, segment, batch""",
    "queue_stats": """
WITH g AS (SELECT user_id AS recipient, count(*) AS total_messages, count(*) FILTER (event_type IN ('view', 'click')) AS total_gets, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM events GROUP BY user_id)
SELECT recipient, total_messages, total_gets, total_messages - total_gets AS size,
  CASE WHEN span > 0 THEN round(total_messages * 1e6 / span, 6) ELSE 0.0 END AS messages_per_second, total_messages - total_gets >= 20 AS is_full FROM g""",
    "lookup_cached_hits": f"WITH k AS (SELECT *, {_KEY} AS cache_key FROM conversations) SELECT conv_id AS channel_id, turn AS seq, cache_key FROM k WHERE cache_key IN (SELECT cache_key FROM k WHERE turn < 2)",
    "lookup_cached_misses": f"WITH k AS (SELECT *, {_KEY} AS cache_key FROM conversations) SELECT conv_id AS channel_id, turn AS seq, cache_key FROM k WHERE cache_key NOT IN (SELECT cache_key FROM k WHERE turn < 2)",
}
