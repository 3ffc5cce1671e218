"""Batching and live queries over ``events`` and ``documents``."""

from pyspark.sql import functions as F

from threadloom.functions.text import word_count
from threadloom.operators import batching
from threadloom.sources.tables import EVENT_TABLE_SCHEMA, event_log_from_table, messages_from_turns, read_table, stream_table
from threadloom.streaming import batches, live

HOUR = 3600


def log(spark, d):
    return event_log_from_table(read_table(spark, d, "events"))


def live_log(spark, d):
    return event_log_from_table(stream_table(spark, d, "events", EVENT_TABLE_SCHEMA))


def urgent():
    return F.col("event_type") == "signup"


def _rolling(s, d):
    out = batching.rolling_batches(log(s, d), "agent_id", ["ts", "event_id"], urgent(), 4 * HOUR, 12 * HOUR)
    return out.select("agent_id", "event_id", "segment", "batch")


def _rolling_live(s, d):
    marks = live.EndMarks(s)
    stream = batches.rolling_batches_live(marks.add(live_log(s, d), agent_id=-1), "agent_id", "ts", "event_id", urgent(), 4 * HOUR, 12 * HOUR, "1 hour")
    out = live.run_to_end(stream, "rolling", marks).filter("key <> '-1'")
    return out.withColumn("ids", F.array_join("ids", ","))


def chunks(s, d):
    """Texts cut into pieces of 100 characters; German texts lack the start, others get a piece after the end."""
    doc = read_table(s, d, "documents").select("doc_id", "text", "lang")
    pieces = F.when(F.length("text") == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit(r"(?s)(.{1,100})"), F.lit(1)))
    doc = doc.withColumn("pieces", pieces)
    parts = F.transform("pieces", lambda x, i: F.struct((i + 1).cast("bigint").alias("seq"), F.lit("chunk").alias("kind"), x.alias("chunk")))
    edge = lambda at, kind: F.struct(at.cast("bigint").alias("seq"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("chunk"))
    last = F.size("pieces")
    everything = F.concat(
        F.when(F.col("lang") != "de", F.array(edge(F.lit(0), "start"))).otherwise(F.array().cast("array<struct<seq:bigint,kind:string,chunk:string>>")),
        parts,
        F.array(edge(last + 1, "complete")),
        F.when(F.col("lang") == "fr", F.array(edge(last + 2, "chunk"))).otherwise(F.array().cast("array<struct<seq:bigint,kind:string,chunk:string>>")),
    )
    return doc.select(F.col("doc_id").alias("stream_id"), F.inline(everything))


def _durations(s, d):
    e = log(s, d)
    starts = e.filter(F.col("event_type") == "view").select(F.col("event_id").alias("call_id"), "ts")
    ended = F.col("ts") + F.make_dt_interval(secs=F.col("value").cast("decimal(18,6)"))
    ends = e.filter(F.col("event_type") == "view").select(F.col("event_id").alias("call_id"), ended.alias("end_ts"))
    return batching.span_durations(starts, ends, "call_id", "10 seconds").select("call_id", "duration_us")


def _live_throughput(s, d):
    # a late marker row would be needed to close the last windows, so the full result is read
    out = live.run_complete(live.live_throughput(live_log(s, d), "1 hour"), "throughput")
    return out.select(F.unix_micros("window_start").alias("start_us"), "event_type", "events")


def _live_state(s, d):
    changes = live_log(s, d).select("agent_id", F.col("event_type").alias("name"), "ts", "event_id",
                                    F.when(F.get_json_object("payload", "$.k").cast("bigint") % 3 > 0, F.col("value")).alias("value"))
    return live.run_complete(live.live_latest_state(changes, ["agent_id", "name"]), "state")


def _dedupe(s, d):
    twice = live_log(s, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return live.run_available(live.dedupe_stream(twice, "event_id").select("event_id", "agent_id"), "dedupe")


def _log_sink(s, d):
    root = live.work_folder(s, "log")
    live.stream_log_sink(live_log(s, d), f"{root}/data", f"{root}/checkpoint").awaitTermination()
    out = s.read.parquet(f"{root}/data")
    return out.select("event_id", "agent_id", "level", "type", "content")


def _replay(s, d):
    root = live.work_folder(s, "replay")
    e = log(s, d)
    live.replay_then_follow(e.filter(F.col("event_type") != "view"), live_log(s, d), f"{root}/data", f"{root}/checkpoint").awaitTermination()
    return s.read.parquet(f"{root}/data").select("event_id", "agent_id", "event_type", F.when(F.col("part") == "history", "history").otherwise("live").alias("part"))


def live_messages(spark, d):
    return messages_from_turns(stream_table(spark, d, "conversations"))


def _fan_out_live(s, d):
    from threadloom.catalog.messages import members

    root = live.work_folder(s, "fan-out")
    members(s, d).write.parquet(f"{root}/members")
    live.fan_out_live(live_messages(s, d), lambda spark: spark.read.parquet(f"{root}/members"), f"{root}/data", f"{root}/checkpoint").awaitTermination()
    return s.read.parquet(f"{root}/data").select("channel_id", "seq", "sender", "recipient")


def _observers_live(s, d):
    from threadloom.catalog.messages import observed, watchers

    root = live.work_folder(s, "observers")
    watchers(s, d).write.parquet(f"{root}/observers")
    live.notify_observers_live(observed(live_messages(s, d)), lambda spark: spark.read.parquet(f"{root}/observers"), f"{root}/data", f"{root}/checkpoint").awaitTermination()
    return s.read.parquet(f"{root}/data").select("channel_id", "seq", "recipient", "observer_id")


def _durations_live(s, d):
    """Views start a call and clicks of the same agent end it, within two hours."""
    marks = live.EndMarks(s)
    kind = lambda x: live_log(s, d).filter(F.col("event_type") == x)
    starts = marks.add(kind("view").select("agent_id", "ts", F.col("event_id").alias("start_id")), agent_id=-1)
    ends = marks.add(kind("click").select("agent_id", F.col("ts").alias("end_ts")), "end_ts", agent_id=-1)
    out = live.run_to_end(live.span_durations_live(starts, ends, "agent_id", "2 hours", "1 hour"), "durations", marks)
    return out.filter("start_id is not null").select("agent_id", "start_id", "duration_us")


def _responses_live(s, d):
    """Sign-ups invite; the agent's purchases within two hours accept, its errors reject."""
    marks = live.EndMarks(s)
    invites = marks.add(live_log(s, d).filter("event_type = 'signup'").select("agent_id", "ts", "event_id"), agent_id=-1)
    answers = live_log(s, d).filter("event_type in ('purchase', 'error')").select("agent_id", "ts", (F.col("event_type") == "purchase").alias("accepted"))
    out = live.run_to_end(live.await_responses_live(invites, marks.add(answers, agent_id=-1), "agent_id", "2 hours", "1 hour"), "responses", marks)
    first = F.min(F.struct("responded_at", "status")).alias("first")
    return out.filter("event_id is not null").groupBy("event_id").agg(first).select("event_id", F.col("first.status").alias("status"))


def _route_stream(s, d):
    from threadloom.catalog.messages import subscriptions

    root = live.work_folder(s, "route")
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]

    def sink(name):
        def write(df, batch_id):
            if name == "ASIA":
                raise ValueError("sink is closed")
            df.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")
        return write

    stream = live_log(s, d).select("event_id", "event_type")
    live.route_stream(stream, subscriptions(s, d), {n: sink(n) for n in names}, f"{root}/errors", f"{root}/checkpoint").awaitTermination()
    schema = "event_id bigint, event_type string, subscriber_id string, is_wildcard boolean"
    good = s.read.schema(schema).option("recursiveFileLookup", True).parquet(*[f"{root}/{n}" for n in names if n != "ASIA"])
    failed = s.read.parquet(f"{root}/errors").select(F.lit(None).cast("bigint"), F.col("error_text"), "subscriber_id", F.lit(None).cast("boolean"))
    return good.union(failed)


def _incremental(s, d):
    root = live.work_folder(s, "corpus")
    known = read_table(s, d, "documents").filter("lang = 'en'")
    from threadloom.sources.corpus import with_hash

    with_hash(known).select("doc_id", "content_hash").write.parquet(f"{root}/manifest/batch_id=-1")
    files = stream_table(s, d, "documents").select("doc_id", "text")
    live.incremental_corpus(
        files, f"{root}/manifest", f"{root}/out", lambda df: df.select("doc_id", word_count(F.col("text")).cast("bigint").alias("words")),
        f"{root}/checkpoint", key="doc_id",
    ).awaitTermination()
    return s.read.parquet(f"{root}/out").select("doc_id", "words")


def _assembled_live(s, d):
    root = live.work_folder(s, "chunks")
    timed = chunks(s, d).withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_700_000_000))
    timed.write.parquet(f"{root}/in")
    marks = live.EndMarks(s)
    stream = marks.add(s.readStream.schema(timed.schema).parquet(f"{root}/in"), stream_id=-1, seq=0, kind="start")
    out = live.run_to_end(batches.assemble_streams_live(stream), "assembled", marks)
    return out.withColumn("stream_id", F.col("stream_id").cast("bigint")).filter("stream_id <> -1")


QUERIES = {
    "rolling_batches": _rolling,
    "rolling_batches_live": _rolling_live,
    "assemble_streams": lambda s, d: batching.assemble_streams(chunks(s, d))[0],
    "assemble_streams_live": lambda s, d: _assembled_live(s, d).filter("error is null").select("stream_id", "text", "chunks"),
    "assemble_streams_live_errors": lambda s, d: _assembled_live(s, d).filter("error is not null").select("stream_id", "seq", "kind", "error"),
    "assemble_streams_errors": lambda s, d: batching.assemble_streams(chunks(s, d))[1],
    "span_durations": _durations,
    "throughput_live": _live_throughput,
    "latest_state_live": _live_state,
    "fan_out_live": _fan_out_live,
    "notify_observers_live": _observers_live,
    "span_durations_live": _durations_live,
    "await_responses_live": _responses_live,
    "dedupe_stream": _dedupe,
    "stream_log_sink": _log_sink,
    "replay_then_follow": _replay,
    "route_stream": _route_stream,
    "incremental_corpus": _incremental,
}

_FOLD = """RECURSIVE m AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type = 'signup' AS urgent, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, k, t, t AS first, urgent AS closes, t + 14400000000 AS deadline, 1 AS segment, 0 AS batch, urgent FROM m WHERE k = 1
  UNION ALL
  SELECT user_id, event_id, k, t, first, urgent OR t - first >= 43200000000, CASE WHEN fresh OR 2 * (t - first) < 43200000000 THEN t + 14400000000 ELSE deadline END, segment, batch, urgent FROM (
    SELECT m.user_id, m.event_id, m.k, m.t, m.urgent, f.deadline, (f.closes OR m.t >= f.deadline) AS fresh, CASE WHEN fresh THEN m.t ELSE f.first END AS first,
      CASE WHEN f.urgent OR m.t - f.t >= 14400000000 THEN f.segment + 1 ELSE f.segment END AS segment,
      CASE WHEN f.urgent OR m.t - f.t >= 14400000000 THEN 0 WHEN fresh THEN f.batch + 1 ELSE f.batch END AS batch
    FROM m JOIN f ON m.user_id = f.user_id AND m.k = f.k + 1))"""
_CHUNKS = """d AS (SELECT doc_id AS stream_id, text, lang, greatest(1, CAST(ceil(length(text) / 100) AS BIGINT)) AS n FROM documents)"""

SQL = {
    "rolling_batches": f"WITH {_FOLD} SELECT user_id AS agent_id, event_id, CAST(segment AS BIGINT) AS segment, CAST(batch AS BIGINT) AS batch FROM f",
    "rolling_batches_live": f"""WITH {_FOLD} SELECT CAST(user_id AS VARCHAR) AS key, min(t) AS first_us, max(t) AS last_us, count(*) AS messages, string_agg(event_id, ',' ORDER BY k) AS ids
FROM f GROUP BY user_id, segment, batch""",
    "assemble_streams": f"WITH {_CHUNKS} SELECT stream_id, text, n AS chunks FROM d WHERE lang <> 'de'",
    "assemble_streams_live": f"WITH {_CHUNKS} SELECT stream_id, text, n AS chunks FROM d WHERE lang <> 'de'",
    "assemble_streams_errors": f"""WITH {_CHUNKS} SELECT stream_id, unnest(generate_series(1, n + 1)) AS seq, CASE WHEN seq = n + 1 THEN 'complete' ELSE 'chunk' END AS kind, 'no start' AS error FROM d WHERE lang = 'de'
UNION ALL SELECT stream_id, n + 2, 'chunk', 'already completed' FROM d WHERE lang = 'fr'""",
    "assemble_streams_live_errors": f"""WITH {_CHUNKS} SELECT stream_id, unnest(generate_series(1, n + 1)) AS seq, CASE WHEN seq = n + 1 THEN 'complete' ELSE 'chunk' END AS kind, 'no start' AS error FROM d WHERE lang = 'de'
UNION ALL SELECT stream_id, n + 2, 'chunk', 'already completed' FROM d WHERE lang = 'fr'""",
    "span_durations": "SELECT event_id AS call_id, CAST(round(value * 1000000) AS BIGINT) AS duration_us FROM events WHERE event_type = 'view' AND value BETWEEN 0 AND 10",
    "throughput_live": "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS events FROM events GROUP BY ALL",
    "latest_state_live": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id AS agent_id, event_type AS name, value FROM r WHERE k = 1 AND CAST(json_extract(props, '$.k') AS BIGINT) % 3 > 0""",
    "fan_out_live": "WITH m AS (SELECT DISTINCT conv_id, role FROM conversations) SELECT c.conv_id AS channel_id, c.turn AS seq, c.role AS sender, m.role AS recipient FROM conversations c JOIN m ON m.conv_id = c.conv_id AND m.role <> c.role",
    "notify_observers_live": """
WITH e AS (SELECT conv_id AS channel_id, turn AS seq, CASE WHEN turn % 3 = 0 THEN NULL WHEN role = 'user' THEN 'assistant' ELSE 'user' END AS recipient FROM conversations),
o(observer_id, target) AS (VALUES ('all', NULL), ('of_user', 'user'), ('of_assistant', 'assistant'))
SELECT channel_id, seq, recipient, observer_id FROM e, o WHERE target IS NULL OR recipient IS NULL OR target = recipient""",
    "span_durations_live": """SELECT a.user_id AS agent_id, a.event_id AS start_id, epoch_us(b.ts) - epoch_us(a.ts) AS duration_us FROM events a JOIN events b ON a.user_id = b.user_id
WHERE a.event_type = 'view' AND b.event_type = 'click' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOURS""",
    "await_responses_live": """WITH r AS (SELECT a.event_id, CASE b.event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' ELSE 'timeout' END AS status, b.ts, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts, b.event_type DESC) AS k FROM events a
LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type IN ('purchase', 'error') AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOURS WHERE a.event_type = 'signup') SELECT event_id, status FROM r WHERE k = 1""",
    "dedupe_stream": "SELECT event_id, user_id AS agent_id FROM events",
    "stream_log_sink": "SELECT event_id, user_id AS agent_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, event_type AS type, props AS content FROM events",
    "replay_then_follow": "SELECT event_id, user_id AS agent_id, event_type, CASE WHEN event_type = 'view' THEN 'live' ELSE 'history' END AS part FROM events",
    "route_stream": """
WITH s AS (SELECT r_name AS subscriber_id, CASE r_regionkey % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'purchase' WHEN 3 THEN '*' ELSE 'view' END AS kind FROM region)
SELECT event_id, event_type, subscriber_id, kind = '*' AS is_wildcard FROM events JOIN s ON kind = event_type OR kind = '*' WHERE subscriber_id <> 'ASIA'
UNION ALL SELECT NULL, 'sink is closed', 'ASIA', NULL""",
    "incremental_corpus": "SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS words FROM documents WHERE lang <> 'en'",
}
