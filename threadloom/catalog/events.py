"""Event-log queries over ``events``; view/purchase are call start/end, click/error push and pop frames."""

from pyspark.sql import functions as F

from threadloom.operators import events as ops
from threadloom.operators import spans, state
from threadloom.sources.tables import event_log_from_table, event_payload, read_table



def log(spark, d):
    e = event_log_from_table(read_table(spark, d, "events"))
    return e.withColumn("model", F.get_json_object("payload", "$.k").cast("bigint") % 3)


def kind(name):
    return F.col("event_type") == name


def _pair(s, d):
    return ops.pair_start_end(log(s, d), ["agent_id", "model"], kind("view"), kind("purchase")).select(
        "event_id", "agent_id", "model", "end_id", "duration_us"
    )


def _depth(s, d):
    return ops.call_depth(log(s, d), kind("click"), kind("error")).select(
        "event_id", "agent_id", "depth_before", "depth_after", "closed_by"
    )


def _parents(s, d):
    return ops.attribute_parents(
        log(s, d), kind("view"), kind("purchase"), "model", kind("click"), kind("error"), kind("signup")
    ).select("event_id", "agent_id", "parent_id")


def _usage(s, d):
    calls = log(s, d).select(
        "agent_id", "model", F.get_json_object("payload", "$.k").cast("bigint").alias("input_tokens"),
        F.floor("value").cast("bigint").alias("output_tokens"), kind("click").alias("cache_hit"), kind("error").alias("is_error"),
    )
    return ops.usage_by_model(calls, ["agent_id", "model"])


def _latency(s, d):
    return ops.latency_stats(log(s, d).withColumn("bad", kind("error")), "event_type", "value", is_error="bad")


def _run_summary(s, d):
    status = F.when(kind("error"), "failed").when(kind("signup"), "pending").otherwise("completed")
    steps = log(s, d).select((F.col("agent_id")).alias("entity"), status.alias("status"))
    return ops.run_summary(steps)


def errors(s, d):
    return log(s, d).filter(kind("error")).select("agent_id", F.col("model").cast("string").alias("error_type"))


def span_rows(s, d):
    """The parent of a span is the event before it of the same user and day; a signup is a root."""
    from pyspark.sql import Window as W

    day = F.date_trunc("day", "ts")
    w = W.partitionBy("agent_id", day).orderBy("ts", "event_id")
    return log(s, d).select(
        F.col("event_id").alias("span_id"), F.col("agent_id").alias("trace_id"), "ts", "event_type",
        F.when(kind("signup"), None).when(kind("purchase"), -F.col("event_id")).otherwise(F.lag("event_id").over(w)).alias("parent_id"),
    )


def _chronological(s, d):
    text = F.when(kind("error"), "not a time").when(kind("signup"), None).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    sp = span_rows(s, d).withColumn("start", text).withColumn("created", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return spans.chronological(sp, "start", "created").select("span_id", "trace_id", "position")


def snapshots(s, d):
    """One snapshot per user and day: the last value of each event type; errors are private."""
    name = F.when(kind("error"), F.concat(F.lit("_"), F.col("event_type"))).otherwise(F.col("event_type"))
    value = F.when(F.col("model") == 0, None).otherwise(F.floor("value").cast("bigint"))
    e = log(s, d).select("agent_id", F.dayofmonth("ts").cast("bigint").alias("step"), name.alias("name"), value.alias("v"), "ts", "event_id")
    return e.groupBy(F.col("agent_id").alias("session_id"), "step", "name").agg(
        F.max_by(F.struct("v"), F.struct("ts", "event_id")).alias("x")
    ).select("session_id", "step", "name", F.col("x.v").alias("value"))


def _halves(s, d):
    """State of each user at the end of the first and of the second half of the month."""
    snap = snapshots(s, d).withColumn("half", F.when(F.col("step") <= 15, 1).otherwise(2))
    last = snap.groupBy("session_id", "half", "name").agg(F.max_by(F.struct("value"), "step").alias("x"))
    both = last.select("session_id", "half", "name", F.col("x.value").alias("value"))
    return both.filter("half = 1").drop("half"), both.filter("half = 2").drop("half")


def _diff(s, d):
    return state.diff_states(*_halves(s, d), ["session_id"])


def _deleted(s, d):
    previous, current = _halves(s, d)
    dropped = (F.col("session_id") % 3 == 0) & F.col("name").isin("view", "_error")  # the private one is not reported
    return state.deleted_keys(previous, current.filter(~dropped), ["session_id"])


def _latest(s, d):
    e = log(s, d).select("agent_id", F.col("event_type").alias("name"), "ts", "event_id",
                         F.when(F.col("model") > 0, F.col("value")).alias("value"))
    return state.latest_state(e, ["agent_id", "name"])


def _settings(s, d):
    e = log(s, d)
    layers = e.select(
        F.concat(F.lit("layer"), F.col("event_id").cast("string")).alias("layer"), F.col("event_id").alias("precedence"),
        # a signup sets the whole branch of an agent, other events set a leaf of it
        F.concat_ws(".", F.col("agent_id").cast("string"), F.when(F.col("event_type") != "signup", F.col("event_type"))).alias("key_path"), F.col("payload").alias("value"),
    )
    return state.effective_settings(layers)


def _attendance(s, d):
    o = read_table(s, d, "orders")
    return o.select(
        (F.col("o_custkey")).alias("meeting_id"), F.col("o_orderkey").alias("agent_id"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "required").otherwise("optional").alias("role"),
        F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_totalprice") > 480000, "rejected").otherwise("pending").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=(F.col("o_orderkey") % 33))).alias("resolved_at"),
    )


def _attendance_as_of(s, d):
    """Seen at a day when some who have not answered are late and others were invited only later."""
    answered = F.when((F.col("status") == "pending") & (F.col("agent_id") % 2 == 0), None).otherwise(F.col("resolved_at"))
    return ops.attendance_status(_attendance(s, d).withColumn("resolved_at", answered), as_of=F.lit("1997-01-01 00:00:00").cast("timestamp"))


def _await(s, d):
    e = log(s, d)
    invites = e.filter(kind("view")).select("agent_id", "event_id", "ts")
    responses = e.filter(kind("click") | kind("error")).select("agent_id", "event_id", "ts", kind("click").alias("accepted"))
    return ops.await_responses(invites, responses, ["agent_id"], 3600 * 6).select("agent_id", "event_id", "status")


def _listen(s, d):
    e = log(s, d).withColumnRenamed("agent_id", "recipient")
    return ops.listen_windows(e, kind("view")).select(
        "recipient", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "messages"
    )


def _recent(s, d):
    e = read_table(s, d, "events").select("event_id", "ts", "user_id")
    return ops.recent(e, "7d", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).select("event_id", "user_id")


def _read_log(s, d):
    typed = event_payload(event_log_from_table(read_table(s, d, "events")), "k bigint")
    return typed.select("event_id", "agent_id", F.unix_micros("ts").alias("ts_us"), "event_type", "value", "payload", F.col("fields.k").alias("k"))


QUERIES = {
    "read_event_log": _read_log,
    "pair_start_end": _pair,
    "call_depth": _depth,
    "attribute_parents": _parents,
    "number_calls": lambda s, d: ops.number_calls(log(s, d), kind("view")).select("event_id", "agent_id", "call_number"),
    "relative_time": lambda s, d: ops.relative_time(log(s, d), 3).select("event_id", "agent_id", "relative"),
    "relative_time_coarse": lambda s, d: ops.relative_time(log(s, d), -2).select("event_id", "agent_id", "relative"),
    "usage_by_model": _usage,
    "latency_stats": _latency,
    "run_summary": _run_summary,
    "error_report": lambda s, d: ops.error_report(errors(s, d)),
    "agent_health": lambda s, d: ops.health(log(s, d).select("agent_id").distinct(), errors(s, d)),
    "throughput": lambda s, d: ops.throughput(log(s, d), "1 hour").select(F.unix_micros("window_start").alias("start_us"), "event_type", "events"),
    "throughput_sliding": lambda s, d: ops.throughput(log(s, d), "2 hours", "1 hour").select(F.unix_micros("window_start").alias("start_us"), "event_type", "events"),
    "listen_windows": _listen,
    "await_responses": _await,
    "recent_events": _recent,
    "attach_parents": lambda s, d: spans.attach_parents(span_rows(s, d)).select("span_id", "parent_id", "is_root"),
    "chronological": _chronological,
    "span_tree": lambda s, d: spans.span_tree(span_rows(s, d)),
    "public_values": lambda s, d: state.public_values(snapshots(s, d)),
    "diff_states": _diff,
    "snapshot_diffs": lambda s, d: state.snapshot_diffs(snapshots(s, d)),
    "state_changes": lambda s, d: state.state_changes(snapshots(s, d)),
    "deleted_keys": _deleted,
    "latest_state": _latest,
    "effective_settings": _settings,
    "attendance_status": lambda s, d: ops.attendance_status(_attendance(s, d)),
    "attendance_status_as_of": _attendance_as_of,
    "missing_required": lambda s, d: ops.missing_required(_attendance(s, d)).select("meeting_id", "agent_id"),
}

_LOG = "log AS (SELECT event_id, user_id AS agent_id, ts, event_type, value, props, CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS model FROM events)"
_STACK = f"""{_LOG},
s1 AS (SELECT *, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS step FROM log),
s2 AS (SELECT *, sum(step) OVER (PARTITION BY agent_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM s1),
s3 AS (SELECT *, least(0, min(s) OVER (PARTITION BY agent_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS lo,
  least(0, coalesce(min(s) OVER (PARTITION BY agent_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lo_before FROM s2),
deep AS (SELECT *, CAST(s - lo AS BIGINT) AS depth_after, CAST(s - step - lo_before AS BIGINT) AS depth_before FROM s3)
"""
_SPANS = """sp AS (SELECT event_id AS span_id, user_id AS trace_id, ts, event_type,
  CASE event_type WHEN 'signup' THEN NULL WHEN 'purchase' THEN -event_id
    ELSE lag(event_id) OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) END AS parent_id FROM events)"""
_SNAP = f"""{_LOG},
v AS (SELECT agent_id AS session_id, CAST(day(ts) AS BIGINT) AS step, CASE WHEN event_type = 'error' THEN '_error' ELSE event_type END AS name,
  CASE WHEN model = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS value,
  row_number() OVER (PARTITION BY agent_id, day(ts), event_type ORDER BY ts DESC, event_id DESC) AS k FROM log),
snap AS (SELECT session_id, step, name, value FROM v WHERE k = 1)"""
_HALVES = """halves AS (SELECT session_id, CASE WHEN step <= 15 THEN 1 ELSE 2 END AS half, name, value FROM snap
  QUALIFY row_number() OVER (PARTITION BY session_id, CASE WHEN step <= 15 THEN 1 ELSE 2 END, name ORDER BY step DESC) = 1)"""
_DIFFS = """st AS (SELECT DISTINCT session_id, step FROM snap),
nx AS (SELECT session_id, step, lead(step) OVER (PARTITION BY session_id ORDER BY step) AS next_step FROM st),
moved AS (SELECT s.session_id, next_step AS step, name, value FROM snap s JOIN nx USING (session_id, step) WHERE next_step IS NOT NULL AND name NOT LIKE '\\_%' ESCAPE '\\'),
cur AS (SELECT * FROM snap WHERE name NOT LIKE '\\_%' ESCAPE '\\'),
diffs AS (SELECT coalesce(m.session_id, c.session_id) AS session_id, coalesce(m.step, c.step) AS step, coalesce(m.name, c.name) AS name,
  m.value AS old_value, c.value AS new_value,
  CASE WHEN m.name IS NULL THEN 'new' WHEN c.name IS NULL THEN 'deleted' WHEN m.value IS DISTINCT FROM c.value THEN 'changed' END AS change
  FROM moved m FULL JOIN cur c ON m.session_id = c.session_id AND m.step = c.step AND m.name = c.name)"""

_ATT = """att AS (SELECT o_custkey AS meeting_id, o_orderkey AS agent_id, o_orderpriority IN ('1-URGENT', '2-HIGH') AS required,
  CASE WHEN o_orderstatus = 'F' THEN 'accepted' WHEN o_totalprice > 480000 THEN 'rejected' ELSE 'pending' END AS status, o_orderkey % 33 AS secs,
  CASE WHEN o_orderstatus <> 'F' AND o_totalprice <= 480000 AND o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 30 SECONDS < TIMESTAMP '1997-01-01' ELSE o_orderkey % 33 > 30 END AS late FROM orders)"""

SQL = {
    "read_event_log": "SELECT event_id, user_id AS agent_id, epoch_us(ts) AS ts_us, event_type, value, props AS payload, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "pair_start_end": f"""WITH {_LOG}, n AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN {{'ts': ts, 'id': event_id}} END)
  OVER (PARTITION BY agent_id, model ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS e FROM log)
SELECT event_id, agent_id, model, e.id AS end_id, epoch_us(e.ts) - epoch_us(ts) AS duration_us FROM n WHERE event_type = 'view'""",
    "call_depth": f"""WITH {_STACK}, mv AS (SELECT *, greatest(depth_before, depth_after) AS lane FROM deep WHERE step <> 0)
SELECT event_id, agent_id, depth_before, depth_after,
  CASE WHEN step = 1 THEN lead(event_id) OVER (PARTITION BY agent_id, lane ORDER BY ts, event_id) END AS closed_by FROM mv""",
    "attribute_parents": f"""WITH {_STACK},
calls AS (SELECT l.agent_id, l.event_id AS call_id, (SELECT min(e.event_id) FROM log e WHERE e.agent_id = l.agent_id AND e.model = l.model AND e.event_type = 'purchase' AND e.event_id > l.event_id) AS end_id
  FROM log l WHERE l.event_type = 'view'),
x AS (SELECT d.*, (SELECT max(c.call_id) FROM calls c WHERE c.agent_id = d.agent_id AND c.call_id < d.event_id) AS last_call,
  (SELECT max(f.event_id) FROM deep f WHERE f.agent_id = d.agent_id AND f.step = 1 AND f.depth_after = d.depth_before AND f.event_id < d.event_id) AS frame,
  (SELECT max(r.event_id) FROM log r WHERE r.agent_id = d.agent_id AND r.event_type = 'signup' AND r.event_id < d.event_id) AS root FROM deep d)
SELECT x.event_id, x.agent_id, coalesce(CASE WHEN c.end_id IS NULL OR c.end_id >= x.event_id THEN c.call_id END, CASE WHEN depth_before > 0 THEN frame END, root) AS parent_id
FROM x LEFT JOIN calls c ON c.call_id = x.last_call""",
    "number_calls": "SELECT event_id, user_id AS agent_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS call_number FROM events WHERE event_type = 'view'",
    "relative_time": "SELECT event_id, user_id AS agent_id, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) // 1000 AS relative FROM events",
    "relative_time_coarse": "SELECT event_id, user_id AS agent_id, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) // 100000000 AS relative FROM events",
    "usage_by_model": f"""WITH {_LOG} SELECT agent_id, model, count(*) AS calls, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS input_tokens,
  CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS output_tokens, count(*) FILTER (event_type = 'click') AS cache_hits, count(*) FILTER (event_type = 'error') AS errors FROM log GROUP BY agent_id, model""",
    "latency_stats": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events),
q AS (SELECT event_type, n, min(value) AS min_latency, max(value) AS max_latency, round(CAST(sum(CAST(value AS DECIMAL(38, 6))) AS DOUBLE) / n, 6) AS avg_latency,
  max(CASE WHEN k = (n + 1) // 2 THEN value END) AS m1, max(CASE WHEN k = n // 2 + 1 THEN value END) AS m2,
  max(CASE WHEN k = 99 * (n + 1) // 100 THEN value END) AS q1, max(CASE WHEN k = 99 * (n + 1) // 100 + 1 THEN value END) AS q2,
  99 * (n + 1) % 100 AS delta, epoch_us(max(ts)) - epoch_us(min(ts)) AS span, count(*) FILTER (event_type = 'error') AS errors FROM r GROUP BY event_type, n)
SELECT event_type, n, min_latency, max_latency, avg_latency, round((m1 + m2) / 2, 6) AS p50_latency,
  round(CASE WHEN n > 100 THEN (q1 * (100 - delta) + q2 * delta) / 100 ELSE max_latency END, 6) AS p99_latency,
  CASE WHEN span > 0 THEN round(n * 1e6 / span, 6) ELSE 0.0 END AS throughput, errors FROM q""",
    "run_summary": """SELECT user_id AS entity, count(*) AS total, count(*) FILTER (event_type NOT IN ('error', 'signup')) AS completed,
  count(*) FILTER (event_type = 'error') AS failed, bool_and(event_type NOT IN ('error', 'signup')) AS is_complete FROM events GROUP BY user_id""",
    "error_report": f"""WITH {_LOG}, g AS (SELECT agent_id, CAST(model AS VARCHAR) AS error_type, count(*) AS errors FROM log WHERE event_type = 'error' GROUP BY ALL)
SELECT agent_id, error_type, errors, row_number() OVER (PARTITION BY agent_id ORDER BY errors DESC, error_type) AS position, CAST(sum(errors) OVER (PARTITION BY agent_id) AS BIGINT) AS agent_errors FROM g""",
    "agent_health": "SELECT user_id AS agent_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'error') = 0 AS is_healthy FROM events GROUP BY user_id",
    "throughput": "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS events FROM events GROUP BY ALL",
    "throughput_sliding": """WITH w AS (SELECT date_trunc('hour', ts) AS h, event_type FROM events UNION ALL SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR, event_type FROM events)
SELECT epoch_us(h) AS start_us, event_type, count(*) AS events FROM w GROUP BY ALL""",
    "listen_windows": """
WITH e AS (SELECT user_id AS recipient, epoch_us(ts) AS t, epoch_us(ts) + CASE WHEN event_type = 'view' THEN 500000 ELSE 5000000 END AS t_end, event_id FROM events),
m AS (SELECT *, max(t_end) OVER (PARTITION BY recipient ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_end FROM e),
i AS (SELECT *, sum(CASE WHEN before_end IS NULL OR t > before_end THEN 1 ELSE 0 END) OVER (PARTITION BY recipient ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT recipient, min(t) AS start_us, max(t_end) AS end_us, count(*) AS messages FROM i GROUP BY recipient, island""",
    "await_responses": """
WITH a AS (SELECT i.user_id, i.event_id, arg_min(r.event_type, r.event_id) AS answer FROM events i
  LEFT JOIN events r ON r.user_id = i.user_id AND r.event_type IN ('click', 'error') AND r.ts BETWEEN i.ts AND i.ts + INTERVAL 6 HOUR WHERE i.event_type = 'view' GROUP BY i.user_id, i.event_id)
SELECT user_id AS agent_id, event_id, CASE answer WHEN 'click' THEN 'accepted' WHEN 'error' THEN 'rejected' ELSE 'timeout' END AS status FROM a""",
    "recent_events": "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY",
    "attach_parents": f"WITH {_SPANS} SELECT span_id, parent_id, coalesce(parent_id NOT IN (SELECT span_id FROM sp), true) AS is_root FROM sp",
    "chronological": f"""WITH {_SPANS} SELECT span_id, trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY CASE WHEN event_type = 'error' THEN TIMESTAMP '0001-01-01' ELSE ts END, span_id) AS position FROM sp""",
    "span_tree": f"""
WITH RECURSIVE {_SPANS},
t AS (SELECT span_id, span_id AS root_id, CAST(0 AS BIGINT) AS depth, CAST(span_id AS VARCHAR) AS path FROM sp WHERE parent_id IS NULL OR parent_id NOT IN (SELECT span_id FROM sp)
  UNION ALL SELECT s.span_id, t.root_id, t.depth + 1, t.path || '/' || s.span_id FROM sp s JOIN t ON s.parent_id = t.span_id)
SELECT * FROM t""",
    "public_values": f"WITH {_SNAP} SELECT * FROM snap WHERE name <> '_error' AND value IS NOT NULL",
    "diff_states": f"""WITH {_SNAP}, {_HALVES}, p AS (SELECT * FROM halves WHERE half = 1 AND name <> '_error'), c AS (SELECT * FROM halves WHERE half = 2 AND name <> '_error'),
x AS (SELECT coalesce(p.session_id, c.session_id) AS session_id, coalesce(p.name, c.name) AS name, p.value AS old_value, c.value AS new_value,
  CASE WHEN p.name IS NULL THEN 'new' WHEN c.name IS NULL THEN 'deleted' WHEN p.value IS DISTINCT FROM c.value THEN 'changed' END AS change
  FROM p FULL JOIN c ON p.session_id = c.session_id AND p.name = c.name) SELECT * FROM x WHERE change IS NOT NULL""",
    "snapshot_diffs": f"WITH {_SNAP}, {_DIFFS} SELECT * FROM diffs WHERE change IS NOT NULL",
    "state_changes": f"WITH {_SNAP}, {_DIFFS} SELECT session_id, step, name, new_value, change FROM diffs d WHERE change IN ('new', 'changed') AND step > (SELECT min(step) FROM st WHERE st.session_id = d.session_id)",
    "deleted_keys": f"WITH {_SNAP}, {_HALVES} SELECT session_id, name FROM halves a WHERE half = 1 AND name <> '_error' AND NOT EXISTS (SELECT 1 FROM halves b WHERE b.session_id = a.session_id AND b.name = a.name AND b.half = 2 AND NOT (b.session_id % 3 = 0 AND b.name = 'view'))",
    "latest_state": f"WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY agent_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM log) SELECT agent_id, event_type AS name, value FROM r WHERE k = 1 AND model > 0",
    "effective_settings": """WITH l AS (SELECT user_id, event_type = 'signup' AS whole, CASE WHEN event_type = 'signup' THEN CAST(user_id AS VARCHAR) ELSE user_id || '.' || event_type END AS key_path,
  arg_max(props, event_id) AS value, max(event_id) AS e FROM events GROUP BY ALL)
SELECT key_path, value, 'layer' || e AS layer FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.user_id = a.user_id AND b.whole <> a.whole AND b.e > a.e)""",
    "attendance_status": f"""WITH {_ATT} SELECT meeting_id, count(*) AS attendees, CASE WHEN NOT bool_or(required) THEN 'ready' WHEN bool_or(required AND status = 'rejected') THEN 'failed'
  WHEN bool_or(required AND status <> 'rejected' AND secs > 30) THEN 'timeout' WHEN bool_or(status = 'pending') THEN 'pending' ELSE 'ready' END AS status FROM att GROUP BY meeting_id""",
    "attendance_status_as_of": f"""WITH {_ATT} SELECT meeting_id, count(*) AS attendees, CASE WHEN NOT bool_or(required) THEN 'ready' WHEN bool_or(required AND status = 'rejected') THEN 'failed'
  WHEN bool_or(required AND status <> 'rejected' AND late) THEN 'timeout' WHEN bool_or(status = 'pending') THEN 'pending' ELSE 'ready' END AS status FROM att GROUP BY meeting_id""",
    "missing_required": f"WITH {_ATT} SELECT meeting_id, agent_id FROM att WHERE required AND status <> 'accepted'",
}
