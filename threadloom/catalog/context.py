"""Conversation context queries over ``conversations``."""

from pyspark.sql import functions as F

from threadloom.operators import context as ops
from threadloom.plans.context_tokens import context_tokens
from threadloom.sources.tables import read_table


def turns(spark, d):
    return read_table(spark, d, "conversations")


def marked_turns(spark, d):
    return turns(spark, d).withColumn("marked", (F.col("turn") % 3 == 2) | (F.col("role") == "system"))


def _frames(spark, d):
    conv = turns(spark, d)
    roles = conv.select("conv_id", F.col("role").alias("frame")).distinct().filter(F.col("frame") != "system")
    return roles.withColumn("depth", F.when(F.col("frame") == "user", 0).otherwise(1))


def _session_context(spark, d):
    messages = turns(spark, d).withColumn("frame", F.col("role"))
    out = ops.session_context(_frames(spark, d), messages)
    return out.select("conv_id", "turn", F.col("depth").cast("bigint").alias("depth"), "position")


QUERIES = {
    "context_tokens": lambda s, d: context_tokens(turns(s, d)),
    "drop_blank": lambda s, d: ops.drop_blank(turns(s, d).withColumn("text", F.when(F.col("turn") % 5 == 3, F.lit(" \t\n\u00a0\u3000")).otherwise(F.col("text")))),
    "merge_runs": lambda s, d: ops.merge_runs(marked_turns(s, d)),
    "merge_runs_unmarked": lambda s, d: ops.merge_runs(turns(s, d)).drop("marked"),
    "compact_history": lambda s, d: ops.compact_history(turns(s, d)),
    "cap_markers": lambda s, d: ops.cap_markers(marked_turns(s, d)).select("conv_id", "turn", "role", "marked"),
    "conversation_tokens": lambda s, d: ops.conversation_tokens(turns(s, d), name="role"),
    "session_context": _session_context,
    "check_conversations": lambda s, d: ops.check_conversations(turns(s, d)),
    "valid_conversations": lambda s, d: ops.valid_conversations(turns(s, d)),
}

_MARKED = """
marked AS (SELECT *, (turn % 3 = 2) OR role = 'system' AS marked FROM conversations),
"""

_MERGE = """
a AS (SELECT *, lag(role) OVER w AS prev_role, row_number() OVER w = 1 AS is_first FROM {source} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT *, marked AND (is_first OR prev_role = role) AS closes FROM a),
c AS (SELECT *, CASE WHEN is_first OR prev_role <> role OR lag(closes) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS opens FROM b),
g AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM c),
merged AS (SELECT conv_id, min(turn) AS turn, any_value(role) AS role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text,
  bool_or(marked) AS marked, count(*) AS n_turns FROM g GROUP BY conv_id, run)
"""

_SHORT = """
CASE WHEN is_full THEN text
     WHEN role = 'assistant' THEN array_to_string(list_slice(string_split(
       regexp_replace(regexp_replace(text, '^\\s*```(?:python)?|```\\s*$', '', 'g'), '^\\s+|\\s+$', '', 'g'), chr(10)), 1, 2), chr(10))
     ELSE string_split(text, chr(10))[1] END
"""

_FULL = """
CASE role WHEN 'assistant' THEN row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) <= 2
          WHEN 'user' THEN row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) <= 1
          ELSE true END
"""

_VIOLATIONS = """
first_last AS (SELECT conv_id, min(turn) AS f, max(turn) AS l, arg_min(role, turn) AS fr, arg_max(role, turn) AS lr FROM conversations GROUP BY conv_id),
violations AS (
  SELECT conv_id, 'first turn is not system' AS rule, f AS turn FROM first_last WHERE fr <> 'system'
  UNION ALL SELECT conv_id, 'last turn is assistant', l FROM first_last WHERE lr = 'assistant'
  UNION ALL SELECT c.conv_id, 'system turn after the first', c.turn FROM conversations c JOIN first_last x USING (conv_id) WHERE c.role = 'system' AND c.turn > x.f)
"""

_WORDS = "len(regexp_extract_all({}, '\\S+'))"

SQL = {
    "context_tokens": f"""
WITH src AS (SELECT *, false AS marked FROM conversations WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0),
{_MERGE.format(source="src")},
full_rows AS (SELECT conv_id, turn, role, text, {_FULL} AS is_full FROM merged),
short_rows AS (SELECT conv_id, text AS full_text, {_SHORT} AS short_text FROM full_rows)
SELECT conv_id, count(*) AS messages,
  CAST(sum({_WORDS.format("full_text")} + 4) + 2 AS BIGINT) AS tokens_before,
  CAST(sum({_WORDS.format("short_text")} + 4) + 2 AS BIGINT) AS tokens_after
FROM short_rows GROUP BY conv_id""",
    "drop_blank": "SELECT * FROM conversations WHERE turn % 5 <> 3 AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0",
    "merge_runs": f"WITH {_MARKED} {_MERGE.format(source='marked')} SELECT * FROM merged",
    "merge_runs_unmarked": f"WITH src AS (SELECT *, false AS marked FROM conversations), {_MERGE.format(source='src')} SELECT conv_id, turn, role, text, n_turns FROM merged",
    "compact_history": f"WITH f AS (SELECT conv_id, turn, role, text, {_FULL} AS is_full FROM conversations) SELECT conv_id, turn, role, {_SHORT} AS text, is_full FROM f",
    "cap_markers": f"""WITH {_MARKED} r AS (SELECT *, sum(CASE WHEN marked THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS k FROM marked)
SELECT conv_id, turn, role, marked AND (k <= 3 OR role = 'system') AS marked FROM r""",
    "conversation_tokens": f"SELECT conv_id, CAST(sum({_WORDS.format('text')} + 5) + 2 AS BIGINT) AS tokens FROM conversations GROUP BY conv_id",
    "session_context": """
WITH d AS (SELECT conv_id, turn, CAST(CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE -1 END AS BIGINT) AS depth FROM conversations)
SELECT conv_id, turn, depth, row_number() OVER (PARTITION BY conv_id ORDER BY depth, turn) AS position FROM d""",
    "check_conversations": f"WITH {_VIOLATIONS} SELECT * FROM violations",
    "valid_conversations": f"WITH {_VIOLATIONS} SELECT * FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM violations)",
}
