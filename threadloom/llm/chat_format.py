"""Chat formatting of turns with typed content parts; DataFrame and SQL functions only.

A turn is written as TURN role SAYS parts END.  Text parts are written as they are, but control strings inside them
(and inside roles) are escaped: ``<``, any number of backslashes and ``|`` get one backslash more, so ``<|`` occurs in
marks alone, and taking one backslash away gives the text back.  Other parts become numbered placeholders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.fingerprints import _fixed

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
END_PATTERN, SAYS_PATTERN, PLACEHOLDER = r"<\|end\|>", r"<\|says\|>", r"<\|(?:image|audio|document) [0-9]+\|>"
KINDS = ("text", "image", "audio", "document")
#: A content part; fields that do not belong to its type are null.
PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
#: What attachments expand to in a model's input: a token for each square of an image, tokens a second, tokens a page.
IMAGE_SQUARE = 14
AUDIO_TOKENS = 25
PAGE_TOKENS = 512
#: The role whose text is learned from.
LEARNED = "assistant"
WORDS = r"[^\x20\x09-\x0D]+"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def text_part(text: Column) -> Column:
    """A text as its only part; null counts as empty."""
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *empty))


def part_tokens(part: Column) -> Column:
    """Tokens of a part: the words of a text, or what an attachment expands to; an unknown size counts as none."""
    squares = lambda side: F.ceil(F.coalesce(side, F.lit(0)) / F.lit(float(IMAGE_SQUARE)))
    return (
        F.when(part["type"] == "text", F.regexp_count(F.coalesce(part["text"], F.lit("")), F.lit(WORDS)).cast("long"))
        .when(part["type"] == "image", squares(part["width"]) * squares(part["height"]))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * F.lit(float(AUDIO_TOKENS))))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)).cast("long") * PAGE_TOKENS)
        .otherwise(F.lit(0).cast("long"))
    )


def visited_parts(turns: DataFrame) -> DataFrame:
    """The visit of all parts of (conv_id, turn, role, parts), in order; one row for each part, or for a turn without any.

    Rows (conv_id, seq, turn_no, out, at, start, length, learned, number, type, ref, tokens): ``out`` is what the part
    adds to the formatted conversation, with the marks of its turn; a part's own characters stand ``start`` code points
    after the conversation's begin and ``at`` after the turn's, ``length`` long.  ``number`` counts attachments from 1.
    """
    no_parts = F.array().cast(f"array<{PART}>")
    rows = turns.select(
        F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.filter("parts", lambda p: p.isNotNull()), no_parts).alias("parts"))
    rows = rows.withColumn("tie", F.xxhash64("parts")).select("*", F.posexplode_outer("parts").alias("place", "p"))
    kind = F.col("p.type")
    known = F.when(F.col("p").isNull() | kind.isin(*KINDS), kind).otherwise(F.raise_error(F.concat(F.lit("unknown content part: "), F.coalesce(kind, F.lit("null")))))
    rows = rows.select(
        "conv_id", "turn", "role", "tie", "row", F.coalesce("place", F.lit(0)).alias("place"), known.alias("type"), F.col("p.ref").alias("ref"),
        F.when(kind == "text", escaped(F.coalesce("p.text", F.lit("")))).alias("text"), part_tokens(F.col("p")).alias("tokens"),
        (F.col("place").isNull() | (F.col("place") == 0)).alias("opens"), (F.col("place").isNull() | (F.col("place") == F.size("parts") - 1)).alias("closes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "tie", "row", "place")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    attached = F.col("type") != "text"
    rows = rows.withColumn("seq", F.row_number().over(order)).withColumn("number", F.when(attached, F.sum(attached.cast("int")).over(so_far)))
    own = F.when(F.col("type") == "text", F.col("text")).when(attached, F.concat(F.lit("<|"), "type", F.lit(" "), F.col("number").cast("string"), F.lit("|>"))).otherwise(F.lit(""))
    head = F.when(F.col("opens"), F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(SAYS))).otherwise(F.lit(""))
    rows = rows.withColumn("own", own).withColumn("head", head).withColumn("out", F.concat("head", "own", F.when(F.col("closes"), F.lit(END)).otherwise(F.lit(""))))
    begin = F.sum(F.char_length("out").cast("long")).over(so_far) - F.char_length("out")
    rows = rows.withColumn("begin", begin).withColumn("turn_no", F.sum(F.col("opens").cast("int")).over(so_far) - 1)
    rows = rows.withColumn("start", F.col("begin") + F.char_length("head")).withColumn("turn_begin", F.max(F.when(F.col("opens"), F.col("begin"))).over(so_far))
    return rows.select(
        "conv_id", "seq", "turn_no", "out", (F.col("start") - F.col("turn_begin")).alias("at"), "start", F.char_length("own").cast("long").alias("length"),
        ((F.col("role") == LEARNED) & F.coalesce(F.col("type") == "text", F.lit(False))).alias("learned"), "number", "type", "ref", "tokens")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row (conv_id, formatted, learned, attachments, tokens) for each conversation of (conv_id, turn, role, parts).

    ``learned`` is the loss mask: spans (turn_no, at, start, length) of the learned role's text parts, in order, in code
    points from the turn's and from the conversation's begin.  ``attachments`` holds (number, type, ref, tokens) of every
    placeholder.  ``tokens`` counts the words of texts and the expanded tokens of attachments.

    Turns are ordered by turn, nulls first, then by role and a hash of the parts; repeated rows are turns of their own.
    Null roles and texts are empty, null parts are skipped, a turn may have no parts, and a part of unknown type is
    refused with an error.  A null conv_id is a conversation.  Other columns are ignored; no rows give no rows.  A
    conversation is one row, so its formatted text must fit one (2 GB).
    """
    parts = visited_parts(turns)
    span = F.when(F.col("learned"), F.struct("seq", "turn_no", "at", "start", "length"))
    attachment = F.when(F.col("number").isNotNull(), F.struct("number", "type", "ref", "tokens"))
    rows = parts.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "out"))).alias("pieces"), F.sort_array(F.collect_list(span)).alias("spans"),
        F.sort_array(F.collect_list(attachment)).alias("attachments"), F.sum("tokens").alias("tokens"))
    return rows.select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: p["out"]), "").alias("formatted"),
        F.transform("spans", lambda s: F.struct(s["turn_no"].alias("turn_no"), s["at"].alias("at"), s["start"].alias("start"), s["length"].alias("length"))).alias("learned"),
        "attachments", "tokens")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds what is read from ``formatted`` and ``learned`` alone: ``turns`` and ``learned_texts``.

    ``turns``: array of (role, texts, marks), the unescaped texts before, between and after the placeholders ``marks``.
    Every turn and every span is cut out of its turn's own text, so the work is linear in the conversation.
    """
    cut = F.split("formatted", END_PATTERN)
    rows = _fixed(formatted, _turns=F.slice(cut, 1, F.size(cut) - 1))
    role = lambda t: unescaped(F.substring(F.element_at(F.split(t, SAYS_PATTERN, 2), 1), len(TURN) + 1, 2147483647))
    body = lambda t: F.element_at(F.split(t, SAYS_PATTERN, 2), 2)
    turn = lambda t: F.struct(
        role(t).alias("role"), F.transform(F.split(body(t), PLACEHOLDER), unescaped).alias("texts"), F.regexp_extract_all(body(t), F.lit(PLACEHOLDER), F.lit(0)).alias("marks"))
    text = lambda s: unescaped(F.substring(F.get("_turns", s["turn_no"]), (s["at"] + 1).cast("int"), s["length"].cast("int")))
    rows = _fixed(rows, turns=F.transform("_turns", turn), learned_texts=F.transform("learned", text))
    return rows.drop("_turns")


#: The conversation that the query adds: texts that look like marks of other templates and like escapes.
PROBE_ID, PROBE = -7, "\\### Assistant: </turn> ok"


def op13_chat_format(spark, sf_dir: str) -> DataFrame:
    probe = F.inline(F.array(*[F.struct(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(PROBE).alias("text"))
                               for i, r in enumerate(("user", "assistant"))]))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(spark.range(1).select(probe))
    rows = read_back(format_conversations(turns.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), F.array_join(t["texts"], ""), F.lit("\n"))), "")
    rows = _fixed(rows, loss=F.array_join("learned_texts", ""))
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


SQL = {"op13_chat_format": f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT {PROBE_ID}, i, r, '{PROBE}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
           sum({len(TURN + SAYS + END)} + length(role) + length(text) + len(regexp_extract_all(role || ' ' || text, '<\\\\*\\|')))::BIGINT AS formatted_chars
    FROM t GROUP BY conv_id"""}
QUERIES = {"op13_chat_format": op13_chat_format}
