"""Conversation context: blank removal, run merging, compaction, marker limits, token totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.ordered import (
    ROWS_PER_TASK, Running, count_rows, index_block, previous, running, settle, split_if_hot,
)
from threadloom.functions.text import strip, word_count


def drop_blank(messages: DataFrame, content: str = "text") -> DataFrame:
    """Drop messages whose content is only white space."""
    return messages.filter(F.length(strip(F.col(content))) > 0)


def with_runs(conv: DataFrame, key: str = "conv_id", order: str = "turn", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add ``run_start``, the turn that opens the run of same-role turns a turn belongs to.

    A marked turn closes its run unless it opened it by changing the role; the first turn of a
    conversation and a turn after a closed run close at once.
    """
    block = split_if_hot(conv, [key], index_block(F.col(order), rows_per_task), rows_per_task)
    prev = running(conv, [key], [order], block, _prev=previous(F.struct("role", "marked")))
    same = F.col("_prev").isNotNull() & F.col("_prev.role").eqNullSafe(F.col("role"))
    closing = F.coalesce(F.col("marked"), F.lit(False)) & (F.col("_prev").isNull() | same)
    closed = prev.withColumn("_same", same).withColumn("_closes", closing)
    closed = running(settle(closed, block), [key], [order], block, _prev_closes=previous(F.col("_closes")))
    opens = ~F.col("_same") | F.coalesce(F.col("_prev_closes"), F.lit(False))
    started = closed.withColumn("_opens_at", F.when(opens, F.col(order)))
    return running(settle(started, block), [key], [order], block, run_start=Running("last", F.col("_opens_at"))).drop(
        "_prev", "_same", "_closes", "_prev_closes", "_opens_at"
    )


def merge_runs(conv: DataFrame, key: str = "conv_id", order: str = "turn", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Merge adjacent turns of one role into one, joined by a blank line.

    Needs ``role``, ``text`` and, for closing runs early, a boolean ``marked``.  Text is joined per
    block first, so a long run is concatenated by many tasks before its pieces meet.
    """
    if "marked" not in conv.columns:
        conv = conv.withColumn("marked", F.lit(False))
    runs = with_runs(conv.select(key, order, "role", "text", "marked"), key, order, rows_per_task)

    def join_texts(at: str):
        texts = F.transform(F.sort_array(F.collect_list(F.struct(at, "text"))), lambda x: x["text"])
        return F.array_join(texts, "\n\n")

    pieces = runs.groupBy(key, "run_start", index_block(F.col(order), rows_per_task).alias("_at")).agg(
        join_texts(order).alias("text"),
        F.first("role").alias("role"),
        F.bool_or(F.coalesce("marked", F.lit(False))).alias("marked"),
        F.count(F.lit(1)).alias("n_turns"),
    )
    return pieces.groupBy(key, "run_start").agg(
        F.first("role").alias("role"),
        join_texts("_at").alias("text"),
        F.bool_or("marked").alias("marked"),
        F.sum("n_turns").alias("n_turns"),
    ).withColumnRenamed("run_start", order)


def short_assistant(text: Column) -> Column:
    """First two lines after removing the code fence around the text."""
    bare = strip(F.regexp_replace(text, r"^\s*```(?:python)?|```\s*\z", ""))
    return F.array_join(F.slice(F.split(bare, "\n", -1), 1, 2), "\n")


def short_user(text: Column) -> Column:
    return F.split(text, "\n", -1)[0]


def compact_history(
    conv: DataFrame, keep_assistant: int = 2, key: str = "conv_id", order: str = "turn",
    instruction: str | None = None, rows_per_task: int = ROWS_PER_TASK, sized_by: DataFrame | None = None,
) -> DataFrame:
    """Keep the last assistant turns and the last user turn in full, shorten the other ones.

    ``keep_assistant=0`` keeps every assistant turn.  Other roles are never shortened.  A user turn
    is shortened to its ``instruction`` column, or to its first line when there is none.
    ``sized_by`` is a cheaper frame with at least as many rows per key, used to check the key sizes.
    """
    block = split_if_hot(conv if sized_by is None else sized_by, [key, "role"], index_block(F.col(order), rows_per_task), rows_per_task)
    ranked = running(conv, [key, "role"], [order], block, _from_end=count_rows(reverse=True))
    assistant_full = F.lit(True) if keep_assistant == 0 else F.col("_from_end") <= keep_assistant
    full = (
        F.when(F.col("role") == "assistant", assistant_full)
        .when(F.col("role") == "user", F.col("_from_end") <= 1)
        .otherwise(F.lit(True))
    )
    short = F.when(F.col("role") == "assistant", short_assistant(F.col("text"))).otherwise(
        F.col(instruction) if instruction else short_user(F.col("text"))
    )
    return (
        ranked.withColumn("is_full", full)
        .withColumn("text", F.when(F.col("is_full"), F.col("text")).otherwise(short))
        .drop("_from_end")
    )


def cap_markers(conv: DataFrame, n: int = 3, key: str = "conv_id", order: str = "turn", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Only the last ``n`` marked turns keep their mark; system turns always keep it."""
    mark = F.coalesce(F.col("marked"), F.lit(False))
    block = split_if_hot(conv, [key], index_block(F.col(order), rows_per_task), rows_per_task)
    ranked = running(
        conv, [key], [order], block,
        _rank=Running("sum", mark.cast("bigint"), reverse=True),
    )
    return ranked.withColumn("marked", mark & ((F.col("_rank") <= n) | (F.col("role") == "system"))).drop("_rank")


def conversation_tokens(
    messages: DataFrame, key: str = "conv_id", content: str = "text", name: str | None = None, counter=word_count,
) -> DataFrame:
    """Tokens per conversation: content, 4 per message, 1 for a name, 2 per conversation.

    ``counter`` maps a text column to a token count column; the default counts words.
    """
    named = F.col(name).isNotNull().cast("bigint") if name else F.lit(0).cast("bigint")
    per_message = F.coalesce(counter(F.col(content)).cast("bigint"), F.lit(0)) + 4 + named
    return messages.groupBy(key).agg((F.sum(per_message) + 2).alias("tokens"))


def session_context(
    frames: DataFrame, messages: DataFrame, key: str = "conv_id", order: str = "turn", rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Position of every message in the session context: top-level messages first, then frame by frame.

    ``frames(key, frame, depth)`` is joined on the frame name; a message without a frame is top level.
    """
    placed = messages.join(frames, [key, "frame"], "left").withColumn("depth", F.coalesce("depth", F.lit(-1)))
    block = split_if_hot(messages, [key], F.struct("depth", index_block(F.col(order), rows_per_task)), rows_per_task)
    return running(placed, [key], ["depth", order], block, position=count_rows())


def check_conversations(conv: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row per violated rule: first turn is system, no other system turn, last turn is not assistant."""
    edges = conv.groupBy(key).agg(
        F.min(order).alias("_first"), F.max(order).alias("_last"),
        F.min_by("role", order).alias("_first_role"), F.max_by("role", order).alias("_last_role"),
    )
    ends = edges.select(key, F.explode(F.array_compact(F.array(
        F.when(~F.col("_first_role").eqNullSafe(F.lit("system")),
               F.struct(F.lit("first turn is not system").alias("rule"), F.col("_first").alias(order))),
        F.when(F.col("_last_role") == "assistant",
               F.struct(F.lit("last turn is assistant").alias("rule"), F.col("_last").alias(order))),
    ))).alias("v")).select(key, "v.rule", f"v.{order}")
    firsts = edges.select(key, "_first")
    later = (
        conv.filter(F.col("role") == "system").select(key, order)
        .join(firsts, key).filter(F.col(order) > F.col("_first"))
        .select(key, F.lit("system turn after the first").alias("rule"), order)
    )
    return ends.unionByName(later)


def valid_conversations(conv: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    return conv.join(check_conversations(conv, key, order).select(key).distinct(), key, "left_anti")
