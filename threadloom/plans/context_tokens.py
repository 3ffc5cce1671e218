"""Tokens per conversation before and after compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import word_count
from threadloom.operators.context import compact_history, drop_blank, merge_runs


def context_tokens(conversations: DataFrame, keep_assistant: int = 2) -> DataFrame:
    """Drop blank turns, merge runs, compact, and total the tokens of both forms in one aggregate."""
    merged = merge_runs(drop_blank(conversations)).withColumn("_before", word_count(F.col("text")))
    both = compact_history(merged, keep_assistant, sized_by=conversations)
    return both.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"),
        (F.sum(F.col("_before") + F.lit(4)) + 2).alias("tokens_before"),
        (F.sum(word_count(F.col("text")) + F.lit(4)) + 2).alias("tokens_after"),
    )
