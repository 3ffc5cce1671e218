"""Dotted step numbers: natural order, parents, following steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.ordered import ROWS_PER_TASK, following, running, split_if_hot


def dense_steps(steps: DataFrame, key: str = "doc_id", number: str = "step_no", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Parent (the number without its last part, if it exists) and next step in natural order.

    ``01.02`` sorts by its parts as numbers, a shorter prefix first.
    """
    parts = F.transform(F.split(number, r"\."), lambda x: x.cast("int"))
    keyed = steps.withColumn("_parts", parts)
    block = split_if_hot(steps, [key], F.col("_parts")[0], rows_per_task)
    ordered = running(keyed, [key], ["_parts"], block, next_step=following(F.col(number)))
    above = F.regexp_extract(number, r"^(.*)\.[^.]*\z", 1)
    known = steps.select(F.col(key).alias("_k"), F.col(number).alias("_parent"))
    return (
        ordered.withColumn("_above", F.when(above != "", above))
        .join(known, (F.col(key) == F.col("_k")) & (F.col("_above") == F.col("_parent")), "left")
        .withColumn("parent_step", F.col("_parent")).drop("_k", "_parent", "_above", "_parts")
    )
