"""Variable state: snapshots, differences, latest values, layered settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.ordered import ROWS_PER_TASK, following, index_block, running, split_if_hot


def public_values(state: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Drop private names (leading underscore) and null values."""
    return state.filter(~F.col(name).startswith("_") & F.col(value).isNotNull())


def diff_states(previous: DataFrame, current: DataFrame, keys: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """New, changed and deleted names per key; private names are skipped, a null value is a value."""
    on = [*keys, name]
    public = lambda df: df.filter(~F.col(name).startswith("_"))
    old = public(previous).select(*on, F.col(value).alias("old_value"), F.lit(True).alias("_old"))
    new = public(current).select(*on, F.col(value).alias("new_value"), F.lit(True).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), F.lit("new")).when(F.col("_new").isNull(), F.lit("deleted"))
        .when(~F.col("old_value").eqNullSafe(F.col("new_value")), F.lit("changed"))
    )
    return old.join(new, on, "full_outer").withColumn("change", change).filter(F.col("change").isNotNull()).drop("_old", "_new")


def deleted_keys(previous: DataFrame, current: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    on = [*keys, name]
    gone = previous.select(*on).join(current.select(*on).distinct(), on, "left_anti")
    return gone.filter(~F.col(name).startswith("_"))


def next_steps(
    snapshots: DataFrame, session: str = "session_id", step: str = "step", rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """(session, step, next_step) from the distinct steps of each session."""
    steps = snapshots.select(session, step).distinct()
    block = split_if_hot(steps, [session], index_block(F.col(step), rows_per_task), rows_per_task)
    return running(steps, [session], [step], block, next_step=following(F.col(step)))


def snapshot_diffs(snapshots: DataFrame, session: str = "session_id", step: str = "step") -> DataFrame:
    """Difference of each snapshot to the one before it in the session; the first one is all new.

    The earlier snapshot is moved to the step after it, so this is one equi-join on (session, step, name)
    and no session is gathered in one task.
    """
    follow = next_steps(snapshots, session, step)
    moved = (
        snapshots.join(follow.filter("next_step is not null"), [session, step])
        .select(session, F.col("next_step").alias(step), "name", "value")
    )
    return diff_states(moved, snapshots, [session, step])


def state_changes(snapshots: DataFrame, session: str = "session_id", step: str = "step") -> DataFrame:
    """New and changed values over time; the first snapshot and deletions publish nothing."""
    first = snapshots.groupBy(session).agg(F.min(step).alias("_first"))
    diffs = snapshot_diffs(snapshots, session, step).filter(F.col("change") != "deleted")
    return diffs.join(first, session).filter(F.col(step) > F.col("_first")).drop("_first", "old_value")


def latest_state(changes: DataFrame, keys: list[str], value: str = "value", order: list[str] | None = None) -> DataFrame:
    """Last value per key; a change with a null value is a deletion and removes the name."""
    order = order or ["ts", "event_id"]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_v"))
    return last.select(*keys, F.col(f"_v.{value}").alias(value)).filter(F.col(value).isNotNull())


def effective_settings(layers: DataFrame) -> DataFrame:
    """Value per key path from the layer of highest precedence; lists are single values.

    A value of a higher layer also replaces what lower layers hold above or below its path (``a = 9`` and ``a.b = 1``).
    """
    best = layers.groupBy("key_path").agg(
        F.max_by("value", "precedence").alias("value"), F.max_by("layer", "precedence").alias("layer"), F.max("precedence").alias("_level")
    )
    parts = F.split("key_path", r"\.")
    above = F.transform(F.expr(r"sequence(1, size(split(key_path, '\\.')) - 1)"), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    below = best.filter(F.size(parts) > 1).select("key_path", "_level", F.explode(above).alias("_up"))
    outer = best.select(F.col("key_path").alias("_up"), F.col("_level").alias("_up_level"))
    met = below.join(outer, "_up").filter("_level <> _up_level")
    lost = met.select(F.when(F.col("_level") < F.col("_up_level"), F.col("key_path")).otherwise(F.col("_up")).alias("key_path")).distinct()
    return best.join(lost, "key_path", "left_anti").drop("_level")


def offload_large(df: DataFrame, column: str, threshold: int = 500) -> tuple[DataFrame, DataFrame]:
    """(main, side): values longer than ``threshold`` move to a side table keyed by their full content hash.

    ``artifact`` and ``name`` are short labels for people; only ``content_hash`` identifies a value.
    """
    large = F.length(column) > threshold
    name = F.concat(F.lit("a_"), F.substring(F.sha2(F.col(column), 256), 1, 8))
    named = df.withColumn("artifact", F.when(large, name)).withColumn("content_hash", F.when(large, F.sha2(F.col(column), 256)))
    main = named.withColumn(column, F.when(F.col("artifact").isNull(), F.col(column)))
    side = named.filter(F.col("artifact").isNotNull()).select(F.col("artifact").alias("name"), "content_hash", F.col(column).alias("value"))
    return main, side.dropDuplicates(["content_hash"])
