"""Ordered computations that stay parallel when one key holds a large share of the rows.

``Window.partitionBy(key)`` puts every row of a key in one task.  That is the cheapest plan while the
largest key fits a task, so ``split_if_hot`` checks the key sizes first (a narrow scan with map-side
counts).  When a key is larger, it is cut into blocks that are contiguous in the sort order: the window
runs per (key, block), and what the earlier blocks contribute is a small aggregate (one row per block)
that is joined back.  Both ways give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from threadloom.functions.checkpoints import cut

ROWS_PER_TASK = 1_000_000
SECONDS_PER_BLOCK = 3600
MAX_NAMED_KEYS = 64

BLOCK = "_block"


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is ``sum``, ``min``, ``max`` or ``last`` (nearest non-null).

    ``inclusive`` counts the current row; ``reverse`` runs from the end of the order.
    """

    kind: str
    value: Column
    inclusive: bool = True
    reverse: bool = False


def count_rows(inclusive: bool = True, reverse: bool = False) -> Running:
    return Running("sum", F.lit(1).cast("bigint"), inclusive, reverse)


def previous(value: Column) -> Running:
    """The value of the row before; pass a struct so that nulls inside are kept."""
    return Running("last", value, inclusive=False)


def following(value: Column) -> Running:
    return Running("last", value, inclusive=False, reverse=True)


def index_block(column: Column, size: int = ROWS_PER_TASK) -> Column:
    """Blocks for a dense integer order such as a turn or line number."""
    return F.floor(column / F.lit(size)).cast("bigint")


def time_block(column: Column, seconds: int = SECONDS_PER_BLOCK) -> Column:
    """Blocks for a timestamp order; choose ``seconds`` so the busiest key fits a task per block."""
    return F.floor(F.unix_seconds(column.cast("timestamp")) / F.lit(seconds)).cast("bigint")


def _fold(kind: str, value: Column) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True)
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](value)


def split_if_hot(df: DataFrame, keys: list[str], block: Column, rows_per_task: int = ROWS_PER_TASK) -> Column | None:
    """None when no key has more rows than a task should take, else the block column.

    Up to ``MAX_NAMED_KEYS`` large keys are named in the column, so that only they are cut; with more of
    them every key is cut.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") > rows_per_task).select(*keys).limit(MAX_NAMED_KEYS + 1).collect()
    if not large:
        return None
    if len(large) > MAX_NAMED_KEYS:
        return block
    named = [reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(row[k])) for k in keys]) for row in large]
    return F.when(reduce(lambda a, b: a | b, named), block)


def settle(df: DataFrame, block: Column | None) -> DataFrame:
    """Between two split passes: cut the lineage, since a split pass reads its input twice."""
    return df if block is None else cut(df)


def running(df: DataFrame, keys: list[str], order: list[str], block: Column | None, **columns: Running) -> DataFrame:
    """Add running values over ``keys`` sorted by ``order``.

    ``block`` is None for one window per key, else a column that does not decrease along ``order``;
    any such choice gives the same result.
    """
    if block is None:
        return df.withColumns({n: _whole(c, keys, order) for n, c in columns.items()})
    return _blocked(df, keys, order, block, columns)


def _ordering(names: list[str], reverse: bool) -> list[Column]:
    return [F.col(n).desc() if reverse else F.col(n).asc() for n in names]


def _whole(c: Running, keys: list[str], order: list[str]) -> Column:
    frame = W.partitionBy(*keys).orderBy(*_ordering(order, c.reverse))
    value = _fold(c.kind, c.value).over(frame.rowsBetween(W.unboundedPreceding, 0 if c.inclusive else -1))
    return F.coalesce(value, F.lit(0)) if c.kind == "sum" else value


def _blocked(df, keys, order, block, columns) -> DataFrame:
    blocked = df.withColumn(BLOCK, block).withColumns({f"_v_{n}": c.value for n, c in columns.items()})
    inner = [*keys, BLOCK]

    local, totals, carried = {}, [], {}
    for name, c in columns.items():
        v = F.col(f"_v_{name}")
        frame = W.partitionBy(*inner).orderBy(*_ordering(order, c.reverse))
        local[f"_l_{name}"] = _fold(c.kind, v).over(frame.rowsBetween(W.unboundedPreceding, 0 if c.inclusive else -1))
        if c.kind == "last":
            pick = F.min_by if c.reverse else F.max_by
            totals.append(pick(v, F.when(v.isNotNull(), F.struct(*order))).alias(f"_t_{name}"))
        else:
            totals.append(_fold(c.kind, v).alias(f"_t_{name}"))
        outer = W.partitionBy(*keys).orderBy(*_ordering([BLOCK], c.reverse)).rowsBetween(W.unboundedPreceding, -1)
        carried[f"_c_{name}"] = _fold(c.kind, F.col(f"_t_{name}")).over(outer)

    summary = blocked.groupBy(*inner).agg(*totals).withColumns(carried)
    summary = summary.select(
        *[F.col(k).alias(f"_k_{k}") for k in inner], *[f"_c_{n}" for n in columns]
    )
    rows = blocked.withColumns(local)
    joined = rows.join(
        summary, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in inner]), "left"
    )
    merge = {
        "sum": lambda carry, own: F.coalesce(carry, F.lit(0)) + F.coalesce(own, F.lit(0)),
        "min": F.least,
        "max": F.greatest,
        "last": lambda carry, own: F.coalesce(own, carry),
    }
    results = [
        merge[c.kind](F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, c in columns.items()
    ]
    return joined.select(*[c for c in df.columns if c not in columns], *results)


def stack_depth(df: DataFrame, keys: list[str], order: list[str], block: Column | None, step: Column) -> DataFrame:
    """Add ``depth_before`` / ``depth_after`` of a stack; a pop on an empty stack is ignored.

    ``step`` is +1 for a push, -1 for a pop and 0 otherwise.  The ignored pops are the new minima of
    the plain running sum, so depth = sum - min(0, lowest sum so far).
    """
    summed = running(df.withColumn("_step", step.cast("bigint")), keys, order, block, _sum=Running("sum", F.col("_step")))
    low = running(
        settle(summed, block), keys, order, block,
        _low=Running("min", F.col("_sum")),
        _low_before=Running("min", F.col("_sum"), inclusive=False),
    )
    floor0 = lambda name: F.least(F.lit(0), F.coalesce(F.col(name), F.lit(0)))
    return low.withColumns({
        "depth_before": F.col("_sum") - F.col("_step") - floor0("_low_before"),
        "depth_after": F.col("_sum") - floor0("_low"),
    }).drop("_step", "_sum", "_low", "_low_before")
