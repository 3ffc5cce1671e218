"""Queues of bounded length: which message each read takes and each full queue drops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.ordered import BLOCK, Running, following, running


def clamped_sum(df: DataFrame, keys: list[str], order: list[str], block: Column, step: Column, low: int, high: int, name: str) -> DataFrame:
    """Add ``name``: the running sum of ``step`` before each row, kept between ``low`` and ``high`` after every row.

    A row is the function x -> min(high, max(low, x + step)), and functions of the kind min(h, max(l, x + s)) compose to
    one of that kind.  So the blocks of a key are folded on their own, in parallel and as sorted streams of rows; the
    composed functions of earlier blocks, one row for each block, give the value at a block's begin.  ``block`` does not
    decrease along ``order``; building the plan runs nothing.
    """
    inner = [*keys, BLOCK]
    dealt = df.withColumn(BLOCK, block).withColumn("_step", step.cast("bigint")).repartition(*inner).sortWithinPartitions(*inner, *order)
    schema = T.StructType([*dealt.schema.fields, *[T.StructField(f, T.LongType()) for f in ("_s", "_l", "_h")]])

    def compose(batches):
        import pyarrow as pa

        at, s, l, h = None, 0, low, high  # noqa: E741
        for batch in batches:
            found = []
            for *key, a in zip(*(batch.column(c).to_pylist() for c in (*inner, "_step"))):
                if key != at:
                    at, s, l, h = key, 0, low, high  # noqa: E741
                found.append((s, l, h))
                s, l, h = s + a, min(high, max(low, l + a)), min(high, max(low, h + a))  # noqa: E741
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([x[i] for x in found], pa.int64()) for i in range(3)]], schema.fieldNames())

    rows = dealt.mapInArrow(compose, schema)
    # a block's own function: that of the rows before its last one, and then that row
    last = F.max_by(F.struct("_s", "_l", "_h", "_step"), F.struct(*order)).alias("f")
    whole = rows.groupBy(*inner).agg(last).select(
        *inner, (F.col("f._s") + F.col("f._step")).alias("s"),
        *[F.least(F.lit(high), F.greatest(F.lit(low), F.col(f"f.{x}") + F.col("f._step"))).alias(x[1:]) for x in ("_l", "_h")])
    # blocks of one key in order: a few numbers for each
    chain = whole.repartition(*keys).sortWithinPartitions(*inner)
    begins = T.StructType([*[T.StructField(f"_k_{k}", whole.schema[k].dataType) for k in inner], T.StructField("_begin", T.LongType())])

    def follow(batches):
        import pyarrow as pa

        at, x = None, 0
        for batch in batches:
            found = []
            for *key, s, l, h in zip(*(batch.column(c).to_pylist() for c in (*keys, "s", "l", "h"))):  # noqa: E741
                if key != at:
                    at, x = key, max(low, min(high, 0))
                found.append(x)
                x = min(h, max(l, x + s))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in inner), pa.array(found, pa.int64())], begins.fieldNames())

    begin = chain.mapInArrow(follow, begins)
    joined = rows.join(begin, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in inner]))
    value = F.least("_h", F.greatest("_l", F.col("_begin") + F.col("_s")))
    return joined.withColumn(name, value).select(*df.columns, name)


def bounded_queue(messages: DataFrame, max_size: int, key: str, order: list[str], block: Column) -> DataFrame:
    """What becomes of every message put into a queue of at most ``max_size``: rows (key, *order, priority, fate, by).

    ``messages`` has ``op``: ``put`` appends at the end, ``priority`` puts to the front, ``get`` takes the front message;
    other or null ops do nothing.  A put into a full queue drops the message at the other end; a get from an empty queue
    does nothing.  ``fate`` is read, evicted or waiting, and ``by`` the order columns of the row that took or dropped it.

    The queue's length is a clamped running sum.  With it both ends are running sums of places on a line, every message
    is written to one place, and what takes it is the next row at that place.  ``order`` is unique within a key.
    """
    if max_size < 1:
        raise ValueError("a queue holds at least one message")
    put, first, get = (F.coalesce(F.col("op") == x, F.lit(False)) for x in ("put", "priority", "get"))
    rows = messages.select(key, *order, "op").filter(put | first | get)
    sized = clamped_sum(rows, [key], order, block, F.when(get, -1).otherwise(1), 0, max_size, "_size")
    full, some = F.col("_size") == max_size, F.col("_size") > 0
    # the front is the place of the first message, the end that after the last one
    front = F.when(first, -1).when(get & some, 1).when(put & full, 1).otherwise(0)
    end = F.when(put, 1).when(first & full, -1).otherwise(0)
    ends = running(sized, [key], order, block, _front=Running("sum", front, inclusive=False), _end=Running("sum", end, inclusive=False))
    writes = F.when(put, F.col("_end")).when(first, F.col("_front") - 1)
    takes = F.when((get & some) | (put & full), F.col("_front")).when(first & full, F.col("_end") - 1)
    at = F.filter(F.array(
        F.struct(writes.alias("place"), F.lit("write").alias("what")),
        F.struct(takes.alias("place"), F.when(get, F.lit("read")).otherwise(F.lit("evicted")).alias("what")),
    ), lambda x: x["place"].isNotNull())
    events = ends.select(key, *order, "op", F.inline(at))
    then = running(events, [key, "place"], order, block, _next=following(F.struct("what", *order)))
    return then.filter("what = 'write'").select(
        key, *order, (F.col("op") == "priority").alias("priority"), F.coalesce("_next.what", F.lit("waiting")).alias("fate"),
        F.when(F.col("_next").isNotNull(), F.struct(*[F.col(f"_next.{c}").alias(c) for c in order])).alias("by"))
