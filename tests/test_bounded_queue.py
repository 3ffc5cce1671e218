"""Bounded queues against a plain deque, with blocks of any size and hot or null keys."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from threadloom.functions.ordered import index_block
from threadloom.operators import queues


def brute(rows, size):
    held, out = {}, {}
    for key, seq, op in sorted(rows, key=lambda r: r[1]):
        q = held.setdefault(key, deque())
        if op == "get":
            if q:
                out[q.popleft()][2:] = ["read", seq]
        elif op in ("put", "priority"):
            out[seq] = [key, op == "priority", "waiting", None]
            if len(q) == size:
                out[q.popleft() if op == "put" else q.pop()][2:] = ["evicted", seq]
            (q.append if op == "put" else q.appendleft)(seq)
    return {(v[0], k): tuple(v[1:]) for k, v in out.items()}


@pytest.mark.parametrize("size,block", [(1, 3), (2, 7), (3, 1), (5, 1000)])
def test_equals_a_deque(spark, size, block):
    rng = random.Random(size)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice(["put", "put", "priority", "get", None, "other"])) for i in range(300)]
    df = spark.createDataFrame(rows, "recipient string, seq long, op string")
    out = queues.bounded_queue(df, size, "recipient", ["seq"], index_block(F.col("seq"), block))
    assert {(r.recipient, r.seq): (r.priority, r.fate, r.by.seq if r.by else None) for r in out.collect()} == brute(rows, size)


def test_no_rows_and_no_room(spark):
    none = spark.createDataFrame([], "recipient string, seq long, op string")
    assert queues.bounded_queue(none, 2, "recipient", ["seq"], index_block(F.col("seq"))).count() == 0
    with pytest.raises(ValueError):
        queues.bounded_queue(none, 0, "recipient", ["seq"], index_block(F.col("seq")))
