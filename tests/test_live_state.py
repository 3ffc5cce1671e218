"""Live jobs whose state ends: memberships that change, end marks, handover from history, typed batch state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from threadloom.operators import batching, messages
from threadloom.streaming import batches, live

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))


def test_members_are_read_anew(spark, tmp_path):
    schema = "channel_id int, seq long, sender string"
    for i, rows in enumerate([[(1, 1, "a")], [(1, 2, "a"), (2, 1, "x")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    calls = []

    def members(session):
        calls.append(1)
        return session.createDataFrame([(1, "a"), (1, "b")] + [(1, "c")] * (len(calls) > 1), "channel_id int, participant_id string")

    live.fan_out_live(stream_of(spark, tmp_path / "in", schema), members, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.seq, r.recipient) for r in got) == [(1, "b"), (2, "b"), (2, "c")]


def test_observers_of_all_kinds_once(spark):
    events = spark.createDataFrame([(1, 1, "u"), (1, 2, None), (1, 3, "="), (2, 4, "u")], "channel_id int, seq int, recipient string")
    observers = spark.createDataFrame([(1, "all", None), (1, "u", "u"), (1, "v", "v"), (1, "all", None), (1, "eq", "=")], "channel_id int, observer_id string, target string")
    got = sorted((r.seq, r.observer_id) for r in messages.notify_observers(events, observers).collect())
    assert got == sorted([(1, "all"), (1, "all"), (1, "u"), (2, "all"), (2, "all"), (2, "u"), (2, "v"), (2, "eq"), (3, "all"), (3, "all"), (3, "eq")])


def test_end_marks_close_the_tail(spark, tmp_path):
    spark.createDataFrame([("a", at(0)), ("b", at(5)), ("c", at(9))], "invite string, ts timestamp").write.parquet(f"{tmp_path}/i")
    spark.createDataFrame([("a", at(10), True), ("b", at(6), False)], "invite string, ts timestamp, accepted boolean").write.parquet(f"{tmp_path}/r")
    read = lambda n, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{n}")
    marks = live.EndMarks(spark)
    invites = marks.add(read("i", "invite string, ts timestamp"), invite="mark")
    responses = marks.add(read("r", "invite string, ts timestamp, accepted boolean"), invite="mark")
    out = live.run_to_end(live.await_responses_live(invites, responses, "invite"), "resp", marks)
    assert {r.invite: r.status for r in out.collect() if r.invite != "mark"} == {"a": "accepted", "b": "rejected", "c": "timeout"}


def replay(spark, tmp_path, history, source, **more):
    live.replay_then_follow(history, source, str(tmp_path / "out"), str(tmp_path / "cp"), **more).awaitTermination()
    return sorted((r.event_id, r.payload) for r in spark.read.parquet(str(tmp_path / "out")).collect())


SCHEMA = "event_id long, payload string, ts timestamp"


def test_replay_writes_each_live_event_once(spark, tmp_path):
    for i, rows in enumerate([[(7, "a", at(20)), (1, "live", at(1))], [(7, "a", at(20)), (8, "b", None), (2, "live", at(2)), (9, "early", at(3))]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    history = spark.createDataFrame([(1, "h", at(1)), (2, "h", at(10))], SCHEMA)
    want = [(1, "h"), (2, "h"), (7, "a"), (8, "b"), (9, "early")]
    source = stream_of(spark, tmp_path / "in", SCHEMA)
    assert replay(spark, tmp_path, history, source) == want
    # a restart keeps the committed history, even when another one is handed over, and adds only what is new
    spark.createDataFrame([(10, "c", at(30))], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in/2"))
    assert replay(spark, tmp_path, history.filter("event_id = 1"), source) == sorted([*want, (10, "c")])


def test_half_written_history_is_written_again(spark, tmp_path):
    spark.createDataFrame([(99, "half", at(0))], SCHEMA).write.parquet(str(tmp_path / "out/part=history"))
    spark.createDataFrame([(1, "live", at(1)), (5, "new", at(9))], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in/0"))
    history = spark.createDataFrame([(1, "h", at(1)), (2, "h", at(2))], SCHEMA)
    assert replay(spark, tmp_path, history, stream_of(spark, tmp_path / "in", SCHEMA)) == [(1, "h"), (2, "h"), (5, "new")]


def test_empty_history(spark, tmp_path):
    spark.createDataFrame([(1, "live", at(1)), (1, "live", at(1))], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in/0"))
    assert replay(spark, tmp_path, spark.createDataFrame([], SCHEMA), stream_of(spark, tmp_path / "in", SCHEMA)) == [(1, "live")]


CHUNKS = "stream_id string, seq long, kind string, chunk string, ts timestamp"


@pytest.mark.parametrize("parts", [1, 4])
def test_live_assembly_equals_stored(spark, tmp_path, parts):
    rows = [("a", 0, "start", None), ("a", 2, "chunk", "y"), ("a", 3, "complete", None), ("a", 1, "chunk", "x"), ("a", 5, "chunk", "late"),
            ("b", 1, "chunk", "no"), ("b", 2, "complete", None), ("c", 3, "start", None), ("c", 1, "chunk", "before"), ("c", 4, "complete", None),
            ("d", 0, "start", None), ("d", 1, "chunk", "hole"), ("d", 3, "complete", None), ("e", 0, "start", None), ("e", 1, "chunk", "open"), ("e", 2, "chunk", None)]
    timed = [(*r, at(i)) for i, r in enumerate(rows)]
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(timed[i * step: (i + 1) * step], CHUNKS).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    marks = live.EndMarks(spark)
    stream = marks.add(stream_of(spark, tmp_path / "in", CHUNKS), stream_id="mark", seq=0, kind="start")
    out = [r for r in live.run_to_end(batches.assemble_streams_live(stream), "chunks", marks).collect() if r.stream_id != "mark"]
    good, errors = batching.assemble_streams(spark.createDataFrame(timed, CHUNKS))
    assert sorted((r.stream_id, r.text, r.chunks) for r in out if r.error is None) == sorted((r.stream_id, r.text, r.chunks) for r in good.collect())
    assert sorted((r.stream_id, r.seq, r.error) for r in out if r.error and r.seq is not None) == sorted((r.stream_id, r.seq, r.error) for r in errors.collect())
    assert [(r.stream_id, r.chunks) for r in out if r.error == "not completed"] == [("e", 2)]


def test_last_batches_come_out(spark, tmp_path):
    rows = [("r", 1, at(0), "agent"), ("r", 2, at(0.1), "agent"), ("s", 3, at(0.2), "human"), ("s", 4, at(0.3), "agent")]
    schema = "recipient string, id long, ts timestamp, sender string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in/0"))
    marks = live.EndMarks(spark)
    stream = marks.add(stream_of(spark, tmp_path / "in", schema), recipient="mark")
    out = live.run_to_end(batches.rolling_batches_live(stream, "recipient", "ts", "id", F.col("sender") == "human"), "tail", marks)
    assert sorted((r.key, tuple(r.ids)) for r in out.collect() if r.key != "mark") == [("r", ("1", "2")), ("s", ("3",)), ("s", ("4",))]


def test_chunks_reach_the_state_in_lists(spark, tmp_path):
    """A row per chunk would cost Python more than all else: rows of a stream next to each other are one row."""
    import pyarrow as pa

    rows = [("a", 0, "start", None, at(0)), ("a", 1, "chunk", "x", at(9)), ("b", 7, "chunk", "", None), ("a", 2, "complete", None, at(3)), (None, None, None, "z", at(1))]
    table = spark.createDataFrame(rows, CHUNKS).toArrow()
    packed = pa.Table.from_batches(batches._packed(iter(table.combine_chunks().to_batches()))).to_pylist()
    got = {r["stream_id"]: (r["seq"], r["kind"], r["chunk"], r["ts"] and r["ts"].replace(tzinfo=None)) for r in packed}
    assert got == {"a": ([0, 1, 2], ["start", "chunk", "complete"], [None, "x", None], at(9)), "b": ([7], ["chunk"], [""], None), None: ([None], [None], ["z"], at(1))}

    spark.createDataFrame([(f"s{i % 3}", i // 3, "start" if i < 3 else "chunk", "t", at(i)) for i in range(300)], CHUNKS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = batches.assemble_streams_live(spark.readStream.schema(CHUNKS).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("packed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert "MapInArrow" in query._jsq.explainInternal(False)
    assert sorted((r.stream_id, r.error, r.chunks) for r in spark.table("packed").collect()) == []
