"""Members, observers and cursors grow with the channels: no join sends them through the driver."""

from threadloom.operators import messages


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_deliveries_merge_their_members(spark, tmp_path):
    def stored(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    sent = stored("sent", [(1, 0, "a", "b"), (1, 1, "b", None)], "channel_id int, seq int, sender string, recipient string")
    members = stored("members", [(1, "a"), (1, "b")], "channel_id int, participant_id string")
    observers = stored("observers", [(1, "all", None), (1, "of_a", "a")], "channel_id int, observer_id string, target string")
    out = messages.fan_out(sent.drop("recipient"), members)
    seen = messages.notify_observers(sent, observers)
    for df in (out, seen, *messages.reject_non_members(sent, members)):
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)
    assert sorted((r.seq, r.recipient) for r in out.collect()) == [(0, "b"), (1, "a")]
    assert sorted((r.seq, r.observer_id) for r in seen.collect()) == [(0, "all"), (1, "all"), (1, "of_a")]
