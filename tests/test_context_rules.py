from pyspark.sql import functions as F

from threadloom.operators import context


def turns(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "conv_id int, turn int, role string, text string, marked boolean")


def test_last_assistant_turns_and_last_user_turn_stay_full(spark):
    rows = [("user" if i % 2 == 0 else "assistant", f"line{i}\nsecond\nthird", False) for i in range(9)]
    out = {r.turn: r for r in context.compact_history(turns(spark, rows), 2).collect()}
    assert sorted(t for t, r in out.items() if r.is_full) == [5, 7, 8]
    assert out[0].text == "line0" and out[1].text == "line1\nsecond"


def test_keep_zero_keeps_all_assistant_turns(spark):
    rows = [("assistant", "a\nb\nc", False)] * 3
    assert all(r.is_full for r in context.compact_history(turns(spark, rows), 0).collect())


def test_instruction_column_and_code_fence(spark):
    df = turns(spark, [("user", "long", False), ("assistant", "```python\nhype\ntwo\nthree\n```", False), ("user", "x", False), ("assistant", "y", False)])
    df = df.withColumn("instruction", F.lit("do it"))
    out = {r.turn: r.text for r in context.compact_history(df, 1, instruction="instruction").collect()}
    assert out[0] == "do it" and out[1] == "hype\ntwo" and out[2] == "x"


def merged(spark, rows):
    return [(r.role, r.text, r.marked) for r in context.merge_runs(turns(spark, rows)).orderBy("turn").collect()]


def test_runs_merge_by_role(spark):
    assert merged(spark, [("user", "a", False), ("user", "b", False), ("assistant", "c", False)]) == [
        ("user", "a\n\nb", False), ("assistant", "c", False)]


def test_first_marked_turn_closes_its_run(spark):
    assert merged(spark, [("system", "a", True), ("system", "b", False)]) == [("system", "a", True), ("system", "b", False)]


def test_marked_turn_that_opens_a_run_does_not_close_it(spark):
    assert merged(spark, [("user", "a", False), ("assistant", "b", True), ("assistant", "c", False)]) == [
        ("user", "a", False), ("assistant", "b\n\nc", True)]


def test_marked_turn_in_the_middle_closes(spark):
    rows = [("user", "a", False), ("user", "b", True), ("user", "c", False), ("user", "d", True), ("user", "e", True)]
    assert merged(spark, rows) == [("user", "a\n\nb", True), ("user", "c\n\nd", True), ("user", "e", True)]


def test_markers(spark):
    rows = [("system", "s", True)] + [("user", str(i), True) for i in range(4)] + [("user", "x", False)]
    kept = {r.turn for r in context.cap_markers(turns(spark, rows), 3).collect() if r.marked}
    assert kept == {0, 2, 3, 4}


def test_blank_turns(spark):
    df = turns(spark, [("user", " \n\t ", False), ("user", "  ", False), ("user", " a ", False)])
    assert [r.turn for r in context.drop_blank(df).collect()] == [2]


def test_tokens(spark):
    df = turns(spark, [("user", "one two", False), ("assistant", "three", False)]).withColumn("name", F.when(F.col("turn") == 0, "n"))
    assert context.conversation_tokens(df, name="name").first().tokens == 3 + 8 + 1 + 2


def test_conversation_rules(spark):
    df = turns(spark, [("user", "a", False), ("system", "b", False), ("assistant", "c", False)])
    found = {(r.rule, r.turn) for r in context.check_conversations(df).collect()}
    assert found == {("first turn is not system", 0), ("system turn after the first", 1), ("last turn is assistant", 2)}
    assert context.valid_conversations(df).count() == 0
