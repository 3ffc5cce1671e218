"""Inputs on which rows or values must not get lost."""

import hashlib

from pyspark.sql import functions as F

from threadloom.operators import batching, events, imports, messages, pages, sections, state, text_jobs
from threadloom.sources import records
from threadloom.streaming import live


def test_imports_of_any_depth_and_cycles(spark):
    files = [(f"f{i}", f"line {i}\n!import f{i + 1}") for i in range(16)] + [("f16", "end"), ("a", "!import b"), ("b", "!import a"), ("c", "x\n!import a")]
    frame = spark.createDataFrame(files, "path string, text string")
    edges, _ = imports.resolve_import_edges(imports.import_refs(frame), frame)
    got = {r.path: r.text for r in imports.inline_imports(frame, edges).collect()}
    assert got["f0"].split("\n") == [f"line {i}" for i in range(16)] + ["end"]
    assert not {"a", "b", "c"} & set(got)
    _, errors = imports.import_closure(edges)
    kinds = {(r.path, r.error) for r in errors.collect()}
    assert ("f0", "too deep") in kinds and ("c", "cycle") in kinds
    assert imports.oversize_imports(edges, frame, 12).filter("path = 'f0'").count() == 1


def test_artifacts_are_keyed_by_the_full_hash(spark):
    df = spark.createDataFrame([(1, "x" * 600), (2, "y" * 600), (3, "x" * 600), (4, "short")], "id int, v string")
    main, side = state.offload_large(df, "v")
    assert {r.content_hash for r in side.collect()} == {hashlib.sha256((c * 600).encode()).hexdigest() for c in "xy"}
    assert main.join(side, "content_hash").count() == 3


def test_stream_with_an_early_end(spark):
    rows = [("s", 0, "complete", None), ("s", 1, "start", None), ("s", 2, "chunk", "a"), ("s", 3, "complete", None), ("s", 4, "chunk", "b")]
    got, errors = batching.assemble_streams(spark.createDataFrame(rows, "stream_id string, seq long, kind string, chunk string"))
    assert [tuple(r) for r in got.collect()] == [("s", "a", 1)]
    assert sorted((r.seq, r.error) for r in errors.collect()) == [(0, "no start"), (4, "already completed")]


def test_settings_replace_subtrees(spark):
    rows = [("low", 1, "a.b", "1"), ("low", 1, "a.c", "2"), ("high", 2, "a", "9"), ("low", 1, "x", "3"), ("high", 2, "x.y", "4"), ("low", 1, "k.l", "5"), ("high", 2, "k.m", "6")]
    got = state.effective_settings(spark.createDataFrame(rows, "layer string, precedence int, key_path string, value string"))
    assert {r.key_path: r.value for r in got.collect()} == {"a": "9", "x.y": "4", "k.l": "5", "k.m": "6"}


def test_repeated_keys(spark):
    doc = spark.createDataFrame([(1, "metadata:\n  a: 1\n  b: 2\n  a: 3\n---\nrest")], "doc_id int, text string")
    assert sections.front_matter(doc).first().metadata == {"a": "3", "b": "2"}
    templates = spark.createDataFrame([(1, "{$a} {$b}"), (2, "{$b}")], "template_id int, text string")
    filled, errors = text_jobs.fill_templates(templates, spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "name string, value string"))
    assert [tuple(r) for r in filled.collect()] == [(2, "3")] and [(r.template_id, r.name) for r in errors.collect()] == [(1, "a")]


def test_latest_cached_response(spark):
    requests = spark.createDataFrame([("q",)], "text string").select("text")
    key = requests.select(messages.request_key(["text"]).alias("k")).first().k
    cache = spark.createDataFrame([(key, "old", 1), (key, "new", 2)], "cache_key string, response string, ts int")
    assert messages.lookup_cached(requests, cache, ["text"])[0].first().response == "new"


def test_attendee_who_never_answers(spark):
    rows = spark.sql("SELECT 1 AS meeting_id, 1 AS agent_id, 'required' AS role, 'pending' AS status, timestamp'2024-01-01 00:00:00' AS created_at, CAST(NULL AS timestamp) AS resolved_at")
    assert events.attendance_status(rows).first().status == "pending"
    assert events.attendance_status(rows, as_of=F.lit("2024-01-01 00:05:00").cast("timestamp")).first().status == "timeout"


def test_many_records_in_one_file(spark, tmp_path):
    rows = [(f"t{i}", "1/2/2025", f"s{i}", ["p"], None, "Jan2025", "HR1") for i in range(4)]
    frame = spark.createDataFrame(rows, "bill_title string, date_of_vote string, brief_summary string, pros array<string>, cons array<string>, month string, entity string")
    records.write_partitioned(frame.coalesce(1), str(tmp_path), fmt="json")
    got = records.read_records(spark, str(tmp_path), records.ANALYSIS_SCHEMA).collect()
    assert sorted((r.bill_title, r.month, r.entity) for r in got) == [(f"t{i}", "Jan2025", "HR1") for i in range(4)]


def test_links_as_a_browser_reads_them(spark):
    html = '<a data-href="/wrong" href="../x y">one</a> <a class=b href=c/./d?q=../e>two <a href="/a/../../f/.">three</a><a name="n">none</a>'
    got = pages.extract_links(spark.createDataFrame([(1, "https://h.example/p/q/r", html)], "page_id int, url string, html string"))
    assert [(r.label, r.link) for r in got.orderBy("link_no").collect()] == [
        ("one", "https://h.example/p/x y"), ("two", "https://h.example/p/q/c/d?q=../e"), ("three", "https://h.example/f/")]


def test_inlined_texts_keep_order_blanks_and_shared_imports(spark):
    rows = [
        ("a", "!import c\nmid\n  !import d\n\t!import c"), ("b", "  !import a\n\nlast"), ("c", "c1\n   \nc2"), ("d", "!import c"),
        ("n", None), ("only", "!import n"), ("with", "x\n!import n"), ("big", "y" * 50 + "\n!import c"), ("gone", "!import nowhere")]
    frame = spark.createDataFrame(rows, "path string, text string")
    edges, _ = imports.resolve_import_edges(imports.import_refs(frame), frame)
    want = {
        "a": "c1\n   \nc2\nmid\n  c1\n   \n  c2\n\tc1\n   \n\tc2", "c": "c1\n   \nc2", "d": "c1\n   \nc2", "with": "x",
        "b": "  c1\n   \n  c2\n  mid\n    c1\n   \n    c2\n  \tc1\n   \n  \tc2\n\nlast", "big": "y" * 50 + "\nc1\n   \nc2", "gone": "!import nowhere"}
    for group_bytes in (0, 20, 1000):  # groups of one file, of some, of all
        assert {r.path: r.text for r in imports.inline_imports(frame, edges, group_bytes).collect()} == want
