"""Nulls, empty and very long texts, repeated rows, clashing columns and empty tables, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import (
    context_tree, decontaminate, fingerprints, jaccard_join, language, licenses, line_dedup, packing, suffixes, urls,
)

LONG = " ".join(f"word{i % 977} and{i % 53}" for i in range(30_000))
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, key string, hash int, held_out int, kind string, "
    "tokens string, node string, rep long, n string, token string, component int, words string, run int, value string, block string, spans int"
)
TEXTS = [(1, "one two three four five six"), (2, None), (3, ""), (4, LONG), (5, "one two three four five six"), (5, "one two three four five six"),
         (None, "no id at all here"), (6, "   \n\t\n "), (7, "!!! ???"), (8, "x" * 20_000), (9, None)]


def rows_of(texts):
    return [(d, t, None if d == 2 else "en", "s", 0, 0.5, "k", 1, 1, "k", "t", "n", 1, "n", "t", 1, "w", 1, "v", "b", 1) for d, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(TEXTS), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "two three four five six"), (2, None), (3, ""), (4, "no id"), (4, "no id")], "item_id long, text string")


def test_packing(docs):
    got = packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got}[2] == 1 and len(got) == 10


def test_context_tree(docs, none):
    got = {r.doc_id: r for r in context_tree.score(docs, F.col("doc_id") == 4).collect()}
    assert got[2].n_tokens == got[3].n_tokens == got[6].n_tokens == 1
    assert got[4].held_out and got[4].n_tokens == 60_001 and got[4].score < 0
    assert got[1].score == got[5].score
    assert context_tree.score(none, F.lit(False)).count() == 0
    alone = context_tree.score(docs, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in alone) and len(alone) == len(TEXTS)


def test_fingerprints(docs, none):
    got = fingerprints.edited_fingerprints(docs).collect()
    assert len(got) == 10  # the repeated row is one document
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].fp == by_id[5].fp and by_id[2].fp == [] and by_id[8].fp == by_id[8].fp[:1]
    assert by_id[1].edited == "one two three " + "no id at all here"[:13]  # the smallest id is followed by the null id
    assert by_id[None].edited == "no id at " + ""  # and that by the largest, an empty text
    assert fingerprints.edited_fingerprints(none).count() == 0
    alone = fingerprints.edited_fingerprints(docs.filter("doc_id = 1")).first()
    assert alone.edited == "one two three " + "one two three"


def test_suffixes(docs, none):
    got = suffixes.remove_repeated(docs).collect()
    assert len(got) == len(TEXTS)
    by_id = {r.doc_id: r for r in got}
    assert (by_id[2].n_bytes, by_id[2].kept) == (0, b"")
    assert (by_id[8].n_bytes, by_id[8].n_removed, by_id[8].n_spans, bytes(by_id[8].kept)) == (20_000, 19_999, 1, b"x")
    assert by_id[None].n_removed == 0
    assert suffixes.remove_repeated(none).count() == 0


def test_suffixes_of_repeated_rows(spark):
    """Rows of one doc_id and text are one document, in one task or several: its first bytes stay in every copy."""
    passage = "".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(6))
    rows = [(1, "left " + passage + " a"), (1, "left " + passage + " a"), (2, "right " + passage + " b"), (2, "right " + passage + " b"), (None, passage[:150]), (None, passage[:150])]
    for parts in (1, 6):
        got = suffixes.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (0, 0), (1, 150), (1, 150), (2, 387), (2, 387)]


def test_urls(spark):
    rows = [(1, "https://WWW.Example.net/en/x?q", "<title>Good words</title>"), (2, None, None), (3, "no scheme", ""), (4, "http://a.example.com/de/1", None),
            (4, "http://a.example.com/de/1", None), (5, "://", ""), (6, "http://goodwords.org/fr/?a://b", "x" * 100_000), (7, "http://" + "k" * 500 + "/", "")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("row", F.lit("x"))).collect()
    assert len(got) == 8
    by_id = {r.page_id: r for r in got}
    assert (by_id[1].host, by_id[1].path, by_id[1].rule, by_id[1].verdict) == ("www.example.net", "/en/x", "example.net/en/", "allow")
    assert (by_id[2].host, by_id[2].path, by_id[2].rule) == ("", "", None) == (by_id[3].host, by_id[3].path, by_id[3].rule)
    assert by_id[4].verdict == "block" and by_id[6].rule == "org/fr/" and by_id[7].verdict in ("allow", "block")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_licenses(spark, docs, none):
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, None), (3, ""), (4, "All rights\nreserved.\n\nother text here"), (4, "Released under the MIT license"), (5, LONG)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.unit, r.place, r.license) for r in got) == [
        (1, "line", 1, "MIT"), (1, "paragraph", 0, "MIT"), (4, "line", 0, "MIT"), (4, "paragraph", 0, "proprietary")]
    assert licenses.scan(none).count() == 0 and licenses.scan(docs, []).count() == 0


def test_decontaminate(docs, none, items):
    got = decontaminate.contaminated(docs, items).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.covered) for r in got) == [(0, 4, 2), (1, 1, 5), (5, 1, 5)]
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, items).count() == len(TEXTS) - 4


def test_language(docs, none):
    model = language.fit(docs, F.lit(True))
    got = language.predict(docs, model).collect()
    assert len(got) == len(TEXTS)
    assert all((r.lang_pred == "und") == (r.doc_id in (2, 3, 6, 7, 9)) and 0 <= r.score <= 1 for r in got)
    assert language.predict(none, language.fit(none, F.lit(True))).count() == 0
    assert {r.lang_pred for r in language.predict(docs, language.fit(none, F.lit(True))).collect()} == {"und"}
    assert language.keep_known_languages(docs, model).columns == docs.columns


def test_lines(docs, none):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    # id 5 repeats the line of 1; texts without lines stay
    assert got[1] == TEXTS[0][1] and 5 not in got and got[2] is None and got[3] == "" and got[6] == "   \n\t\n " and got[None] == "no id at all here"
    assert line_dedup.dedup_lines(none).count() == 0


def test_jaccard(docs, none):
    got = jaccard_join.link_components(docs).collect()
    assert len(got) == len(TEXTS)
    by_id = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert by_id[1] == (4, 1) and by_id[5] == (4, 1) and by_id[2] == (0, 2) and by_id[None] == (3, None) and by_id[8] == (1, 8)
    assert jaccard_join.link_components(none).count() == 0
    assert jaccard_join.keep_one(docs).columns == docs.columns


def test_pipeline_stages(spark, docs, none, items, tmp_path):
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns or name == "packing"
        assert stage(spark, none, str(tmp_path)).count() == 0
    docs.filter("doc_id < 8").write.parquet(str(tmp_path / "documents.parquet"))
    # 2, 3, 6, 7 have no letters, 5 repeats 1, and 1 holds an item
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {4}
