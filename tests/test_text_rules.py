import itertools
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.operators import ballots, corpus, imports, pages, sections, similarity, spans, state, text_jobs
from threadloom.functions.html import read_page


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize("value, want", [
    ("Yea", "for"), ("Aye", "for"), ("Nay", "against"), ("No", "against"), ("Present", "abstained"), ("Not Voting", "abstained"),
    ("", "abstained"), (None, "abstained"), ("Unknown", "abstained"), ("Notable", "abstained")])
def test_ballots(spark, value, want):
    assert one(spark, value, ballots.ballot_class) == want


@pytest.mark.parametrize("value, want", [
    ("North Carolina", "NC"), ("north carolina", "NC"), ("nc", "NC"), ("", "--"), (None, "--"), ("Far Away", "AW"), ("Texas", "TX"), ("  ", "--")])
def test_states(spark, value, want):
    assert one(spark, value, ballots.state_code) == want


@pytest.mark.parametrize("kind, code", list(pages.ENTITY_CODES.items()))
def test_entity_codes(spark, kind, code):
    assert one(spark, f"https://x.example/bill/119/{kind}/498", pages.entity_code) == f"{code}498"
    assert one(spark, "https://x.example/other/498", pages.entity_code) is None


def test_dates(spark):
    assert str(one(spark, "on 01/16/2025 and January 3, 2024", tx.first_date)) == "2025-01-16"
    assert str(one(spark, "on January 3, 2024", tx.first_date)) == "2024-01-03"
    assert one(spark, "11/01/2025", lambda c: tx.month_label(tx.first_date(c))) == "Nov2025"
    assert one(spark, "99/99/2025", tx.first_date) is None


@pytest.mark.parametrize("value, kind, ident", [
    ("agent 12", "agent", "12"), ("meeting 7", "meeting", "7"), ("12", "agent", "12"), ("User", "agent", "human"), ("  ", "error", ""), ("agent ", "error", "agent")])
def test_ids(spark, value, kind, ident):
    got = one(spark, value, tx.parse_entity)
    assert (got.kind, got.id) == (kind, ident) or got.kind == kind == "error"


@pytest.mark.parametrize("size, want", [(0, "0.0 B"), (1023, "1023.0 B"), (1024, "1.0 KB"), (5 * 1024 ** 3, "5.0 GB"), (3 * 1024 ** 4, "3.0 TB")])
def test_bytes(spark, size, want):
    assert spark.range(1).select(tx.human_bytes(F.lit(size)).alias("x")).first().x == want


def test_words(spark):
    assert one(spark, "x" * 500, tx.preview) == "x" * 180 + " ... " + "x" * 180 + " (length: 500)"
    assert one(spark, "snake_case-name", tx.to_camel_case) == "SnakeCaseName"
    assert one(spark, "AlreadyCamel", tx.to_camel_case) == "AlreadyCamel"
    assert one(spark, "a\n\nb", lambda c: tx.indent(c, 2)) == "  a\n\n  b"
    assert one(spark, "abcdefghij", lambda c: tx.shorten(c, 8)) == "abcde..."
    assert one(spark, "#!/bin/x\nrest", tx.strip_shebang) == "rest"
    assert one(spark, "alpha beta gamma delta epsilon", lambda c: tx.shorten_words(c, 20)) == "alpha beta gamma..."


def test_sleep(spark):
    row = spark.createDataFrame([("10:30 PM", "06:30 AM")], "a string, b string")
    got = row.select(tx.minutes_in_bed(F.col("a"), F.col("b")).alias("m"), tx.sleep_efficiency(F.lit(480), F.lit(120)).alias("e")).first()
    assert (got.m, got.e) == (480, 75.0)


def test_similarity_of_two_texts(spark):
    df = spark.createDataFrame([("network effects matter", "network effects are important"), ("", "")], "a string, b string")
    got = df.select(similarity.jaccard(similarity.word_set(F.col("a")), similarity.word_set(F.col("b"))).alias("s")).collect()
    assert [r.s for r in got] == [0.4, 0.0]


@pytest.mark.parametrize("limit", [0.3, 0.6, 0.8, 1.0])
def test_similarity_join_equals_brute_force(spark, limit):
    rng = random.Random(7)
    vocabulary = [f"w{int(rng.expovariate(0.15))}" for _ in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 14))) for _ in range(120)]
    texts += texts[:20] + [t + " extra" for t in texts[20:40]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    pairs = {(r.id_a, r.id_b): r.similarity for r in similarity.jaccard_pairs(docs, limit).collect()}
    member = {r.doc_id: r.set_id for r in similarity.set_members(docs).collect()}
    sets = [set(t.split()) for t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        union = len(sets[i] | sets[j])
        both = len(sets[i] & sets[j])
        a, b = sorted((member[i], member[j]))
        if sets[i] == sets[j]:
            assert a == b
        else:
            assert ((a, b) in pairs) == (union > 0 and both * 1000 >= round(limit * 1000) * union)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), max_size=6), min_size=2, max_size=8))
def test_similarity_is_symmetric(spark, sets):
    words = [[f"w{i}" for i in sorted(s)] for s in sets]
    df = spark.createDataFrame([(words[0], words[1])], "a array<string>, b array<string>")
    r = df.select(similarity.jaccard(F.col("a"), F.col("b")).alias("x"), similarity.jaccard(F.col("b"), F.col("a")).alias("y")).first()
    assert r.x == r.y


def test_page_reader():
    html = """<html><head><title> A &amp; B </title><style>x</style></head><body><script>var t="</p>";</script><h1>Top</h1>
    <p>One <b>two</b><p>Three<!-- no --><table><tr><th>Representative</th><th>Party</th></tr><tr><td>R1</td><td>Dem</td></tr>
    <tr><td>only</td></tr></table><h2>Yeas</h2><ul><li>Ann</li><li>Bob</li></ul><h3>Not Voting</h3>Cy; Di,<br>Ed<h3>End</h3><a href="/x">go</a></body></html>"""
    page = read_page(html)
    assert page.title.strip() == "A & B"
    assert page.paragraphs[:2] == ["One two", "Three"] or page.paragraphs[0] == "One two"
    assert page.tables == [{"headers": ["Representative", "Party"], "rows": [["R1", "Dem"], ["only"]]}]
    assert [(g["heading"], g["items"]) for g in page.groups][:2] == [("Yeas", ["Ann", "Bob"]), ("Not Voting", ["Cy", "Di", "Ed"])]
    assert page.blocks[:2] == ["# Top", "One two"]


def test_page_rows(spark):
    html = "<table><tr><td>x</td></tr></table><table><tr><th>Representative</th><th>Party</th><th>State</th><th>Vote</th></tr><tr><td>A</td><td>D</td><td>Ohio</td><td>Nay</td></tr></table>"
    parsed = pages.parse_pages(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))
    row = pages.locate_member_rows(parsed).first()
    assert (row.representative, row.party, row.state, row.vote) == ("A", "D", "Ohio", "Nay")
    cells = [r.cells for r in pages.extract_tables(parsed).orderBy("table_no").collect()]
    assert cells == [{"0": "x"}, {"Representative": "A", "Party": "D", "State": "Ohio", "Vote": "Nay"}]


@pytest.mark.parametrize("base, href, want", [
    ("http://a.example/x/y?q=1", "/z", "http://a.example/z"), ("http://a.example/x/y", "z", "http://a.example/x/z"),
    ("http://a.example", "z", "http://a.example/z"), ("https://a.example/x", "//b.example/c", "https://b.example/c"),
    ("http://a.example/x?q=1", "?r=2", "http://a.example/x?r=2"), ("http://a.example/x#f", "#g", "http://a.example/x#g"),
    ("http://a.example/x", "mailto:me", "mailto:me")])
def test_links(spark, base, href, want):
    df = spark.createDataFrame([(base, href)], "b string, h string")
    assert df.select(pages.absolute_url(F.col("b"), F.col("h")).alias("x")).first().x == want


def test_redirect_links(spark):
    html = '<a href="/l/?kh=-1&amp;uddg=https%3A%2F%2Fb.example%2Fp">Go</a><a href="/l/?kh=1">none</a><a>no</a><a href="https://c.example/">  </a>'
    df = spark.createDataFrame([(1, "https://s.example/", html)], "page_id long, url string, html string")
    got = [(r.link_no, r.label, r.link) for r in pages.extract_links(df, redirect_prefix="/l/?kh=").orderBy("link_no").collect()]
    assert got == [(1, "Go", "https://b.example/p"), (2, "https://c.example/", "https://c.example/")]


def test_sections_to_the_end_of_the_text(spark):
    docs = spark.createDataFrame([(1, "# A\nx\n## B\ny\nz\n"), (2, "no heading"), (3, "")], "doc_id int, text string")
    got = [(r.start_line, r.end_line, r.level, r.title, r.section_size) for r in sections.section_ranges(docs).orderBy("start_line").collect()]
    assert got == [(1, 2, 1, "A", 2), (3, 5, 2, "B", 3)]


def test_blocks(spark):
    text = "# T #\npara one\npara two\n\n- a\n  more\n- b\n1. c\n> q\n> r\n```python\n# code\n\n```\n---\nend"
    got = [(r.line_no, r.type, r.level, r.text) for r in sections.markdown_blocks(
        spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("line_no").collect()]
    assert got == [
        (1, "heading", 1, "T"), (2, "paragraph", None, "para one\npara two"), (5, "item", None, "a\nmore"), (7, "item", None, "b"),
        (8, "item", None, "c"), (9, "quote", None, "q\nr"), (11, "code", None, "# code\n"), (15, "rule", None, "---"), (16, "paragraph", None, "end")]


def test_blocks_parent(spark):
    rows = [(1, 1, 2), (1, 2, None), (1, 3, 3), (1, 4, 2), (1, 5, 4), (1, 6, 1), (1, 7, 1)]
    out = sections.outline(spark.createDataFrame(rows, "doc_id int, line_no long, level long"))
    assert {r.line_no: r.parent_line for r in out.collect()} == {1: None, 2: 1, 3: 1, 4: None, 5: 4, 6: None, 7: None}


def test_front_matter(spark):
    docs = spark.createDataFrame([(1, "metadata:\n  a: 1\n  b: x y\n---\n body"), (2, " plain "), (3, "metadata:\n  a: 1"), (4, None)], "doc_id int, text string")
    got = {r.doc_id: (dict(r.metadata), r.description) for r in sections.front_matter(docs).collect()}
    assert got == {1: ({"a": "1", "b": "x y"}, "body"), 2: ({}, "plain"), 3: ({"a": "1"}, ""), 4: ({}, "")}


def test_templates(spark):
    t = spark.createDataFrame([(1, "a {$x}\n {$y}{$x}"), (2, "no {x}"), (3, "b\n c {$z}")], "template_id int, text string")
    p = spark.createDataFrame([("x", "1"), ("y", None)], "name string, value string")
    good, bad = text_jobs.fill_templates(t, p)
    assert {r.template_id: r.text for r in good.collect()} == {1: "a 1\n 1", 2: "no {x}"}
    assert [(r.template_id, r.name, r.line, r.column) for r in bad.collect()] == [(3, "z", 2, 4)]


def test_typed_parameters(spark):
    values = {"l": '[1, 2.5, "q\\"u", null, true]', "m": '{"b": {"c": []}, "a": "x y"}', "t": '"plain \\u00e9"', "n": "null", "b": "false", "i": "12", "d": "1.50", "e": "{}"}
    t = spark.createDataFrame([(1, "|".join("{$%s}" % k for k in values) + "|{$z}|"), (2, "{$gone}")], "template_id int, text string")
    p = spark.createDataFrame([*values.items(), ("z", None)], "name string, j string").selectExpr("name", "parse_json(j) AS value")
    good, bad = text_jobs.fill_templates(t, p)
    assert good.first().text == '[1,2.5,"q\\"u",null,true]|{"a":"x y","b":{"c":[]}}|plain é||False|12|1.5|{}||'
    assert [r.name for r in bad.collect()] == ["gone"]


def test_wanted_parts_of_pages(spark):
    """Each part alone is what the whole reading gives."""
    html = "<title>T</title><h2>Yea</h2><ul><li>A<li>B</ul><p>one<p>two <a href=/x>l</a><table><tr><th>H<tr><td>c</table>"
    page = spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id long, url string, html string")
    whole = {r.page_id: r for r in pages.parse_pages(page).collect()}
    for part in pages.PART_TYPES:
        assert {r.page_id: r[part] for r in pages.parse_pages(page, (part,)).collect()} == {k: r[part] for k, r in whole.items()}


def test_topics_and_adequacy(spark):
    docs = spark.createDataFrame([(1, "A border act", ""), (2, "x", "Healthcare cost"), (3, "nothing", ""), (4, "The commission sets a deadline", "")], "doc_id int, text string, title string")
    got = {r.doc_id: r.topic for r in text_jobs.label_topics(docs, title="title").collect()}
    assert got == {1: "immigration", 2: "health costs", 3: "general", 4: "agency process"}
    d = spark.createDataFrame([("short",), ("Doe, Jane [R-TX]",), ("This bill changes much",)], "description string")
    assert [r.ok for r in d.select(text_jobs.is_adequate().alias("ok")).collect()] == [False, False, True]


def test_describe(spark):
    docs = spark.createDataFrame([
        (1, "Skip to main content. It is big. It prohibits sales. It requires care! More bans?", "T"), (2, "Hello. This bill is new. End.", "T"),
        (3, "Just words. More words. Third.", "T"), (4, "", " ".join(["w"] * 30)), (5, "Contact us.", "Short title")], "doc_id int, text string, title string")
    got = {r.doc_id: r.description for r in text_jobs.describe(docs, title="title").collect()}
    assert got[1] == "It prohibits sales. It requires care!"
    assert got[2] == "This bill is new."
    assert got[3] == "Just words. More words."
    assert got[4] == " ".join(["w"] * 28) + "..." and got[5] == "Short title"


def test_replace(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "a"), (3, "z")], "doc_id int, text string")
    good, bad = corpus.replace_text(docs, "a", "c")
    assert [(r.doc_id, r.text, r.occurrences) for r in good.collect()] == [(2, "c", 1)]
    assert {(r.doc_id, r.error) for r in bad.collect()} == {(1, "ambiguous"), (3, "not found")}


def test_concepts(spark):
    docs = spark.createDataFrame([(1, "Network Effects and Emergence are key. Patterns like emergence, (Feedback) and The NETWORK EFFECTS")], "doc_id int, text string")
    got = [r.concept for r in corpus.extract_concepts(docs).orderBy("pos").collect()]
    assert got == ["Network Effects", "Effects", "Emergence", "The", "NETWORK"]


def test_import_errors(spark):
    def closure(pairs, depth=10):
        edges = spark.createDataFrame(pairs, "path string, imported string")
        good, bad = imports.import_closure(edges, depth)
        return {(r.path, r.imported): r.depth for r in good.collect()}, {(r.path, r.error) for r in bad.collect()}

    good, bad = closure([("a", "b"), ("b", "c"), ("a", "c")])
    assert good == {("a", "b"): 1, ("b", "c"): 1, ("a", "c"): 1} and not bad
    _, bad = closure([("a", "b"), ("b", "c"), ("c", "b")])
    assert bad == {("a", "cycle"), ("b", "cycle"), ("c", "cycle")}
    _, bad = closure([(f"f{i}", f"f{i + 1}") for i in range(12)])
    assert bad == {("f0", "too deep"), ("f1", "too deep")}


def test_inline(spark):
    files = spark.createDataFrame([
        ("d/a.md", "top\n  !import b.md # why\nend"), ("d/b.md", "b1\n\n !import ../c.md"), ("c.md", "c1\nc2"), ("x.md", "!import nope.md")], "path string, text string")
    edges, missing = imports.resolve_import_edges(imports.import_refs(files), files)
    assert [(r.path, r.line_no, r.target) for r in missing.collect()] == [("x.md", 1, "nope.md")]
    got = {r.path: r.text for r in imports.inline_imports(files, edges).collect()}
    assert got["d/a.md"] == "top\n  b1\n\n   c1\n   c2\nend"


def test_span_tree_reports_cycles(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5), (7, 5)] + [(100 + i, 99 + i if i else 3) for i in range(40)]
    got = {r.span_id: (r.root_id, r.depth) for r in spans.span_tree(spark.createDataFrame(rows, "span_id int, parent_id int")).collect()}
    assert got[3] == (1, 2) and got[4] == (4, 0) and got[5] == got[6] == got[7] == (None, None)
    assert got[139] == (1, 42) and len(got) == len(rows)


def test_state(spark):
    snap = spark.createDataFrame([
        ("s", 1, "a", "1"), ("s", 1, "b", "2"), ("s", 1, "_p", "3"), ("s", 2, "a", None), ("s", 2, "c", "4"), ("s", 2, "_p", "9"), ("s", 4, "b", "2"), ("s", 4, "c", "4")],
        "session_id string, step int, name string, value string")
    got = {(r.step, r.name, r.change) for r in state.snapshot_diffs(snap).collect()}
    assert got == {(1, "a", "new"), (1, "b", "new"), (2, "a", "changed"), (2, "b", "deleted"), (2, "c", "new"), (4, "a", "deleted"), (4, "b", "new")}
    assert {(r.step, r.name) for r in state.state_changes(snap).collect()} == {(2, "a"), (2, "c"), (4, "b")}


def test_jaccard_pairs_counts_only_early_matches(spark, tmp_path):
    """Random sets of mixed sizes against all pairs, and no count for a pair whose first shared word comes too late."""
    import random

    rnd = random.Random(5)
    rows = []
    for i in range(150):
        base = [f"w{int(rnd.paretovariate(0.6)) % 60}" for _ in range(rnd.randint(1, 40))]
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(base[: 1 + len(base) * 2 // 3] + [f"x{i}"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for key, text in rows:
        sets.setdefault(frozenset(text.split()), key)
    for limit in (0.3, 0.5, 0.9, 1.0):
        want = set()
        for a, i in sets.items():
            for b, j in sets.items():
                if i < j and len(a & b) * 1000 >= round(limit * 1000) * len(a | b):
                    want.add((i, j))
        found = similarity.jaccard_pairs(docs, limit)
        assert {(r.id_a, r.id_b) for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "least(la" in plan


def test_jaccard_pairs_in_slices(spark, monkeypatch):
    """A larger table is worked off in slices with bounded matches and carried words, and gives the same pairs."""
    rnd = random.Random(11)
    rows = [(i, " ".join(f"w{int(rnd.paretovariate(0.6)) % 40}" for _ in range(rnd.randint(1, 25)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {tuple(r) for r in similarity.jaccard_pairs(docs, 0.5).collect()}
    written, write = [], similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df, label: written.append(label) or write(df, label))
    monkeypatch.setattr(similarity, "WHOLE", 100)
    assert {tuple(r) for r in similarity.jaccard_pairs(docs, 0.5).collect()} == whole and whole
    assert written.count("prefix") == similarity.SLICES and written.count("candidates") >= similarity.SLICES and written.count("pairs") > 1
