"""Links and records as they are found: long tags, quotes without end, record files of any form."""

import json

from threadloom.operators import pages
from threadloom.sources import records


def links(spark, *htmls):
    df = spark.createDataFrame([(i, "https://h.example/p/q/r", h) for i, h in enumerate(htmls)], "page_id int, url string, html string")
    return [(r.page_id, r.label, r.link) for r in pages.extract_links(df).orderBy("page_id", "link_no").collect()]


def test_tags_of_any_length(spark):
    big = 1_000_000
    assert links(
        spark, '<a title="' + "y" * big + '" href="/a">1</a>', "<a " + "x" * big + " href=/b>2</a>", "<a " + 'k="v" ' * 200_000 + " href=/c>3</a>",
        "<a " + "'" * 100_001 + " href=/d>4</a>", "<a " + '="' * 50_001 + " href=/e>5</a>", "<a href=/" + "f" * big + ">6</a>",
    ) == [(i, str(i + 1), f"https://h.example/{x}") for i, x in enumerate(["a", "b", "c", "d", "e", "f" * big])]


def test_quotes_without_end(spark):
    root = "https://h.example"
    assert links(
        spark, '<a href="one>1</a><a href="two">2</a><a href=three>3</a>', "<a title=don't href=/x>it's</a> <a href=/y>y</a>",
        '<a href="open>1</a> <a href=/z>2</a>', "<A HREF='/q\"u'>a<b title=\">\">b</b></A>",
    ) == [(0, "2", root + "/p/q/one>1</a><a href="), (0, "3", root + "/p/q/three"), (1, "it's", root + "/x"), (1, "y", root + "/y"),
          (2, "1", root + '/p/q/"open'), (2, "2", root + "/z"), (3, "a b", root + '/q"u')]


def test_glued_and_other_attributes(spark):
    root = "https://h.example"
    assert links(spark, '<abc href="/no">n</abc><a>none</a><a/href=/s>s</a><a class="x"href="/g">g</a><a href = "/sp">sp</a><a hrefx=/n>n</a><a href="">e</a>') == [
        (0, "s", root + "/s"), (0, "g", root + "/g"), (0, "sp", root + "/sp")]


RECORD = {"bill_title": "t", "date_of_vote": "1/2/2025", "brief_summary": "a\nb {", "pros": ["p", "{"], "cons": None}


def read(spark, root, **more):
    got = records.read_records(spark, str(root), records.ANALYSIS_SCHEMA, **more).collect()
    return sorted((r.path.rsplit("/", 1)[1], r.bill_title or "", tuple(r.pros or ()), r.error is not None) for r in got)


def test_forms_of_record_files(spark, tmp_path):
    other = RECORD | {"bill_title": "u"}
    files = {
        "indented.json": json.dumps(RECORD, indent=2), "flat.json": json.dumps(RECORD), "lines.json": "\n".join(map(json.dumps, (RECORD, other))) + "\n\n",
        "array.json": json.dumps([RECORD, other], indent=4), "short.json": json.dumps([RECORD]), "none.json": "", "blank.json": " \n\n", "no_records.json": "[]",
        "cut.json": json.dumps(RECORD, indent=2)[:-3], "cut_array.json": json.dumps([RECORD], indent=2)[:-3], "mixed.json": "{oops\n" + json.dumps(RECORD) + "\n17\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    good = lambda name, title="t": (name, title, ("p", "{"), False)
    bad = lambda name: (name, "", (), True)
    want = [good("indented.json"), good("flat.json"), good("lines.json"), good("lines.json", "u"), good("array.json"), good("array.json", "u"), good("short.json"),
            bad("cut.json"), bad("cut_array.json"), bad("mixed.json"), bad("mixed.json"), good("mixed.json")]
    assert read(spark, tmp_path) == sorted(want)


def test_large_files_are_read_by_line(spark, tmp_path):
    (tmp_path / "lines.json").write_text((json.dumps(RECORD) + "\n") * 50 + "x\n")
    (tmp_path / "small.json").write_text(json.dumps(RECORD, indent=2))
    got = read(spark, tmp_path, whole_file_bytes=1000)
    assert len(got) == 52 and [g for g in got if g[3]] == [("lines.json", "", (), True)]
