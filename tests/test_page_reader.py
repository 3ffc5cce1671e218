"""Pages of bare tags without the full parser, and how many rows a Python function gets at once."""

import random

import pytest

from threadloom.functions import html as reader
from threadloom.operators import pages

PAGE = "<html><title>A &amp; B</title><table><tr><th>x</th></tr><tr><td>1 &lt; 2</td></tr></table><h3>Yeas</h3><ul><li>C</li></ul></html>"


def test_bare_pages_do_not_reach_the_parser(monkeypatch):
    def refuse(self, data):
        raise AssertionError("parsed in full")

    monkeypatch.setattr(reader.PageReader, "feed", refuse)
    page = reader.read_page(PAGE, ("title", "tables", "groups"))
    assert (page.title, page.tables, page.groups) == (
        "A & B", [{"headers": ["x"], "rows": [["1 < 2"]]}], [{"heading": "Yeas", "items": ["C"]}])
    with pytest.raises(AssertionError):
        reader.read_page("<table><tr><td class='a'>1</td></tr></table>", ("tables",))


def test_bare_pages_equal_the_parser():
    rnd = random.Random(3)
    tags = "p td tr table th ul ol li h2 h3 title a template noscript div br".split()
    bits = [" ", "a &amp; b", "x", "\n", ";", "&lt", "&", "é", "1 < 2", "<td >", "<br/>", "<!-- c -->", "<script>", "<p class='x'>"]
    for _ in range(4000):
        text = "".join(
            rnd.choice([f"<{rnd.choice(tags)}>", f"</{rnd.choice(tags)}>", rnd.choice(bits if rnd.random() < 0.1 else bits[:8])])
            for _ in range(rnd.randint(0, 25)))
        full = reader.PageReader()
        full.feed(text)
        full.close()
        quick = reader.read_page(text)
        for part in ("title", "texts", "paragraphs", "tables", "groups", "blocks"):
            assert getattr(quick, part) == getattr(full, part), text


def test_python_gets_few_pages_at_once(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    many = spark.range(3000, numPartitions=1).selectExpr("id as page_id", "'u' as url", f"'{PAGE}' as html")
    parsed = pages.parse_pages(many, ("title",))
    assert parsed.filter("title = 'A & B'").count() == 3000
    sizes = many.mapInPandas(lambda batches: (b[["page_id"]].iloc[:1] * 0 + len(b) for b in batches), "page_id long")
    assert max(r.page_id for r in sizes.collect()) <= 1000
