"""Queries whose texts and pages are derived from the tables: imports, outlines, dates, templates, tables of pages."""

from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions.registry import registry
from threadloom.operators import ballots, context, corpus, imports, pages, schema_tools, sections, steps, text_jobs
from threadloom.sources.tables import event_log_from_table, event_payload, read_table


def _typed_events(s, d):
    e = event_payload(event_log_from_table(read_table(s, d, "events")), "k bigint")
    return e.select(
        "event_id",
        F.struct(
            F.col("event_id").alias("id"), F.col("agent_id").alias("name"), F.col("value").alias("latency"),
            F.array(F.struct(F.col("fields.k").alias("k"), F.col("value").alias("latency"), F.col("event_type").alias("name"))).alias("children"),
        ).alias("span"),
    )


def _keep_fields(s, d):
    kept = schema_tools.keep_fields(_typed_events(s, d), ["event_id", "span", "name", "k"])
    return kept.select("event_id", F.to_json("span").alias("span"))


def _drop_volatile(s, d):
    kept = schema_tools.drop_volatile(_typed_events(s, d))
    return kept.select("event_id", F.to_json("span").alias("span"))


def file_graph(s, d):
    """Every document is a file that imports the file of half its number, some name a file that is not there."""
    doc = read_table(s, d, "documents").select("doc_id", "text")
    half = F.floor(F.col("doc_id") / 2).cast("string")
    directive = (
        F.when(F.col("doc_id") == 0, F.lit("start"))
        .when(F.col("doc_id") % 10 == 7, F.lit("!import missing.md # later"))
        .otherwise(F.concat(F.lit("  !import f"), half, F.lit(".md")))
    )
    return doc.select(
        F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat_ws("\n", directive, "text").alias("text")
    )


def _edges(s, d, side):
    files = file_graph(s, d)
    return imports.resolve_import_edges(imports.import_refs(files), files)[side]


def _inline(s, d):
    files = file_graph(s, d)
    return imports.inline_imports(files, _edges(s, d, 0))


def _dense_steps(s, d):
    """Each line of an order is a step; the first line number of an order is the parent of the later ones."""
    l = read_table(s, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    no = F.when(F.col("l_linenumber") <= 2, F.lpad(F.col("l_linenumber").cast("string"), 2, "0")).otherwise(
        F.concat(F.lit("01."), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"))
    )
    return steps.dense_steps(l.select(F.col("l_orderkey").alias("doc_id"), no.alias("step_no")))


def dated(s, d):
    o = read_table(s, d, "orders")
    day = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("Passed on "), F.date_format(day, "MM/dd/yyyy"), F.lit(". Later 01/02/2003.")))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("On "), F.date_format(day, "MMMM d, yyyy"), F.lit(" it passed")))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("Seen 13/45/2001 or "), F.date_format(day, "MMMM d yyyy")))
        .otherwise(F.lit("no date"))
    )
    return o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


def _find_dates(s, d):
    return text_jobs.find_dates(dated(s, d)).select("doc_id", F.col("found_date").cast("string").alias("found_date"), "month")


def _entity_codes(s, d):
    kinds = list(pages.ENTITY_CODES) + ["house-report"]
    o = read_table(s, d, "orders")
    kind = F.array(*[F.lit(k) for k in kinds])[(F.col("o_custkey") % len(kinds)).cast("int")]
    url = F.concat(F.lit("https://records.example/bill/119/"), kind, F.lit("/"), F.col("o_orderkey").cast("string"), F.lit("?x=1"))
    return o.select("o_orderkey", pages.entity_code(url).alias("code"), tx.month_label(F.col("o_orderdate")).alias("month"), tx.safe_name(url).alias("file_name"))


def vote_pages(s, d):
    """One result page per order: stated totals, a table of members and grouped name lists."""
    o, c, n = (read_table(s, d, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    vote = F.when(F.col("o_orderstatus") == "F", "Yea").when(F.col("o_orderstatus") == "O", "Nay").otherwise("Not Voting")
    cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    header = F.when(F.col("o_orderkey") % 5 == 0, F.lit("")).otherwise(F.lit("<tr><th>Representative</th><th>Party</th><th>State</th><th>Vote</th></tr>"))
    html = F.concat(
        F.lit("<html><head><title>Vote &amp; "), F.col("o_orderkey").cast("string"), F.lit("</title></head><body><p>Yea: "),
        F.when(F.col("o_orderstatus") == "F", "1").otherwise("0"), F.lit(" and Nay: 0</p><table><tr><td>other</td></tr></table><table>"), header,
        F.lit("<tr>"), cell(F.col("c_name")), cell(F.col("c_mktsegment")), cell(F.col("n_name")), cell(vote), F.lit("</tr></table><h3>"), vote,
        F.lit("s</h3><ul><li>"), F.col("c_name"), F.lit("</li><li> Second "), F.col("c_mktsegment"), F.lit("</li></ul><h3>Present</h3>A; B, C</body></html>"),
    )
    made = j.select(F.col("o_orderkey").alias("page_id"), F.lit("https://votes.example/").alias("url"), html.alias("html"))
    # stored pages come in many splits; these are made from one small file, so they are spread by hand
    return made.repartition(s.sparkContext.defaultParallelism, "page_id")


def _extract_tables(s, d):
    rows = pages.extract_tables(pages.parse_pages(vote_pages(s, d), ("tables",)))
    shown = F.array_join(F.transform(F.sort_array(F.map_entries("cells")), lambda x: F.concat_ws("=", x["key"], x["value"])), "|")
    return rows.select("page_id", F.col("table_no").cast("bigint").alias("table_no"), F.col("row_no").cast("bigint").alias("row_no"), shown.alias("cells"))


def _udtf_tables(s, d):
    """The same rows through the registered table function."""
    registry.install(s)
    vote_pages(s, d).createOrReplaceTempView("threadloom_vote_pages")
    return s.sql(
        "SELECT page_id, CAST(table_no AS BIGINT) AS table_no, array_join(cells, '|') AS cells FROM html_tables(TABLE(SELECT page_id, html FROM threadloom_vote_pages))"
    )


def _members(s, d):
    return pages.locate_member_rows(pages.parse_pages(vote_pages(s, d), ("tables",))).select("page_id", "representative", "party", "state", "vote")


def _grouped(s, d):
    return pages.extract_grouped_lists(pages.parse_pages(vote_pages(s, d), ("groups",))).select("page_id", "group", "name")


def _reconcile(s, d):
    return ballots.reconcile_pages(pages.parse_pages(vote_pages(s, d), ("text", "tables")))


def _front_matter(s, d):
    doc = read_table(s, d, "documents")
    text = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(
        F.lit("metadata:\n  lang: "), F.col("lang"), F.lit("\n  source: "), F.col("source"), F.lit("\n---\n "), F.col("text")))
    out = sections.front_matter(doc.select("doc_id", text.alias("text")))
    return out.select("doc_id", F.element_at("metadata", "lang").alias("lang"), F.element_at("metadata", "source").alias("source"), "description")


def _templates(s, d, side):
    c = read_table(s, d, "customer")
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    params = c.select(name.alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("value"))
    o = read_table(s, d, "orders")
    ref = F.concat(F.lit("{$c"), (F.col("o_custkey") * F.when(F.col("o_orderkey") % 11 == 0, 100000).otherwise(1)).cast("string"), F.lit("}"))
    text = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit("\nfor "), ref, F.lit(" and "), ref, F.lit(" {kept}"))
    return text_jobs.fill_templates(o.select(F.col("o_orderkey").alias("template_id"), text.alias("text")), params)[side]


def _typed_templates(s, d):
    """Customers as parameters of five kinds: a list, a map, a boolean, nothing and a text."""
    c = read_table(s, d, "customer")
    k = F.col("c_custkey")
    made = F.when(k % 5 == 0, F.to_json(F.array(k.cast("string"), F.col("c_name")))).when(k % 5 == 1, F.to_json(F.struct(F.col("c_name").alias("name"), k.alias("no"))))
    made = made.when(k % 5 == 2, F.lit("true")).when(k % 5 == 3, F.lit("null")).otherwise(F.to_json(F.array("c_name")).substr(F.lit(2), F.length("c_name") + 2))
    params = c.select(F.concat(F.lit("c"), k.cast("string")).alias("name"), F.parse_json(made).alias("value"))
    o = read_table(s, d, "orders")
    text = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(": {$c"), F.col("o_custkey").cast("string"), F.lit("}!"))
    return text_jobs.fill_templates(o.select(F.col("o_orderkey").alias("template_id"), text.alias("text")), params)[0]


def keyword_texts(s, d):
    """Each whole text as a list under one keyword and as plain lines under another."""
    text = F.concat_ws("\n", F.lit("intro"), F.lit("PROS and more"), F.concat(F.lit("- "), F.regexp_replace("text", "\n", "\n- ")), F.lit("• second"),
                       F.lit("a long line that is no bullet"), F.lit("Cons:"), F.lit("short"), F.lit("this long line opens the list"), F.lit("  - own"),
                       F.col("text"), F.lit("pros"), F.lit("a long line in a list that is not empty"), F.lit("- third"))
    return read_table(s, d, "documents").select("doc_id", text.alias("text"))


def _symbols(s, d):
    doc = read_table(s, d, "documents").select("doc_id", "lang", "source", "text")
    text = F.concat(F.col("text"), F.lit(" Use $"), F.col("lang"), F.lit(" and $"), F.col("source"), F.lit(" or $"), F.col("lang"), F.lit(" in `$x = Call($"), F.col("lang"), F.lit(")`. "), F.col("text"))
    return corpus.symbol_index(doc.select("doc_id", text.alias("text")))


def _blocks(s, d):
    """Markdown built around each whole text: a heading, a list, a quote, code that holds the text again, and a rule."""
    doc = read_table(s, d, "documents")
    text = F.concat_ws("\n", F.concat(F.lit("## "), F.col("lang")), F.concat(F.lit("w "), F.col("text")), F.lit("next line"), F.lit(""), F.lit("- one"), F.lit("  more"),
                       F.concat(F.lit("2. "), F.col("source")), F.lit(""), F.lit("> quoted"), F.lit("> twice"), F.lit("```python"), F.lit("# no heading"), F.lit(""), F.col("text"),
                       F.lit("```"), F.lit("***"), F.regexp_replace("text", "\n", "\n> "), F.lit("~~~"), F.lit("- open code"))
    return sections.markdown_blocks(doc.select("doc_id", text.alias("text")))


def _text_columns(s, d):
    doc = read_table(s, d, "documents")
    return doc.select(
        "doc_id", tx.shorten(F.col("text"), 40).alias("short"), tx.preview(F.col("text")).alias("preview"),
        tx.human_bytes(F.octet_length("text") * 1000).alias("size"), tx.to_camel_case(F.concat_ws("_", "lang", "source", F.lit("some-words"))).alias("camel"),
        tx.indent(F.col("text"), 2).alias("indented"),
    )


def _scalars(s, d):
    o = read_table(s, d, "orders")
    p = F.col("o_totalprice")
    return o.select(
        "o_orderkey", F.round(registry.column("tax", p, F.lit(20.0)), 4).alias("tax"),
        registry.column("add", p, F.lit(1.5)).alias("added"), registry.column("multiply", p, F.lit(2.0)).alias("doubled"),
    )


def _composed(s, d):
    """Whole texts whose letters a and o carry a separate accent, composed."""
    registry.install(s)
    doc = read_table(s, d, "documents").select("doc_id", F.replace(F.replace("text", F.lit("a"), F.lit("a\u0308")), F.lit("o"), F.lit("o\u0301")).alias("text"))
    return doc.select("doc_id", registry.column("composed", F.col("text")).alias("text")).select(
        "doc_id", F.sha2("text", 256).alias("digest"), F.char_length("text").cast("bigint").alias("n_chars"))


@registry.transform("drop_blank_turns")
def drop_blank_turns(df):
    """Turns with text."""
    return context.drop_blank(df)


@registry.transform("tokens_by")
def tokens_by(df, key="conv_id"):
    """Token totals per key."""
    return context.conversation_tokens(df, key=key)


QUERIES = {
    "keep_fields": _keep_fields,
    "drop_volatile": _drop_volatile,
    "import_refs": lambda s, d: imports.import_refs(file_graph(s, d)),
    "resolve_import_edges": lambda s, d: _edges(s, d, 0),
    "unresolved_imports": lambda s, d: _edges(s, d, 1),
    "import_closure": lambda s, d: imports.import_closure(_edges(s, d, 0), 20)[0],
    "import_closure_errors": lambda s, d: imports.import_closure(_edges(s, d, 0), 3)[1],
    "inline_imports": _inline,
    "dense_steps": _dense_steps,
    "find_dates": _find_dates,
    "entity_codes": _entity_codes,
    "extract_tables": _extract_tables,
    "extract_tables_udtf": _udtf_tables,
    "locate_member_rows": _members,
    "extract_grouped_lists": _grouped,
    "reconcile_counts": _reconcile,
    "front_matter": _front_matter,
    "fill_templates": lambda s, d: _templates(s, d, 0),
    "fill_templates_typed": _typed_templates,
    "fill_templates_errors": lambda s, d: _templates(s, d, 1),
    "split_by_keyword": lambda s, d: sections.split_by_keyword(keyword_texts(s, d)),
    "symbol_index": _symbols,
    "markdown_blocks": _blocks,
    "text_columns": _text_columns,
    "registry_scalars": _scalars,
    "registry_vectorised": _composed,
    "registry_transforms": lambda s, d: registry.apply(read_table(s, d, "conversations"), "drop_blank_turns", ("tokens_by", {"key": "role"})),
}

#: White space of any script at both ends.
_STRIP = r"regexp_replace({}, '^[\s\x0B\p{{Z}}]+|[\s\x0B\p{{Z}}]+$', '', 'g')"
_FILES = """files AS (SELECT doc_id, 'src/f' || doc_id || '.md' AS path, CASE WHEN doc_id = 0 THEN 'start' WHEN doc_id % 10 = 7 THEN '!import missing.md # later'
  ELSE '  !import f' || (doc_id // 2) || '.md' END AS directive, text AS body FROM documents)"""
_EDGE = "e AS (SELECT doc_id AS a, doc_id // 2 AS b FROM documents WHERE doc_id > 0 AND doc_id % 10 <> 7)"
_VOTE = "CASE o_orderstatus WHEN 'F' THEN 'Yea' WHEN 'O' THEN 'Nay' ELSE 'Not Voting' END"
_J = "j AS (SELECT *, " + _VOTE + " AS vote FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
_KINDS = "[" + ", ".join(f"'{k}'" for k in list(pages.ENTITY_CODES) + ["house-report"]) + "]"
_CODES = "[" + ", ".join(f"'{k}'" for k in pages.ENTITY_CODES.values()) + ", NULL]"
_URL = f"'https://records.example/bill/119/' || {_KINDS}[o_custkey % 9 + 1] || '/' || o_orderkey || '?x=1'"
_REF = "o_custkey * CASE WHEN o_orderkey % 11 = 0 THEN 100000 ELSE 1 END"

SQL = {
    "keep_fields": """SELECT event_id, '{"name":' || user_id || ',"children":[{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || ',"name":"' || event_type || '"}]}' AS span FROM events""",
    "drop_volatile": """SELECT event_id, '{"name":' || user_id || ',"children":[{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || ',"name":"' || event_type || '"}]}' AS span FROM events""",
    "import_refs": f"WITH {_FILES} SELECT path, 1::BIGINT AS line_no, CASE WHEN doc_id % 10 = 7 THEN '' ELSE '  ' END AS indent, CASE WHEN doc_id % 10 = 7 THEN 'missing.md' ELSE 'f' || (doc_id // 2) || '.md' END AS target FROM files WHERE doc_id > 0",
    "resolve_import_edges": f"WITH {_FILES} SELECT path, 1::BIGINT AS line_no, '  ' AS indent, 'f' || (doc_id // 2) || '.md' AS target, 'src/f' || (doc_id // 2) || '.md' AS imported FROM files WHERE doc_id > 0 AND doc_id % 10 <> 7",
    "unresolved_imports": f"WITH {_FILES} SELECT path, 1::BIGINT AS line_no, 'missing.md' AS target FROM files WHERE doc_id % 10 = 7",
    "import_closure": f"""WITH RECURSIVE {_EDGE}, t AS (SELECT a, b, CAST(1 AS BIGINT) AS depth FROM e UNION ALL SELECT t.a, e.b, depth + 1 FROM t JOIN e ON e.a = t.b)
SELECT 'src/f' || a || '.md' AS path, 'src/f' || b || '.md' AS imported, min(depth) AS depth FROM t GROUP BY a, b""",
    "import_closure_errors": f"""WITH RECURSIVE {_EDGE}, t AS (SELECT a, b, CAST(1 AS BIGINT) AS depth, 'src/f' || a || '.md -> src/f' || b || '.md' AS chain FROM e
  UNION ALL SELECT t.a, e.b, depth + 1, chain || ' -> src/f' || e.b || '.md' FROM t JOIN e ON e.a = t.b WHERE depth <= 3)
SELECT 'src/f' || a || '.md' AS path, 'too deep' AS error, depth, chain FROM t WHERE depth > 3""",
    "inline_imports": f"""WITH RECURSIVE {_FILES}, t AS (SELECT doc_id AS root, doc_id AS cur, 0 AS depth FROM files
  UNION ALL SELECT root, cur // 2, depth + 1 FROM t WHERE cur > 0 AND cur % 10 <> 7),
l AS (SELECT root, depth, repeat('  ', depth) AS pad, directive, body, cur > 0 AND cur % 10 <> 7 AS goes_on FROM t JOIN files ON doc_id = cur),
x AS (SELECT root, -depth AS o, array_to_string(list_transform(string_split(body, chr(10)), lambda b: CASE WHEN regexp_matches(b, '\\S') THEN pad || b ELSE b END), chr(10)) AS line FROM l UNION ALL SELECT root, -1000, pad || directive FROM l WHERE NOT goes_on)
SELECT 'src/f' || root || '.md' AS path, string_agg(line, chr(10) ORDER BY o) AS text FROM x GROUP BY root""",
    "dense_steps": """WITH s AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS n FROM lineitem),
p AS (SELECT doc_id, n, CASE WHEN n <= 2 THEN '0' || n ELSE '01.0' || n END AS step_no, CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN 100 ELSE n END AS o FROM s)
SELECT doc_id, step_no, lead(step_no) OVER (PARTITION BY doc_id ORDER BY o) AS next_step,
  CASE WHEN n > 2 AND EXISTS (SELECT 1 FROM s WHERE s.doc_id = p.doc_id AND s.n = 1) THEN '01' END AS parent_step FROM p""",
    "find_dates": """WITH d AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 IN (0, 1) THEN CAST(o_orderdate AS DATE) END AS day FROM orders)
SELECT doc_id, strftime(day, '%Y-%m-%d') AS found_date, strftime(day, '%b%Y') AS month FROM d""",
    "entity_codes": f"SELECT o_orderkey, {_CODES}[o_custkey % 9 + 1] || o_orderkey AS code, strftime(o_orderdate, '%b%Y') AS month, regexp_replace({_URL}, '[^A-Za-z0-9_-]', '_', 'g') AS file_name FROM orders",
    "extract_tables": f"""WITH {_J} SELECT o_orderkey AS page_id, CAST(0 AS BIGINT) AS table_no, CAST(0 AS BIGINT) AS row_no, '0=other' AS cells FROM j
UNION ALL SELECT o_orderkey, 1, 0, CASE WHEN o_orderkey % 5 = 0 THEN '0=' || c_name || '|1=' || c_mktsegment || '|2=' || n_name || '|3=' || vote
  ELSE 'Party=' || c_mktsegment || '|Representative=' || c_name || '|State=' || n_name || '|Vote=' || vote END FROM j""",
    "extract_tables_udtf": f"WITH {_J} SELECT o_orderkey AS page_id, CAST(0 AS BIGINT) AS table_no, 'other' AS cells FROM j UNION ALL SELECT o_orderkey, 1, c_name || '|' || c_mktsegment || '|' || n_name || '|' || vote FROM j",
    "locate_member_rows": f"""WITH {_J} SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 5 = 0 THEN 'other' ELSE c_name END AS representative,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE c_mktsegment END AS party, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE n_name END AS state, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE vote END AS vote FROM j""",
    "extract_grouped_lists": f"""WITH {_J} SELECT o_orderkey AS page_id, vote AS "group", c_name AS name FROM j UNION ALL SELECT o_orderkey, vote, 'Second ' || c_mktsegment FROM j
UNION ALL SELECT o_orderkey, 'Present', unnest(['A', 'B', 'C']) FROM j""",
    "reconcile_counts": f"""WITH {_J}, c AS (SELECT o_orderkey AS page_id, CAST(o_orderstatus = 'F' AS BIGINT) AS yea, CAST(0 AS BIGINT) AS nay,
  CAST(vote = 'Yea' AND o_orderkey % 5 <> 0 AS BIGINT) AS votes_for, CAST(vote = 'Nay' AND o_orderkey % 5 <> 0 AS BIGINT) AS votes_against FROM j)
SELECT *, yea = votes_for AND nay = votes_against AS agrees FROM c""",
    "front_matter": """SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang, CASE WHEN doc_id % 3 <> 0 THEN source END AS source,
  regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS description FROM documents""",
    "fill_templates": f"""WITH t AS (SELECT *, {_REF} AS r FROM orders)
SELECT o_orderkey AS template_id, 'Order ' || o_orderkey || chr(10) || 'for ' || v || ' and ' || v || ' {{kept}}' AS text
FROM (SELECT o_orderkey, CASE WHEN c_acctbal > 0 THEN c_name ELSE '' END AS v FROM t JOIN customer ON c_custkey = r)""",
    "fill_templates_typed": """SELECT o_orderkey AS template_id, 'Order ' || o_orderkey || ': ' || CASE c_custkey % 5 WHEN 0 THEN '["' || c_custkey || '","' || c_name || '"]'
  WHEN 1 THEN '{"name":"' || c_name || '","no":' || c_custkey || '}' WHEN 2 THEN 'True' WHEN 3 THEN '' ELSE c_name END || '!' AS text FROM orders JOIN customer ON o_custkey = c_custkey""",
    "fill_templates_errors": f"SELECT o_orderkey AS template_id, 'c' || ({_REF}) AS name, CAST(2 AS BIGINT) AS line, CAST(5 AS BIGINT) AS \"column\" FROM orders WHERE ({_REF}) NOT IN (SELECT c_custkey FROM customer)",
    "split_by_keyword": f"""WITH t AS (SELECT doc_id, concat_ws(chr(10), 'intro', 'PROS and more', '- ' || replace(text, chr(10), chr(10) || '- '), '• second', 'a long line that is no bullet', 'Cons:', 'short',
    'this long line opens the list', '  - own', text, 'pros', 'a long line in a list that is not empty', '- third') AS t FROM documents),
r AS (SELECT doc_id, string_split(t, chr(10)) AS a FROM t), u AS (SELECT doc_id, unnest(a) AS x, CAST(generate_subscripts(a, 1) AS BIGINT) AS line_no FROM r),
l AS (SELECT doc_id, line_no, {_STRIP.format('x')} AS line FROM u),
o AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)^Pros([^\\p{{L}}\\p{{N}}_]|$)') THEN 'Pros' WHEN regexp_matches(line, '(?i)^Cons([^\\p{{L}}\\p{{N}}_]|$)') THEN 'Cons' END AS open, regexp_matches(line, '^[-•]\\s+') AS bullet FROM l),
f AS (SELECT *, last_value(open IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM o),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY line_no) AS k FROM f WHERE section IS NOT NULL AND open IS NULL AND (bullet OR length(line) > 20))
SELECT doc_id, section, line_no, regexp_replace(line, '^[-•]\\s+', '') AS item FROM c WHERE bullet OR k = 1""",
    "symbol_index": """WITH t AS (SELECT doc_id, text || ' Use $' || lang || ' and $' || source || ' or $' || lang || ' in `$x = Call($' || lang || ')`. ' || text AS t FROM documents),
u AS (SELECT doc_id, 'variable' AS kind, unnest(regexp_extract_all(t, '\\$([a-zA-Z_][a-zA-Z0-9_]*)', 1)) AS symbol FROM t
  UNION ALL SELECT doc_id, 'call', unnest(regexp_extract_all(t, '(?s)`(?:.*\\W*=\\W*)?([A-Za-z0-9_]+(?:\\.[A-Za-z0-9_]+)*\\(.*?\\))`', 1)) FROM t)
SELECT doc_id, kind, symbol, count(*) AS uses FROM u GROUP BY ALL""",
    "markdown_blocks": f"""WITH t AS (SELECT doc_id, concat_ws(chr(10), '## ' || lang, 'w ' || text, 'next line', '', '- one', '  more', '2. ' || source, '', '> quoted', '> twice', '```python', '# no heading', '', text, '```', '***',
    replace(text, chr(10), chr(10) || '> '), '~~~', '- open code') AS t FROM documents),
a AS (SELECT doc_id, string_split(t, chr(10)) AS a FROM t), l AS (SELECT doc_id, unnest(a) AS line, CAST(generate_subscripts(a, 1) AS BIGINT) AS n FROM a),
f AS (SELECT *, regexp_matches(line, '^\\s{{0,3}}(```|~~~)') AS fence FROM l),
g AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM f),
k AS (SELECT *, CASE WHEN inside OR fence THEN 'code' WHEN {_STRIP.format('line')} = '' THEN 'blank' WHEN regexp_matches(line, '^#{{1,6}}(\\s|$)') THEN 'heading'
  WHEN regexp_matches(line, '^\\s{{0,3}}(-(\\s*-){{2,}}|\\*(\\s*\\*){{2,}}|_(\\s*_){{2,}})\\s*$') THEN 'rule' WHEN regexp_matches(line, '^\\s*([-*+]|\\d+[.)])\\s') THEN 'item'
  WHEN regexp_matches(line, '^\\s{{0,3}}>') THEN 'quote' ELSE 'paragraph' END AS type FROM g),
p AS (SELECT *, lag(type) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM k),
o AS (SELECT *, CASE WHEN type = 'code' THEN fence AND NOT inside WHEN type IN ('heading', 'rule', 'item', 'blank') THEN true
  ELSE type IS DISTINCT FROM before AND NOT (type = 'paragraph' AND before IS NOT DISTINCT FROM 'item') END AS opens FROM p),
b AS (SELECT *, max(CASE WHEN opens THEN n END) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM o)
SELECT doc_id, block AS line_no, arg_min(type, n) AS type, max(CASE WHEN type = 'heading' THEN length(regexp_extract(line, '^(#+)', 1)) END) AS level,
  coalesce(string_agg(CASE WHEN type = 'heading' THEN {_STRIP.format("regexp_replace(line, '^#+|\\s#+\\s*$', '', 'g')")} WHEN type = 'quote' THEN regexp_replace(line, '^\\s{{0,3}}>\\s?', '')
    WHEN type = 'item' THEN regexp_replace(line, '^\\s*([-*+]|\\d+[.)])\\s+', '') WHEN type = 'paragraph' THEN {_STRIP.format('line')} WHEN fence THEN NULL ELSE line END, chr(10) ORDER BY n), '') AS text
FROM b WHERE type <> 'blank' GROUP BY doc_id, block""",
    "text_columns": """WITH d AS (SELECT *, octet_length(encode(text)) * 1000 AS n, text AS s FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 37) || '...' END AS short,
  CASE WHEN length(text) > 400 THEN substr(text, 1, 180) || ' ... ' || substr(text, length(text) - 179) || ' (length: ' || length(text) || ')' ELSE text END AS preview,
  CASE WHEN n < 1024 THEN printf('%.1f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) ELSE printf('%.1f GB', n / 1073741824) END AS size,
  upper(substr(lang, 1, 1)) || lower(substr(lang, 2)) || upper(substr(source, 1, 1)) || lower(substr(source, 2)) || 'SomeWords' AS camel,
  array_to_string(list_transform(string_split(s, chr(10)), lambda l: CASE WHEN regexp_matches(l, '\\S') THEN '  ' || l ELSE l END), chr(10)) AS indented FROM d""",
    "registry_vectorised": "WITH t AS (SELECT doc_id, nfc_normalize(replace(replace(text, 'a', 'a' || chr(776)), 'o', 'o' || chr(769))) AS text FROM documents) SELECT doc_id, sha256(text) AS digest, CAST(length(text) AS BIGINT) AS n_chars FROM t",
    "registry_scalars": "SELECT o_orderkey, round(o_totalprice * 20.0::DOUBLE / 100, 4) AS tax, o_totalprice + 1.5::DOUBLE AS added, o_totalprice * 2.0::DOUBLE AS doubled FROM orders",
    "registry_transforms": "SELECT role, CAST(sum(len(regexp_extract_all(text, '\\S+')) + 4) + 2 AS BIGINT) AS tokens FROM conversations WHERE trim(text) <> '' GROUP BY role",
}
