"""Page queries over ``pages``; ballot queries over ``orders``, ``customer`` and ``nation``."""

import datetime as dt

from pyspark.sql import functions as F

from threadloom.operators import ballots, pages as ops
from threadloom.sources import corpus, records, traces
from threadloom.sources.tables import read_pages, read_table
from threadloom.streaming import live


def pages(spark, d):
    return read_table(spark, d, "pages")


def votes(spark, d):
    o, c, n = (read_table(spark, d, t) for t in ("orders", "customer", "nation"))
    ballot = F.when(F.col("o_orderstatus") == "F", "Yea").when(F.col("o_orderstatus") == "O", " No ").otherwise("Not Voting")
    return (
        o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
        .select("o_orderkey", "o_orderdate", "o_orderpriority", ballot.alias("vote"), F.col("c_mktsegment").alias("party"),
                F.col("n_name").alias("state"), F.col("c_custkey").alias("member"))
    )


def _states(s, d):
    return votes(s, d).withColumn("state", F.concat(F.lit("State "), F.regexp_replace("state", "NATION_", "n")))


def _entities(s, d, table):
    month = F.date_format("o_orderdate", "MMMyyyy")
    o = read_table(s, d, "orders")
    if table == "bills":
        return o.select(month.alias("month"), F.concat(F.lit("HR"), F.col("o_custkey")).alias("entity"), F.col("o_orderkey").alias("bill_id"))
    if table == "votes":
        v = o.select(month.alias("month"), F.concat(F.lit("HR"), F.col("o_custkey")).alias("entity"), "o_orderstatus")
        return v.groupBy("month", "entity").agg(F.count_if(F.col("o_orderstatus") == "F").alias("yes"))
    a = o.filter("o_orderpriority = '1-URGENT'").select(month.alias("month"), F.concat(F.lit("HR"), F.col("o_custkey")).alias("entity"), "o_totalprice")
    return a.groupBy("month", "entity").agg(F.max("o_totalprice").alias("best"))


def _month_question(s, d):
    q = F.when(F.col("o_orderpriority") == "1-URGENT", "Vote: On Passage").when(F.col("o_orderpriority") == "2-HIGH", "on passage of it").otherwise("On Motion")
    o = read_table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("vote_date"), q.alias("question"))
    return ballots.filter_month_and_question(o, dt.date(1997, 11, 1)).select("o_orderkey", "question")


def _split(s, d, side):
    p = pages(s, d).select("page_id", "url", F.length("html").alias("n"))
    number = F.regexp_extract("url", r"/(\d+)(?:[?#].*)?$", 1)
    checks = {
        "NoNumber": (number == "", F.concat(F.lit("no number in "), F.col("url"))),
        "Fragment": (F.contains("url", F.lit("#")), F.lit("address has a fragment")),
        "Short": (F.try_divide(F.col("n"), number.try_cast("int")) < 3, F.lit("short page")),
    }
    return ops.split_errors(p, "page_id", checks)[side].drop("n")


def _blocked(s, d):
    p = pages(s, d)
    marked = p.withColumn("html", F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("<p>Just a moment</p>"), "html")).otherwise(F.col("html")))
    return ops.drop_blocked_pages(marked)[1].select("page_id")


def _user_tasks(s, d):
    users = read_table(s, d, "customer").select((F.col("c_acctbal") > 0).alias("active"))
    tasks = read_table(s, d, "orders").select((F.col("o_orderstatus") == "F").alias("completed"))
    return ballots.active_summary(users, tasks)


def _files(s, d):
    have = read_table(s, d, "lineitem").select(F.col("l_orderkey").alias("entity"), F.col("l_returnflag").alias("kind"))
    return ballots.files_per_entity(have, ["A", "N", "R"])


def _fields(s, d):
    return ops.extract_page_fields(ops.parse_pages(pages(s, d), ("title", "text", "paragraphs")))


def _scan_corpus(s, d):
    """Texts stored as one file per source and language, listed and read back."""
    root = live.work_folder(s, "corpus")
    docs = read_table(s, d, "documents").select("source", "lang", "text")
    docs.repartition("source", "lang").write.partitionBy("source", "lang").text(root)
    files = corpus.scan_corpus(s, root, "*.txt")
    return files.select(
        F.regexp_replace("relative_path", r"/[^/]*$", "").alias("folder"), F.col("size").cast("bigint").alias("size"),
        F.length("text").cast("bigint").alias("n_chars"),
    )


def _records(s, d):
    """Analysis records of each month, region and priority, many to a folder, written as JSON and read back."""
    root = live.work_folder(s, "records")
    o, c, n = (read_table(s, d, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    first = j.groupBy(F.trunc("o_orderdate", "month").alias("m"), "n_regionkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("k"), F.min("o_orderkey").alias("first"))
    made = first.select(
        F.concat(F.lit("Bill "), F.col("first").cast("string")).alias("bill_title"), F.date_format("m", "MM/dd/yyyy").alias("date_of_vote"),
        F.concat(F.col("k").cast("string"), F.lit(" orders")).alias("brief_summary"),
        F.when(F.col("k") % 2 == 0, F.array(F.lit("even"), F.lit("whole"))).alias("pros"), F.lit(None).cast("array<string>").alias("cons"),
        F.concat(F.lit("https://records.example/bill/x/house-bill/"), F.col("n_regionkey").cast("string")).alias("url"),
    )
    records.write_partitioned(records.with_folders(made, "url", "date_of_vote").drop("url"), root, fmt="json")
    back = records.read_records(s, root, records.ANALYSIS_SCHEMA)
    return back.select("bill_title", "date_of_vote", "brief_summary", F.array_join("pros", "|").alias("pros"), "month", "entity")


def _record_forms(s, d):
    """Orders stored in the three forms of a record file, lines, an array and one indented object, and two broken files."""
    root = live.work_folder(s, "forms")
    o = read_table(s, d, "orders").select(
        F.date_format("o_orderdate", "MMMyyyy").alias("month"), F.concat(F.lit("Bill "), F.col("o_orderkey").cast("string")).alias("bill_title"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("date_of_vote"), F.col("o_orderpriority").alias("brief_summary"),
        F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("even"), F.lit("of\nall"))).alias("pros"), (F.col("o_orderkey") % 8).alias("form"))
    record = F.struct("bill_title", "date_of_vote", "brief_summary", "pros")
    o = o.select("month", "form", "bill_title", F.to_json(record).alias("line"), F.to_json(record, {"pretty": "true"}).alias("indented"))
    lines = o.filter("form < 5").select("month", F.lit("HR1").alias("entity"), F.col("line").alias("value"))
    arrays = o.filter("form in (5, 6)").groupBy("month").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("indented"), ",\n"), F.lit("\n]")).alias("value"))
    single = o.filter("form = 7").groupBy("month").agg(F.min_by("indented", "bill_title").alias("value"))
    broken = single.select("month", F.lit("HR4").alias("entity"), F.expr("left(value, length(value) - 2)").alias("value"))
    for part in (lines, arrays.withColumn("entity", F.lit("HR2")), single.withColumn("entity", F.lit("HR3")), broken):
        # one file for each folder; a file is one text, or the lines of one
        part.repartition("month", "entity").write.mode("append").partitionBy("month", "entity").text(root)
    back = records.read_records(s, root, records.ANALYSIS_SCHEMA, "*.txt")
    return back.select("month", "entity", "bill_title", "date_of_vote", F.array_join("pros", "|").alias("pros"), F.col("error").isNotNull().alias("is_error"))


def _write_new_append(s, d):
    """A new file set, appended to, and a copy under the time of the run."""
    root = live.work_folder(s, "regions")
    customers = read_table(s, d, "customer").select("c_custkey", "c_mktsegment")
    records.write_new(customers, f"{root}/data")
    records.append(customers.filter("c_mktsegment = 'BUILDING'"), f"{root}/data")
    copy = records.timestamped_copy(s.read.parquet(f"{root}/data"), f"{root}/data", dt.datetime(2025, 1, 2, 3, 4, 5))
    return s.read.parquet(copy)


def _export_trace(s, d):
    from threadloom.catalog.events import span_rows

    root = live.work_folder(s, "trace")
    traces.export_trace_json(span_rows(s, d), f"{root}/lines")
    schema = "span_id bigint, trace_id bigint, ts string, position bigint, depth bigint, root_id bigint"
    return s.read.schema(schema).json(f"{root}/lines")


QUERIES = {
    "scan_corpus": _scan_corpus,
    "read_records": _records,
    "read_record_forms": _record_forms,
    "write_new_append": _write_new_append,
    "export_trace_json": _export_trace,
    "read_pages": lambda s, d: read_pages(s, d).select("page_id", "url", "success", "error"),
    "page_titles": lambda s, d: ops.page_titles(pages(s, d)),
    "extract_page_fields": lambda s, d: _fields(s, d).select("page_id", "title"),
    "page_summaries": lambda s, d: _fields(s, d).select("page_id", "summary", "opening"),
    "pages_to_markdown": lambda s, d: ops.pages_to_markdown(ops.parse_pages(pages(s, d), ("markdown",))),
    "extract_links": lambda s, d: ops.extract_links(pages(s, d)),
    "extract_links_first": lambda s, d: ops.extract_links(pages(s, d), limit=3).select("page_id", "link_no", "link"),
    "link_texts": lambda s, d: ops.link_texts(ops.extract_links(pages(s, d))),
    "resolve_links": lambda s, d: ops.resolve_links(pages(s, d), ops.extract_links(pages(s, d)), ["The", "que", "sch", "text"]),
    "drop_blocked_pages": _blocked,
    "split_errors_good": lambda s, d: _split(s, d, 0),
    "split_errors": lambda s, d: _split(s, d, 1),
    "tally": lambda s, d: ballots.tally(votes(s, d), ["party", "state"]),
    "tally_multi": lambda s, d: ballots.tally_multi(votes(s, d), "o_orderpriority"),
    "sorted_members": lambda s, d: ballots.sorted_members(_states(s, d), "o_orderkey").select("o_orderkey", "bucket", "state_code", "party_class"),
    "filter_month_and_question": _month_question,
    "join_entity_records": lambda s, d: ballots.join_entity_records(_entities(s, d, "bills"), _entities(s, d, "votes"), _entities(s, d, "analyses")),
    "missing_entities": lambda s, d: ballots.missing_entities(_entities(s, d, "bills"), _entities(s, d, "analyses"), ["month", "entity"]),
    "files_per_entity": _files,
    "active_summary": _user_tasks,
}

from threadloom.catalog.events import _SPANS  # noqa: E402

_VOTES = """votes AS (SELECT o_orderkey, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'for' WHEN 'O' THEN 'against' ELSE 'abstained' END AS bucket,
  c_mktsegment AS party, n_name AS state FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
_COUNTS = "count(*) FILTER (bucket = 'for') AS votes_for, count(*) FILTER (bucket = 'against') AS votes_against, count(*) FILTER (bucket = 'abstained') AS votes_abstained"


def _unescape(x):
    for name, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")]:
        x = f"replace({x}, '{name}', '{char}')"
    return x


_TITLE = "regexp_replace(" + _unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + ", '^\\s+|\\s+$', '', 'g')"
_LINKS = f"""anchors AS (SELECT page_id, url, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g'), '(?is)<a\\s[^>]*>.*?</a>') AS a FROM pages),
an AS (SELECT page_id, url, unnest(a) AS a, generate_subscripts(a, 1) AS i FROM anchors),
hr AS (SELECT page_id, url, i, {_unescape("regexp_extract(a, '(?is)href=\"([^\"]*)\"', 1)")} AS href,
  regexp_replace(regexp_replace({_unescape("regexp_replace(a, '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM an),
links AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY i) AS link_no,
  CASE WHEN regexp_matches(href, '^https?:') THEN href ELSE regexp_extract(url, '^(https?://[^/?#]*)', 1) || href END AS link, text FROM hr WHERE href <> ''),
named AS (SELECT page_id, url, link_no, CASE WHEN text <> '' THEN text ELSE link END AS label, link FROM links)"""
_ENT = "strftime(o_orderdate, '%b%Y') AS month, 'HR' || o_custkey AS entity"
_NUM = "regexp_extract(url, '/(\\d+)(?:[?#].*)?$', 1)"
_CHECK = f"""x AS (SELECT page_id, url, CASE WHEN {_NUM} = '' THEN 'NoNumber' WHEN contains(url, '#') THEN 'Fragment'
  WHEN TRY_CAST({_NUM} AS INT) <> 0 AND length(html) / TRY_CAST({_NUM} AS INT) < 3 THEN 'Short' END AS error_type FROM pages)"""

SQL = {
    "scan_corpus": """SELECT 'source=' || source || '/lang=' || lang AS folder, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM documents GROUP BY source, lang""",
    "read_records": """WITH g AS (SELECT date_trunc('month', o_orderdate) AS m, n_regionkey AS r, o_orderpriority AS p, count(*) AS k, min(o_orderkey) AS f FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT 'Bill ' || f AS bill_title, strftime(m, '%m/%d/%Y') AS date_of_vote, k || ' orders' AS brief_summary, CASE WHEN k % 2 = 0 THEN 'even|whole' END AS pros, strftime(m, '%b%Y') AS month, 'HR' || r AS entity FROM g""",
    "read_record_forms": """WITH o AS (SELECT strftime(o_orderdate, '%b%Y') AS month, o_orderkey % 8 AS form, 'Bill ' || o_orderkey AS bill_title, strftime(o_orderdate, '%m/%d/%Y') AS date_of_vote,
  CASE WHEN o_orderkey % 2 = 0 THEN 'even|of' || chr(10) || 'all' END AS pros FROM orders),
one AS (SELECT month, arg_min(struct_pack(b := bill_title, d := date_of_vote, p := pros), bill_title) AS r FROM o WHERE form = 7 GROUP BY month)
SELECT month, CASE WHEN form < 5 THEN 'HR1' ELSE 'HR2' END AS entity, bill_title, date_of_vote, pros, false AS is_error FROM o WHERE form < 7
UNION ALL SELECT month, 'HR3', r.b, r.d, r.p, false FROM one UNION ALL SELECT month, 'HR4', NULL, NULL, NULL, true FROM one""",
    "write_new_append": "SELECT c_custkey, c_mktsegment FROM customer UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'",
    "export_trace_json": f"""WITH RECURSIVE {_SPANS}, t AS (SELECT span_id, span_id AS root_id, CAST(0 AS BIGINT) AS depth FROM sp WHERE parent_id IS NULL OR parent_id NOT IN (SELECT span_id FROM sp)
  UNION ALL SELECT s.span_id, t.root_id, t.depth + 1 FROM sp s JOIN t ON s.parent_id = t.span_id)
SELECT span_id, trace_id, '<datetime>' AS ts, row_number() OVER (PARTITION BY trace_id ORDER BY ts, span_id) AS position, depth, root_id FROM sp s JOIN t USING (span_id)""".replace("ORDER BY ts, span_id) AS position", "ORDER BY s.ts, span_id) AS position"),
    "read_pages": "SELECT page_id, url, coalesce(length(html) > 0, false) AS success, CASE WHEN coalesce(length(html) > 0, false) THEN NULL ELSE 'empty body' END AS error FROM pages",
    "page_titles": f"SELECT page_id, url, CASE WHEN {_TITLE} <> '' THEN {_TITLE} ELSE url END AS title FROM pages",
    "extract_page_fields": f"SELECT page_id, CASE WHEN {_TITLE} <> '' THEN {_TITLE} ELSE url END AS title FROM pages",
    "extract_links": f"WITH {_LINKS} SELECT * FROM named",
    "extract_links_first": f"WITH {_LINKS} SELECT page_id, link_no, link FROM named WHERE link_no <= 3",
    "link_texts": f"WITH {_LINKS} SELECT link, label, count(*) AS uses FROM named GROUP BY link, label",
    "resolve_links": f"""WITH {_LINKS}, w(wanted) AS (VALUES ('the'), ('que'), ('sch'), ('text')),
r AS (SELECT page_id, wanted, CASE WHEN contains(lower(label), wanted) THEN 1 WHEN contains(lower(link), wanted) THEN 2 END AS rank, link_no, link FROM named, w),
b AS (SELECT * FROM r WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id, wanted ORDER BY rank, link_no) = 1)
SELECT p.page_id, w.wanted, CAST(coalesce(b.rank, 3) AS BIGINT) AS rank, coalesce(b.link, p.url || '?tab=' || w.wanted) AS link FROM pages p CROSS JOIN w LEFT JOIN b ON b.page_id = p.page_id AND b.wanted = w.wanted""",
    "drop_blocked_pages": "SELECT page_id FROM pages WHERE page_id % 7 = 0 OR contains(html, 'Just a moment') OR contains(html, 'Verifying you are human')",
    "split_errors_good": f"WITH {_CHECK} SELECT page_id, url FROM x WHERE error_type IS NULL",
    "split_errors": f"""WITH {_CHECK} SELECT page_id, error_type, CASE error_type WHEN 'NoNumber' THEN 'no number in ' || url WHEN 'Fragment' THEN 'address has a fragment' ELSE 'short page' END AS error_text FROM x WHERE error_type IS NOT NULL""",
    "tally": f"WITH {_VOTES} SELECT party, state, {_COUNTS} FROM votes GROUP BY party, state",
    "tally_multi": f"WITH {_VOTES}, t AS (SELECT o_orderpriority, {_COUNTS} FROM votes GROUP BY ROLLUP (o_orderpriority)) SELECT *, greatest(1, CAST(ceil(greatest(votes_for, votes_against, votes_abstained) / 10) AS BIGINT)) AS grid_rows FROM t",
    "sorted_members": f"""WITH {_VOTES} SELECT o_orderkey, bucket, upper(substr(replace(state, 'NATION_', 'n'), 1, 2)) AS state_code, 'other' AS party_class FROM votes ORDER BY bucket, state_code, o_orderkey""",
    "filter_month_and_question": """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Vote: On Passage' ELSE 'on passage of it' END AS question FROM orders
WHERE year(o_orderdate) = 1997 AND month(o_orderdate) = 11 AND o_orderpriority IN ('1-URGENT', '2-HIGH')""",
    "join_entity_records": f"""WITH o AS (SELECT *, {_ENT} FROM orders), v AS (SELECT month, entity, count(*) FILTER (o_orderstatus = 'F') AS yes, max(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS best FROM o GROUP BY ALL)
SELECT month, entity, o_orderkey AS bill_id, yes, best FROM o JOIN v USING (month, entity)""",
    "missing_entities": f"WITH o AS (SELECT *, {_ENT} FROM orders) SELECT month, entity FROM o GROUP BY ALL HAVING NOT bool_or(o_orderpriority = '1-URGENT')",
    "files_per_entity": "SELECT l_orderkey AS entity, count(DISTINCT l_returnflag) AS present, count(DISTINCT l_returnflag) = 3 AS is_complete FROM lineitem GROUP BY l_orderkey",
    "active_summary": """SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS active_users, count(*) AS tasks,
  count(*) FILTER (o_orderstatus = 'F') AS completed_tasks, count(*) FILTER (o_orderstatus <> 'F') AS open_tasks FROM orders""",
}
