"""Corpus queries over ``documents``; sections use texts with a heading mark on every fifth line."""

from pyspark.sql import functions as F

from threadloom.operators import corpus as ops
from threadloom.operators import sections, similarity, state, text_jobs
from threadloom.sources import corpus as src
from threadloom.sources.tables import read_table

RULES = [
    ("german", "text", [r"(sch|lich).*(keit|ung)"]),
    ("french", "text", [r"eau.*tion", r"(éo|èr).*(ment|elle)"]),
    ("spanish", "text", [r"ción"]),
    ("with source", "both", [r"src1\z"]),
    ("english", "text", [r"\bthe\b"]),
]


def docs(spark, d):
    return read_table(spark, d, "documents").select("doc_id", "text")


def headed(spark, d):
    lines = F.transform(
        F.split("text", "\n", -1),
        lambda x, i: F.when(i % 5 == 0, F.concat(F.repeat(F.lit("#"), 1 + (F.floor(i / 5) % 3).cast("int")), F.lit(" "), x)).otherwise(x),
    )
    return read_table(spark, d, "documents").select("doc_id", "source", F.array_join(lines, "\n").alias("text"))


def _grep_context(s, d):
    out = ops.grep_context(docs(s, d), "THAT")
    return out.select("doc_id", "line_no", "content", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"))


def _range_table(s, d):
    labels = read_table(s, d, "labels")
    pairs = F.array(
        F.struct((F.lit(1) + F.col("quality")).alias("start"), (F.lit(3) + F.col("toxic")).alias("end")),
        F.struct((F.lit(5) + F.col("toxic")).alias("start"), F.lit(1000).alias("end")),
    )
    return labels.select("doc_id", F.inline(pairs))


def _corpus_tree(s, d):
    tree = sections.corpus_tree(headed(s, d), "source")
    shown = F.array_join(F.transform("main_sections", lambda x: F.concat(x["level"].cast("string"), F.lit(":"), x["title"])), "|")
    return tree.withColumn("main_sections", shown)


def _outline(s, d):
    lines = src.explode_lines(headed(s, d))
    level = F.when(F.col("line").startswith("#"), F.length(F.regexp_extract("line", "^(#+)", 1)))
    blocks = lines.select("doc_id", "line_no", level.cast("bigint").alias("level"))
    return sections.outline(blocks)


def _offload(s, d, side):
    return state.offload_large(docs(s, d), "text")[side]


def _manifest(s, d):
    known = src.with_hash(docs(s, d).join(read_table(s, d, "labels").filter("quality = 1").select("doc_id"), "doc_id"))
    return known.select("doc_id", "content_hash")


def _union_sources(s, d):
    all_docs = read_table(s, d, "documents")
    path = F.concat_ws("/", "source", "lang")
    en = all_docs.filter("lang = 'en'").select(path.alias("path"))
    named = all_docs.filter("source = 'src1'").select(path.alias("path"))
    return src.union_sources(en, named)


def _missing_sources(s, d):
    all_docs = read_table(s, d, "documents")
    path = F.concat_ws("/", "source", "lang")
    return src.missing_sources(all_docs.select(path.alias("path")), _union_sources(s, d))


def _sentences(s, d):
    from threadloom.functions.text import sentences

    return docs(s, d).select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence")).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "sentence"
    )


QUERIES = {
    "explode_lines": lambda s, d: src.explode_lines(docs(s, d)),
    "explode_lines_no_trailing": lambda s, d: src.explode_lines(docs(s, d), keep_trailing=False),
    "grep": lambda s, d: ops.grep(docs(s, d), r"(tion|keit)\.$"),
    "find_text": lambda s, d: ops.find_text(docs(s, d), "THE of"),
    "search_many": lambda s, d: ops.search_many(docs(s, d), ["the of", "DER", "que la"]),
    "grep_context": _grep_context,
    "match_counts": lambda s, d: ops.match_counts(ops.find_text(docs(s, d), "tion")),
    "matching_files": lambda s, d: ops.matching_files(ops.find_text(docs(s, d), "tion")),
    "top_matches": lambda s, d: ops.top_matches(ops.grep(docs(s, d), "tion"))[0],
    "match_total": lambda s, d: ops.top_matches(ops.grep(docs(s, d), "tion"))[1],
    "line_range": lambda s, d: ops.line_range(docs(s, d), 2, 6)[0].select("doc_id", "line_no", "line"),
    "line_range_errors": lambda s, d: ops.line_range(docs(s, d), 2, 6)[1].select("doc_id", "error"),
    "read_ranges": lambda s, d: ops.read_ranges(docs(s, d), _range_table(s, d))[0],
    "read_ranges_errors": lambda s, d: ops.read_ranges(docs(s, d), _range_table(s, d))[1].select("doc_id", "start", "end"),
    "page": lambda s, d: ops.page(docs(s, d), 3, 4)[0],
    "page_errors": lambda s, d: ops.page(docs(s, d), 3, 4)[1],
    "line_stats": lambda s, d: ops.line_stats(headed(s, d)),
    "replace_text": lambda s, d: ops.replace_text(docs(s, d), "tion", "TION", replace_all=True)[0],
    "replace_text_errors": lambda s, d: ops.replace_text(docs(s, d), "the of", "x")[1],
    "content_hash": lambda s, d: ops.content_hash(docs(s, d)),
    "duplicate_groups": lambda s, d: ops.duplicate_groups(docs(s, d)),
    "first_per_group": lambda s, d: ops.first_per_group(src.explode_lines(docs(s, d)), ["doc_id"], [F.col("line_no")], 3),
    "first_per_source": lambda s, d: ops.first_per_group(
        read_table(s, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 4),
    "extract_concepts": lambda s, d: ops.extract_concepts(docs(s, d)),
    "concept_counts": lambda s, d: ops.concept_counts(ops.extract_concepts(docs(s, d))),
    "drop_boilerplate": lambda s, d: ops.drop_boilerplate(_sentences(s, d), ["The ", "über", "que la"]),
    "section_ranges": lambda s, d: sections.section_ranges(headed(s, d)),
    "section_counts": lambda s, d: sections.section_counts(headed(s, d)),
    "entry_counts": lambda s, d: sections.entry_counts(headed(s, d), ["# The", "## ", "### A"]),
    "extract_section": lambda s, d: sections.extract_section(headed(s, d), "The."),
    "corpus_tree": _corpus_tree,
    "folder_totals": lambda s, d: sections.folder_totals(sections.corpus_tree(headed(s, d), "source"), "source"),
    "outline": _outline,
    "sorted_listing": lambda s, d: src.sorted_listing(read_table(s, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id"),
    "union_sources": _union_sources,
    "missing_sources": _missing_sources,
    "offload_large": lambda s, d: _offload(s, d, 0),
    "offload_large_side": lambda s, d: _offload(s, d, 1),
    "skip_unchanged": lambda s, d: src.skip_unchanged(docs(s, d), _manifest(s, d), "doc_id").select("doc_id", "content_hash"),
    "describe": lambda s, d: text_jobs.describe(read_table(s, d, "documents").select("doc_id", "text", "source"), title="source"),
    "label_topics": lambda s, d: text_jobs.label_topics(
        read_table(s, d, "documents").select("doc_id", "text", "source"), RULES, title="source"),
    "set_members": lambda s, d: similarity.set_members(docs(s, d)),
    "jaccard_pairs": lambda s, d: similarity.jaccard_pairs(docs(s, d), 0.5),
}

_LINES = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no,
  len(string_split(text, chr(10))) AS n_lines FROM {source})"""
L = _LINES.format(source="documents")
_HEADED = """headed AS (SELECT doc_id, source, array_to_string(list_transform(string_split(text, chr(10)),
  lambda x, i: CASE WHEN (i - 1) % 5 = 0 THEN repeat('#', CAST(1 + ((i - 1) // 5) % 3 AS BIGINT)) || ' ' || x ELSE x END), chr(10)) AS text FROM documents)"""
H = f"{_HEADED}, {_LINES.format(source='headed')}"


def _strip(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


_READ = "(SELECT *, n_lines - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END AS total FROM lines JOIN {0} USING (doc_id))"
_HEADS = f"""tot AS (SELECT doc_id, source, octet_length(encode(text)) AS size_bytes, len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END AS total FROM headed),
heads AS (SELECT l.doc_id, l.line_no, length(regexp_extract(line, '^(#+)', 1)) AS level, {_strip("regexp_replace(line, '^#+', '')")} AS title
  FROM lines l JOIN tot USING (doc_id) WHERE line LIKE '#%' AND l.line_no <= total)"""
_RANGES = "rg AS (SELECT doc_id, 1 + quality AS start, 3 + toxic AS \"end\" FROM labels UNION ALL SELECT doc_id, 5 + toxic, 1000 FROM labels)"
_B = "(?:^|[^\\p{L}\\p{N}_])"
_CONCEPTS = f"""
doubled AS (SELECT doc_id, regexp_replace(text, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g') AS t FROM documents),
ph AS (SELECT doc_id, list_transform(regexp_extract_all(t, '(?:^|[^\\p{{L}}\\p{{N}}_])([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)(?:$|[^\\p{{L}}\\p{{N}}_])', 1),
  lambda x: regexp_replace(x, '(\\s)\\s', '\\1', 'g')) AS p FROM doubled),
ws AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents),
w1 AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM ws),
w2 AS (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w1),
both_kinds AS (
  SELECT doc_id, 0 AS kind, unnest(p) AS concept, generate_subscripts(p, 1) AS i FROM ph
  UNION ALL SELECT doc_id, 1, regexp_replace(word, '^[.,;:()\\[\\]{{}}]+|[.,;:()\\[\\]{{}}]+$', '', 'g'), i FROM w2
  WHERE before IS NOT NULL AND NOT regexp_matches(before, '[.!?]$') AND regexp_matches(word, '^\\p{{Lu}}') AND length(word) > 2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, i) - 1 AS pos FROM both_kinds),
concepts AS (SELECT doc_id, lower(concept) AS folded, arg_min(concept, pos) AS concept, min(pos) AS pos FROM numbered GROUP BY doc_id, lower(concept))
"""
# a cut after the end mark instead of before the white space: RE2 has no look-behind
_SENT = """s0 AS (SELECT doc_id, source, string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM documents),
sent AS (SELECT doc_id, source, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos FROM s0)"""
_SETS = """ws AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '\\S+'))) AS w FROM documents),
rep AS (SELECT min(doc_id) AS id, w, len(w) AS n FROM ws GROUP BY w)"""

_ACTIONS = "|".join(text_jobs.ACTION_WORDS)
_KEYS = "|".join(text_jobs.KEY_PHRASES)
_FURNITURE = " OR ".join(f"contains(lower(sentence), '{p}')" for p in text_jobs.BOILERPLATE)

SQL = {
    "explode_lines": f"WITH {L} SELECT * FROM lines",
    "explode_lines_no_trailing": f"""WITH {L}, t AS (SELECT l.doc_id, line, line_no, n_lines - CASE WHEN ends_with(d.text, chr(10)) OR d.text = '' THEN 1 ELSE 0 END AS n_lines FROM lines l JOIN documents d USING (doc_id))
SELECT doc_id, line, line_no, n_lines FROM t WHERE line_no <= n_lines""",
    "grep": f"WITH {L} SELECT doc_id, line_no, {_strip('line')} AS content FROM lines WHERE regexp_matches(line, '(?i)(tion|keit)\\.$')",
    "find_text": f"WITH {L} SELECT doc_id, line_no, {_strip('line')} AS content FROM lines WHERE contains(lower(line), 'the of')",
    "search_many": f"WITH {L}, q(query) AS (VALUES ('the of'), ('DER'), ('que la')) SELECT doc_id, line_no, {_strip('line')} AS content, query FROM lines, q WHERE contains(lower(line), lower(query))",
    "grep_context": f"""WITH {L}, t AS (SELECT doc_id, line_no, line, {_strip('line')} AS content FROM lines),
c AS (SELECT *, coalesce(string_agg(content, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(content, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after FROM t)
SELECT doc_id, line_no, content, before, after FROM c WHERE contains(lower(line), 'that')""",
    "match_counts": f"WITH {L} SELECT doc_id, count(*) AS matches FROM lines WHERE contains(lower(line), 'tion') GROUP BY ROLLUP (doc_id)",
    "matching_files": f"WITH {L} SELECT DISTINCT doc_id FROM lines WHERE contains(lower(line), 'tion')",
    "top_matches": f"WITH {L} SELECT doc_id, line_no, {_strip('line')} AS content FROM lines WHERE regexp_matches(line, '(?i)tion') ORDER BY doc_id, line_no LIMIT 100",
    "match_total": f"WITH {L} SELECT count(*) AS matches_count FROM lines WHERE regexp_matches(line, '(?i)tion')",
    "line_range": f"WITH {L} SELECT doc_id, line_no, line FROM lines WHERE line_no BETWEEN 2 AND 6",
    "line_range_errors": "SELECT doc_id, 'start line 2 is after line ' || len(string_split(text, chr(10))) AS error FROM documents WHERE len(string_split(text, chr(10))) < 2",
    "read_ranges": f'WITH {L}, {_RANGES} SELECT doc_id, start, "end", line_no, line FROM lines JOIN rg USING (doc_id) WHERE line_no BETWEEN start AND "end"',
    "read_ranges_errors": f'WITH {_RANGES} SELECT doc_id, start, "end" FROM documents JOIN rg USING (doc_id) WHERE start > len(string_split(text, chr(10)))',
    "page": f"""WITH {L}, t AS (SELECT l.*, n_lines - CASE WHEN ends_with(d.text, chr(10)) OR d.text = '' THEN 1 ELSE 0 END AS total FROM lines l JOIN documents d USING (doc_id))
SELECT doc_id, total AS total_lines, CAST(4 AS BIGINT) AS start_line, least(7, total) AS end_line, string_agg(lpad(CAST(line_no AS VARCHAR), 6, ' ') || '|' || line, chr(10) ORDER BY line_no) AS content
FROM t WHERE line_no BETWEEN 4 AND least(7, total) GROUP BY doc_id, total""",
    "page_errors": "SELECT doc_id, len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) OR text = '' THEN 1 ELSE 0 END AS total_lines FROM documents WHERE total_lines <= 3",
    "line_stats": f"""WITH {H}, t AS (SELECT doc_id, {_strip('line')} AS x FROM lines)
SELECT doc_id, count(*) AS total_lines, count(*) FILTER (x = '') AS empty_lines, count(*) FILTER (x <> '') AS non_empty_lines,
  count(*) FILTER (x LIKE '#%') AS header_lines, count(*) FILTER (x <> '' AND x NOT LIKE '#%') AS content_lines FROM t GROUP BY doc_id""",
    "replace_text": "SELECT doc_id, replace(text, 'tion', 'TION') AS text, len(string_split(text, 'tion')) - 1 AS occurrences FROM documents WHERE contains(text, 'tion')",
    "replace_text_errors": "SELECT doc_id, len(string_split(text, 'the of')) - 1 AS occurrences, CASE WHEN occurrences = 0 THEN 'not found' ELSE 'ambiguous' END AS error FROM documents WHERE occurrences <> 1",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "duplicate_groups": "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1",
    "first_per_group": f"WITH {L} SELECT * FROM lines WHERE line_no <= 3",
    "first_per_source": "SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 4",
    "extract_concepts": f"WITH {_CONCEPTS} SELECT doc_id, folded, concept, pos FROM concepts",
    "concept_counts": f"WITH {_CONCEPTS} SELECT folded, count(*) AS texts FROM concepts GROUP BY folded",
    "drop_boilerplate": f"WITH {_SENT} SELECT doc_id, pos, sentence FROM sent WHERE sentence <> '' AND NOT (contains(lower(sentence), 'the ') OR contains(lower(sentence), 'über') OR contains(lower(sentence), 'que la'))",
    "section_ranges": f"""WITH {H}, {_HEADS}, r AS (SELECT doc_id, line_no AS start_line, coalesce(lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) - 1, total) AS end_line, level, title FROM heads JOIN tot USING (doc_id))
SELECT *, end_line - start_line + 1 AS section_size FROM r""",
    "section_counts": f"WITH {H}, {_HEADS} SELECT t.doc_id, count(*) FILTER (level = 1) AS h1, count(*) FILTER (level = 2) AS h2, count(level) AS total FROM tot t LEFT JOIN heads USING (doc_id) GROUP BY t.doc_id",
    "entry_counts": f"WITH {H}, p(prefix) AS (VALUES ('# The'), ('## '), ('### A')) SELECT doc_id, prefix, count(*) FILTER (starts_with(line, prefix)) AS entries FROM lines, p GROUP BY doc_id, prefix",
    "extract_section": f"""WITH {H}, s AS (SELECT * FROM lines WHERE starts_with(line, '## ')),
f AS (SELECT doc_id, min(line_no) AS a FROM s WHERE regexp_replace(line, '\\s+$', '') = '## The.' GROUP BY doc_id),
e AS (SELECT f.doc_id, a, min(s.line_no) AS b FROM f LEFT JOIN s ON s.doc_id = f.doc_id AND s.line_no > a GROUP BY f.doc_id, a),
t AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY line_no) AS body FROM lines l JOIN e USING (doc_id) WHERE line_no > a AND (b IS NULL OR line_no < b) GROUP BY l.doc_id),
n AS (SELECT doc_id, string_agg(substr(line, 4), ', ' ORDER BY line_no) AS names FROM s GROUP BY doc_id)
SELECT h.doc_id, a IS NOT NULL AS found, CASE WHEN a IS NOT NULL THEN {_strip("coalesce(body, '')")} END AS body, CASE WHEN a IS NULL THEN coalesce(names, '') END AS available
FROM headed h LEFT JOIN e USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "corpus_tree": f"""WITH {H}, {_HEADS}, m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM heads WHERE level <= 2),
g AS (SELECT doc_id, string_agg(level || ':' || title, '|' ORDER BY line_no) AS s FROM m WHERE k <= 5 GROUP BY doc_id)
SELECT source, doc_id, total AS lines, CAST(size_bytes AS BIGINT) AS size_bytes, coalesce(s, '') AS main_sections FROM tot LEFT JOIN g USING (doc_id)""",
    "folder_totals": f"WITH {H}, {_HEADS} SELECT source, count(*) AS files, CAST(sum(total) AS BIGINT) AS lines, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM tot GROUP BY source",
    "outline": f"""WITH {H}, b AS (SELECT doc_id, line_no, CASE WHEN line LIKE '#%' THEN length(regexp_extract(line, '^(#+)', 1)) END AS level FROM lines)
SELECT b.doc_id, b.line_no, b.level, max(h.line_no) AS parent_line FROM b LEFT JOIN b h ON h.doc_id = b.doc_id AND h.line_no < b.line_no AND h.level < coalesce(b.level, 7) GROUP BY ALL""",
    "sorted_listing": "SELECT source, doc_id, n_chars FROM documents ORDER BY source, doc_id",
    "union_sources": "SELECT DISTINCT source || '/' || lang AS path FROM documents WHERE lang = 'en' OR source = 'src1'",
    "missing_sources": "SELECT DISTINCT source || '/' || lang AS path FROM documents WHERE lang <> 'en' AND source <> 'src1'",
    "offload_large": "SELECT doc_id, CASE WHEN length(text) <= 500 THEN text END AS text, CASE WHEN length(text) > 500 THEN 'a_' || substr(sha256(text), 1, 8) END AS artifact, CASE WHEN length(text) > 500 THEN sha256(text) END AS content_hash FROM documents",
    "offload_large_side": "SELECT DISTINCT 'a_' || substr(sha256(text), 1, 8) AS name, sha256(text) AS content_hash, text AS value FROM documents WHERE length(text) > 500",
    "skip_unchanged": "SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "describe": f"""WITH {_SENT}, c AS (SELECT *, regexp_matches(sentence, '(?i){_B}({_ACTIONS})(?:$|[^\\p{{L}}\\p{{N}}_])') AS act, regexp_matches(sentence, '(?i){_B}({_KEYS})') AS keyed
  FROM sent WHERE sentence <> '' AND NOT ({_FURNITURE})),
p AS (SELECT *, CASE WHEN bool_or(act) OVER w THEN act WHEN bool_or(keyed) OVER w THEN keyed ELSE true END AS chosen FROM c WINDOW w AS (PARTITION BY doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM p WHERE chosen),
g AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS s FROM k WHERE n <= 2 GROUP BY doc_id)
SELECT doc_id, coalesce(s, source) AS description FROM documents LEFT JOIN g USING (doc_id)""",
    "label_topics": """SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(sch|lich).*(keit|ung)') THEN 'german'
  WHEN regexp_matches(lower(text), 'eau.*tion|(éo|èr).*(ment|elle)') THEN 'french' WHEN contains(lower(text), 'ción') THEN 'spanish'
  WHEN source = 'src1' THEN 'with source' WHEN regexp_matches(lower(text), '(?:^|[^\\p{L}\\p{N}_])the(?:$|[^\\p{L}\\p{N}_])') THEN 'english' ELSE 'general' END AS topic FROM documents""",
    "set_members": f"WITH {_SETS} SELECT doc_id, id AS set_id FROM ws JOIN rep USING (w)",
    "jaccard_pairs": f"""WITH {_SETS}, tk AS (SELECT id, n, unnest(w) AS t FROM rep),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM tk a JOIN tk b ON a.t = b.t AND a.id < b.id GROUP BY a.id, b.id)
SELECT id_a, id_b, round(i / (na + nb - i), 3) AS similarity FROM p WHERE i * 1000 >= 500 * (na + nb - i)""",
}
