"""Corpus search and reports.

Everything that needs only one text works inside its row on arrays of lines, so these jobs have no
shuffle; only matches leave the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from threadloom.functions.text import numbered_lines, split_lines, strip

# Fixed value: a report shows at most this many matches.
REPORT_LIMIT = 100
# Fixed value: a call in backticks, with or without an assignment before it.
CALL_PATTERN = r"(?s)`(?:.*\W*=\W*)?([A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)*\(.*?\))`"


def _lines_where(docs: DataFrame, key: str, text: str, test) -> DataFrame:
    hits = F.filter(numbered_lines(F.col(text)), lambda x: test(x["line"]))
    return docs.select(key, F.inline(hits)).select(key, "line_no", strip(F.col("line")).alias("content"))


def grep(
    docs: DataFrame, pattern: str, ignore_case: bool = True, max_bytes: int | None = None,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Lines that match a regular expression, trimmed; with ``max_bytes``, ``too_large`` reports the texts left out."""
    if max_bytes is not None:
        docs = docs.filter(F.octet_length(text) <= max_bytes)
    full = f"(?i){pattern}" if ignore_case else pattern
    return _lines_where(docs, key, text, lambda line: line.rlike(full))


def too_large(docs: DataFrame, max_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts that ``grep`` with ``max_bytes`` leaves out, as errors."""
    size = F.octet_length(text)
    return docs.filter(size > max_bytes).select(key, F.lit("too large").alias("error"), size.alias("size"))


def find_text(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines containing a text, upper and lower case alike.  Texts without it are dropped before splitting."""
    needle = F.lower(F.lit(query))
    some = docs.filter(F.contains(F.lower(F.col(text)), needle))
    return _lines_where(some, key, text, lambda line: F.contains(F.lower(line), needle))


def search_many(docs: DataFrame, queries: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One pass over the lines for many texts; one row per match and query."""
    wanted = F.array(*[F.lit(q) for q in queries])
    lines = docs.select(key, F.inline(numbered_lines(F.col(text))))
    hit = F.filter(wanted, lambda q: F.contains(F.lower(F.col("line")), F.lower(q)))
    return lines.select(key, "line_no", strip(F.col("line")).alias("content"), F.explode(hit).alias("query"))


def grep_context(docs: DataFrame, query: str, context: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each matching line with the trimmed lines around it, clipped at the ends of the text."""
    some = docs.filter(F.contains(F.lower(F.col(text)), F.lower(F.lit(query))))
    lines = some.select(key, F.split(F.col(text), "\n", -1).alias("_l"))
    rows = F.filter(
        F.transform(F.col("_l"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("line"))),
        lambda x: F.contains(F.lower(x["line"]), F.lower(F.lit(query))),
    )
    matched = lines.select(key, "_l", F.inline(rows))
    n = F.col("n")
    trimmed = lambda part: F.transform(part, strip)
    start = F.greatest(F.lit(1), n - context)
    return matched.select(
        key, n.cast("bigint").alias("line_no"), strip(F.col("line")).alias("content"),
        trimmed(F.slice("_l", start, n - start)).alias("before"),
        trimmed(F.slice("_l", n + 1, F.lit(context))).alias("after"),
    )


def match_counts(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """Matches per text and, with a null key, in total."""
    return matches.rollup(key).agg(F.count(F.lit(1)).alias("matches"))


def matching_files(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    return matches.select(key).distinct()


def top_matches(matches: DataFrame, k: int = REPORT_LIMIT, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(first k matches by text and line, total number of matches)."""
    return matches.orderBy(key, "line_no").limit(k), matches.agg(F.count(F.lit(1)).alias("matches_count"))


def line_range(
    docs: DataFrame, start: int, end: int, key: str = "doc_id", text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(lines of an inclusive 1-based range clamped to the text, texts that are too short)."""
    ranges = docs.withColumns({"start": F.lit(start), "end": F.lit(end)})
    return _ranges(ranges, key, text)


def read_ranges(docs: DataFrame, ranges: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lines of many (start, end) ranges per text, ranges that begin after the end of the text).

    The range is cut out of the line array of its row, so no line is compared with any range.
    """
    return _ranges(docs.select(key, text).join(ranges.select(key, "start", "end"), key), key, text)


def _ranges(joined: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    sized = joined.select(key, "start", "end", numbered_lines(F.col(text)).alias("_l")).withColumn("n_lines", F.size("_l"))
    low = F.greatest(F.lit(1), F.col("start")).cast("int")
    high = F.least(F.col("n_lines"), F.col("end")).cast("int")
    inside = sized.filter((low <= F.col("n_lines")) & (low <= high))
    rows = inside.select(key, "start", "end", F.inline(F.slice("_l", low, high - low + 1)))
    errors = sized.filter(low > F.col("n_lines")).select(
        key, "start", "end", F.concat(F.lit("start line "), F.col("start").cast("string"), F.lit(" is after line "),
                                      F.col("n_lines").cast("string")).alias("error"),
    )
    return rows, errors


def page(docs: DataFrame, offset: int = 0, limit: int = 500, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(numbered lines of one page per text, texts shorter than the offset)."""
    lines = docs.select(key, split_lines(F.col(text), keep_trailing=False).alias("_l")).withColumn("total_lines", F.size("_l"))
    shown = F.transform(
        F.slice("_l", offset + 1, limit), lambda x, i: F.format_string("%6d|%s", i + (offset + 1), x)
    )
    fits = lines.filter(F.col("total_lines") > offset)
    pages = fits.select(
        key, F.col("total_lines").cast("bigint").alias("total_lines"), F.lit(offset + 1).cast("bigint").alias("start_line"),
        F.least(F.lit(offset + limit), "total_lines").cast("bigint").alias("end_line"),
        F.array_join(shown, "\n").alias("content"),
    )
    errors = lines.filter(F.col("total_lines") <= offset).select(key, F.col("total_lines").cast("bigint").alias("total_lines"))
    return pages, errors


def line_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Total, empty, non-empty, header and content lines per text."""
    lines = docs.select(key, F.transform(F.split(F.col(text), "\n", -1), strip).alias("_l"))
    total = F.size("_l").cast("bigint")
    empty = F.size(F.filter("_l", lambda x: F.length(x) == 0)).cast("bigint")
    header = F.size(F.filter("_l", lambda x: x.startswith("#"))).cast("bigint")
    return lines.select(
        key, total.alias("total_lines"), empty.alias("empty_lines"), (total - empty).alias("non_empty_lines"),
        header.alias("header_lines"), (total - empty - header).alias("content_lines"),
    )


def replace_text(
    docs: DataFrame, old: str, new: str, replace_all: bool = False, key: str = "doc_id", text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(texts after a literal replacement with its count, texts where it is absent or ambiguous)."""
    body = F.col(text)
    without = F.replace(body, F.lit(old), F.lit(""))
    counted = docs.withColumn("occurrences", ((F.length(body) - F.length(without)) / F.lit(len(old))).cast("bigint"))
    fine = F.col("occurrences") >= 1 if replace_all else F.col("occurrences") == 1
    done = counted.filter(fine).select(key, F.replace(body, F.lit(old), F.lit(new)).alias(text), "occurrences")
    failed = counted.filter(~fine).select(
        key, "occurrences", F.when(F.col("occurrences") == 0, F.lit("not found")).otherwise(F.lit("ambiguous")).alias("error")
    )
    return done, failed


def content_hash(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.sha2(F.col(text), 256).alias("content_hash"))


def duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts that occur more than once: hash, copies and the first key.  Only counts leave a task."""
    return content_hash(docs, key, text).groupBy("content_hash").agg(
        F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_id")
    ).filter(F.col("copies") > 1)


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per group; Spark keeps only k rows per group and task before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= k).drop("_rn")


def extract_concepts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Concepts of each text in the order found: capitalised phrases, then capitalised words inside sentences.

    The first spelling of a concept counts, whatever its case.
    """
    body = F.col(text)
    phrases = F.regexp_extract_all(
        body, F.lit(r"(?<![\p{L}\p{N}_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)(?![\p{L}\p{N}_])"), F.lit(1)
    )
    cut = docs.select(key, phrases.alias("_p"), F.regexp_extract_all(body, F.lit(r"(\S+)"), F.lit(1)).alias("_w"))
    pairs = F.filter(
        F.arrays_zip(
            F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0))).alias("word"),
            F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))).alias("before"),
        ),
        lambda x: (F.length(x["word"]) > 2) & x["word"].rlike(r"^\p{Lu}")
        & ~(x["before"].endswith(".") | x["before"].endswith("!") | x["before"].endswith("?")),
    )
    words = F.transform(pairs, lambda x: F.regexp_replace(x["word"], r"^[.,;:()\[\]{}]+|[.,;:()\[\]{}]+\z", ""))
    found = cut.select(key, F.posexplode(F.concat("_p", words)).alias("pos", "concept"))
    first = found.groupBy(key, F.lower("concept").alias("folded")).agg(
        F.min("pos").cast("bigint").alias("pos"), F.min_by("concept", "pos").alias("concept")
    )
    return first.select(key, "folded", "concept", "pos")


def concept_counts(concepts: DataFrame) -> DataFrame:
    """Number of texts per concept."""
    return concepts.groupBy("folded").agg(F.count(F.lit(1)).alias("texts"))


def symbol_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``$name`` references and backticked calls per text with the number of uses."""
    names = F.regexp_extract_all(F.col(text), F.lit(r"\$([a-zA-Z_][a-zA-Z0-9_]*)"), F.lit(1))
    calls = F.regexp_extract_all(F.col(text), F.lit(CALL_PATTERN), F.lit(1))
    tagged = F.concat(
        F.transform(names, lambda x: F.struct(F.lit("variable").alias("kind"), x.alias("symbol"))),
        F.transform(calls, lambda x: F.struct(F.lit("call").alias("kind"), x.alias("symbol"))),
    )
    return docs.select(key, F.inline(tagged)).groupBy(key, "kind", "symbol").agg(F.count(F.lit(1)).alias("uses"))


def drop_boilerplate(sentences: DataFrame, phrases: list[str], column: str = "sentence") -> DataFrame:
    """Drop sentences that contain any of the phrases."""
    hit = F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.lower(F.col(column)), F.lower(p)))
    return sentences.filter(~hit)
