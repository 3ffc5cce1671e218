"""Markdown structure of texts: sections, outlines, blocks, front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.ordered import Running, running
from threadloom.functions.text import numbered_lines, once, split_lines, strip


def headings(lines: Column) -> Column:
    """Headings in an array of lines: array<struct<line_no, level, title>>."""
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).cast("bigint").alias("line_no"), x.alias("line")))
    return F.transform(
        F.filter(numbered, lambda x: x["line"].startswith("#")),
        lambda x: F.struct(
            x["line_no"].alias("line_no"),
            F.length(F.regexp_extract(x["line"], "^(#+)", 1)).cast("bigint").alias("level"),
            strip(F.regexp_replace(x["line"], "^#+", "")).alias("title"),
        ),
    )


def _with_headings(docs: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    lines = docs.select(key, *keep, split_lines(F.col(text), keep_trailing=False).alias("_l"))
    return lines.withColumn("_h", headings(F.col("_l")))


def section_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sections with their line range: to the line before the next heading, or to the end."""
    h = _with_headings(docs, key, text)
    ends = F.concat(
        F.transform(F.slice("_h", 2, F.greatest(F.size("_h"), F.lit(1))), lambda x: x["line_no"] - 1),
        F.array(F.size("_l").cast("bigint")),
    )
    rows = F.zip_with("_h", F.slice(ends, F.lit(1), F.size("_h")), lambda a, e: F.struct(
        a["line_no"].alias("start_line"), e.alias("end_line"), a["level"].alias("level"), a["title"].alias("title"),
        (e - a["line_no"] + 1).alias("section_size"),
    ))
    return h.select(key, F.inline(rows))


def section_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Level-1, level-2 and all sections per text."""
    h = _with_headings(docs, key, text)
    at = lambda n: F.size(F.filter("_h", lambda x: x["level"] == n)).cast("bigint")
    return h.select(key, at(1).alias("h1"), at(2).alias("h2"), F.size("_h").cast("bigint").alias("total"))


def entry_counts(docs: DataFrame, prefixes: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Number of lines per text that begin with each prefix, such as ``### Concept:``."""
    lines = docs.select(key, F.split(F.col(text), "\n", -1).alias("_l"))
    rows = F.transform(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.struct(
        p.alias("prefix"), F.size(F.filter("_l", lambda x: F.startswith(x, p))).cast("bigint").alias("entries"),
    ))
    return lines.select(key, F.inline(rows))


def corpus_tree(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", top: int = 5) -> DataFrame:
    """One row per file: folder, lines, size and the first level-1 and level-2 headings."""
    h = _with_headings(docs, key, text, folder, text)
    main = F.slice(F.filter("_h", lambda x: x["level"] <= 2), 1, top)
    return h.select(
        folder, key, F.size("_l").cast("bigint").alias("lines"), F.octet_length(text).cast("bigint").alias("size_bytes"),
        main.alias("main_sections"),
    )


def folder_totals(tree: DataFrame, folder: str) -> DataFrame:
    return tree.groupBy(folder).agg(
        F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.sum("size_bytes").alias("size_bytes")
    )


def extract_section(docs: DataFrame, title: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Body of the first level-2 section of that title; texts without it list the sections they have."""
    lines = docs.select(key, F.split(F.col(text), "\n", -1).alias("_l"))
    second = F.filter(
        F.transform("_l", lambda x, i: F.struct((i + 1).alias("n"), x.alias("line"))), lambda x: x["line"].startswith("## ")
    )
    found = lines.select(key, "_l", second.alias("_s"))
    wanted = F.filter("_s", lambda x: F.regexp_replace(x["line"], r"\s+\z", "") == f"## {title}")
    start = F.get(wanted, F.lit(0))["n"]
    following = F.get(F.filter("_s", lambda x: x["n"] > start), F.lit(0))["n"]
    stop = F.coalesce(following - 1, F.size("_l"))
    body = strip(F.array_join(F.slice("_l", start + 1, F.greatest(stop - start, F.lit(0))), "\n"))
    titles = F.array_join(F.transform("_s", lambda x: F.substring(x["line"], 4, 1 << 30)), ", ")
    return found.select(
        key, start.isNotNull().alias("found"), F.when(start.isNotNull(), body).alias("body"),
        F.when(start.isNull(), titles).alias("available"),
    )


def outline(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Parent heading of each block: the last earlier heading of a lower level, for other blocks the last heading.

    ``blocks(key, line_no, level)`` with null level for anything but a heading.  All blocks of a text come
    from one row, so a window per text is bounded.
    """
    levels = range(1, 7)
    last = running(
        blocks, [key], ["line_no"], None,
        **{f"_l{n}": Running("last", F.when(F.col("level") == n, F.col("line_no")), inclusive=False) for n in levels},
    )
    below = [F.when(F.coalesce("level", F.lit(7)) > n, F.col(f"_l{n}")) for n in levels]
    return last.withColumn("parent_line", F.greatest(*below)).drop(*[f"_l{n}" for n in levels])


def _line_type(line: Column) -> Column:
    """Type of a line outside of code."""
    return (
        F.when(F.length(strip(line)) == 0, F.lit("blank"))
        .when(line.rlike(r"^#{1,6}(\s|\z)"), F.lit("heading"))
        .when(line.rlike(r"^\s{0,3}([-*_])(\s*\1){2,}\s*\z"), F.lit("rule"))
        .when(line.rlike(r"^\s*([-*+]|\d+[.)])\s"), F.lit("item"))
        .when(line.rlike(r"^\s{0,3}>"), F.lit("quote"))
        .otherwise(F.lit("paragraph"))
    )


def markdown_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Typed blocks with their first line: headings, paragraphs, list items, quotes, code and rules.

    All of it is array work inside the row of a text, linear in its lines: nothing is shuffled, only blocks leave the row.
    """
    rows = once(docs.select(key, F.col(text).alias("_text")), _lines=numbered_lines(F.coalesce("_text", F.lit("")))).drop("_text")
    # fences cut a text into parts that are code and parts that are not, in turn; a fence is the first line of its part
    rows = once(rows, _fences=F.filter("_lines", lambda x: x["line"].rlike(r"^\s{0,3}(```|~~~)")))

    def part(start: Column, stop: Column, code: Column, fence: bool) -> Column:
        own = F.slice("_lines", start.cast("int"), F.greatest(stop - start, F.lit(0)).cast("int"))
        return F.transform(own, lambda x, i: F.struct(
            x["line_no"].alias("line_no"), x["line"].alias("line"), (F.lit(fence) & (i == 0)).alias("fence"),
            F.when(code | (F.lit(fence) & (i == 0)), F.lit("code")).otherwise(_line_type(x["line"])).alias("type"), (code & (i == 0)).alias("begins")))

    end = F.size("_lines").cast("bigint") + 1
    after = lambda i: F.coalesce(F.get("_fences", i)["line_no"], end)
    first = part(F.lit(1).cast("bigint"), after(F.lit(0)), F.lit(False), False)
    rest = F.transform("_fences", lambda f, i: part(f["line_no"], after(i + 1), i % 2 == 0, True))
    rows = once(rows, _typed=F.concat(first, F.flatten(rest))).drop("_lines", "_fences")

    def opens(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get("_typed", i - 1)["type"])
        # an indented or plain line right after a list item continues it
        continued = (x["type"] == "paragraph") & (before == "item")
        return (
            F.when(x["type"] == "code", x["begins"]).when(x["type"].isin("heading", "rule", "item", "blank"), F.lit(True))
            .otherwise(~F.coalesce(x["type"] == before, F.lit(False)) & ~F.coalesce(continued, F.lit(False)))
        )

    rows = once(rows, _opens=F.transform(F.filter("_typed", opens), lambda x: x["line_no"]))
    until = lambda i: F.coalesce(F.get("_opens", i + 1), F.size("_typed").cast("bigint") + 1)
    own = F.transform("_opens", lambda o, i: F.slice("_typed", o.cast("int"), (until(i) - o).cast("int")))
    rows = rows.select(key, F.explode(own).alias("_b")).filter(F.col("_b")[0]["type"] != "blank")
    kind = lambda x: x["type"]
    shown = lambda x: (
        F.when(kind(x) == "heading", strip(F.regexp_replace(x["line"], r"^#+|\s#+\s*\z", "")))
        .when(kind(x) == "quote", F.regexp_replace(x["line"], r"^\s{0,3}>\s?", ""))
        .when(kind(x) == "item", F.regexp_replace(x["line"], r"^\s*([-*+]|\d+[.)])\s+", ""))
        .when(kind(x) == "paragraph", strip(x["line"]))
        .when(x["fence"], F.lit(None))
        .otherwise(x["line"])
    )
    head = F.col("_b")[0]
    return rows.select(
        key, head["line_no"].alias("line_no"), head["type"].alias("type"),
        F.when(head["type"] == "heading", F.length(F.regexp_extract(head["line"], "^(#+)", 1))).cast("bigint").alias("level"),
        F.array_join(F.transform("_b", shown), "\n").alias("text"),
    )


def front_matter(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Flat keys of a leading ``metadata:`` block and the text after the ``---`` that ends it.

    A text without the block is all description; nested keys are not read; of a repeated key the last value counts.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    has = body.startswith("metadata:")
    parts = F.split(body, "---", 2)
    pairs = F.transform(
        F.filter(F.split(F.regexp_replace(parts[0], r"^metadata:", ""), "\n", -1), lambda x: x.rlike(r"^\s+[\w-]+\s*:")),
        lambda x: F.struct(
            F.regexp_extract(x, r"^\s*([\w-]+)\s*:", 1).alias("key"), strip(F.regexp_replace(x, r"^\s*[\w-]+\s*:", "")).alias("value")
        ),
    )
    found = pairs
    later = lambda x, i: F.exists(F.slice(found, i + 2, F.greatest(F.size(found), F.lit(1))), lambda y: y["key"] == x["key"])
    pairs = F.filter(found, lambda x, i: ~later(x, i))
    return docs.select(
        key, F.when(has, F.map_from_entries(pairs)).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"),
        strip(F.when(has, F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).otherwise(body)).alias("description"),
    )


def split_by_keyword(
    docs: DataFrame, key: str = "doc_id", text: str = "text", keywords: tuple[str, ...] = ("Pros", "Cons"),
) -> DataFrame:
    """Items under keyword lines (such as Pros / Cons), one row per item.

    Bullets are items.  A line longer than 20 characters counts only while its list is still empty.
    """
    word = lambda x: F.coalesce(*[F.when(x.rlike(rf"(?i)^{k}(?![\p{{L}}\p{{N}}_])"), F.lit(k)) for k in keywords])
    bullet = lambda x: x.rlike(r"^[-\u2022]\s+")
    plain = F.transform(numbered_lines(F.col(text)), lambda x: F.struct(x["line_no"].alias("line_no"), strip(x["line"]).alias("line")))
    rows = once(docs.select(key, F.coalesce(plain, F.array().cast("array<struct<line_no: bigint, line: string>>")).alias("_p")), _lines=F.col("_p")).drop("_p")
    opened = F.transform("_lines", lambda x: F.struct(word(x["line"]).alias("section"), x["line_no"].alias("line_no")))
    rows = once(rows, _open=F.filter(opened, lambda x: x["section"].isNotNull()))

    def part(o: Column, i: Column) -> Column:
        """The lines below a keyword that may be items."""
        stop = F.coalesce(F.get("_open", i + 1)["line_no"], F.size("_lines").cast("bigint") + 1)
        own = F.slice("_lines", (o["line_no"] + 1).cast("int"), (stop - o["line_no"] - 1).cast("int"))
        return F.struct(o["section"].alias("section"), F.filter(own, lambda x: bullet(x["line"]) | (F.length(x["line"]) > 20)).alias("lines"))

    rows = once(rows, _parts=F.filter(F.transform("_open", part), lambda p: F.size(p["lines"]) > 0)).drop("_lines", "_open")
    # a keyword may come again: its list is empty only in the first part with lines
    fresh = lambda p, i: ~F.exists(F.slice("_parts", 1, i), lambda q: q["section"] == p["section"])
    items = lambda p, i: F.filter(
        F.transform(p["lines"], lambda x, j: F.struct(
            p["section"].alias("section"), x["line_no"].alias("line_no"), x["line"].alias("line"), ((j == 0) & fresh(p, i)).alias("first"))),
        lambda x: bullet(x["line"]) | x["first"])
    found = rows.select(key, F.inline(F.flatten(F.transform("_parts", items))))
    return found.select(key, "section", "line_no", F.regexp_replace("line", r"^[-\u2022]\s+", "").alias("item"))
