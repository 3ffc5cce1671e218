"""Captured pages to records: fields, links, tables, grouped lists, markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.batches import small_batches
from threadloom.functions.html import PARTS, read_page
from threadloom.functions.text import strip

# Texts of challenge pages that stand in for the wanted page.
CHALLENGE_TEXTS = ["Just a moment", "Verifying you are human"]

# Path part of a record address and the code it stands for.
ENTITY_CODES = {
    "house-bill": "HR",
    "senate-bill": "S",
    "house-joint-resolution": "HJRes",
    "senate-joint-resolution": "SJRes",
    "house-concurrent-resolution": "HConRes",
    "senate-concurrent-resolution": "SConRes",
    "house-resolution": "HRes",
    "senate-resolution": "SRes",
}

# Headings of grouped name lists, tested in this order.
LIST_GROUPS = ["Yea", "Nay", "Not Voting", "Present"]

#: Types of the parts of a page.
PART_TYPES = {
    "title": "string", "text": "string", "paragraphs": "array<string>", "tables": "array<struct<headers:array<string>,rows:array<array<string>>>>",
    "groups": "array<struct<heading:string,items:array<string>>>", "markdown": "string",
}


#: Pages that a task parses at a time.
PAGES_AT_A_TIME = 250


def parse_pages(pages: DataFrame, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """Read the wanted parts of each page in one pass, some pages at a time; the other page operators work on the result."""
    values = {
        "title": lambda r: r.title.strip(), "text": lambda r: "\n".join(r.texts), "paragraphs": lambda r: r.paragraphs,
        "tables": lambda r: r.tables, "groups": lambda r: r.groups, "markdown": lambda r: "\n\n".join(r.blocks),
    }

    def parse(batches):
        import pyarrow as pa

        texts = pa.list_(pa.string())
        types = {
            "title": pa.string(), "text": pa.string(), "markdown": pa.string(), "paragraphs": texts,
            "tables": pa.list_(pa.struct([("headers", texts), ("rows", pa.list_(texts))])),
            "groups": pa.list_(pa.struct([("heading", pa.string()), ("items", texts)])),
        }
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_A_TIME):
                some = batch.slice(at, PAGES_AT_A_TIME)
                found = [[] for _ in parts]
                for html in some.column("html"):
                    read = read_page(html.as_py(), parts)
                    for column, p in zip(found, parts):
                        column.append(values[p](read))
                columns = [pa.array(column, types[p]) for column, p in zip(found, parts)]
                yield pa.RecordBatch.from_arrays([some.column("page_id").cast(pa.int64()), some.column("url"), *columns], ["page_id", "url", *parts])

    small_batches(pages.sparkSession)
    schema = ", ".join(["page_id bigint", "url string", *[f"{p} {PART_TYPES[p]}" for p in parts]])
    return pages.select("page_id", "url", "html").mapInArrow(parse, schema)


def unescape(text: Column) -> Column:
    """The named character references of the basic set, and the two common quotes."""
    for name, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def page_titles(pages: DataFrame) -> DataFrame:
    """Title of each page, the address where there is none; no parser needed."""
    title = strip(unescape(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return pages.select("page_id", "url", F.when(F.length(title) > 0, title).otherwise(F.col("url")).alias("title"))


def extract_page_fields(parsed: DataFrame, paragraphs: int = 4, summary_chars: int = 2000) -> DataFrame:
    """Title, visible text, the first paragraphs, and the opening of the text."""
    return parsed.select(
        "page_id", "url", F.when(F.length("title") > 0, F.col("title")).otherwise(F.col("url")).alias("title"), "text",
        F.array_join(F.slice("paragraphs", 1, paragraphs), "\n\n").alias("summary"),
        F.substring("text", 1, summary_chars).alias("opening"),
    )


def pages_to_markdown(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", "url", "markdown", F.length("markdown").cast("bigint").alias("n_chars"))


def without_dots(url: Column) -> Column:
    """Resolve ``.`` and ``..`` parts of an address's path; ``..`` never leaves the root."""
    shape = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)(/[^?#]*)?(.*)\z"
    parts = F.split(F.regexp_extract(url, shape, 2), "/", -1)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(p == ".", acc).otherwise(F.concat(acc, F.array(p))),
    )
    folder = F.element_at(parts, -1).isin(".", "..")
    path = F.concat(F.array_join(kept, "/"), F.when(folder, F.lit("/")).otherwise(F.lit("")))
    dotted = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^?#]*/\.\.?(/|[?#]|\z)")
    return F.when(dotted, F.concat(F.regexp_extract(url, shape, 1), path, F.regexp_extract(url, shape, 3))).otherwise(url)


def absolute_url(base: Column, href: Column) -> Column:
    """Address of a link seen on a page, without dot parts."""
    bare = F.regexp_replace(base, r"[?#].*\z", "")
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*\z"), F.concat(bare, F.lit("/"))).otherwise(
        F.regexp_replace(bare, r"[^/]*\z", "")
    )
    return without_dots(
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*\z", ""), href))
        .when(href.startswith("?"), F.concat(bare, href))
        .otherwise(F.concat(folder, href))
    )


#: An attribute's value: quoted, or up to a blank; a quote that never ends is a plain character.
ATTRIBUTE_VALUE = r"""=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
#: The rest of a tag up to its end.  All parts are possessive: no recursion and no way back, however long the tag is.
TAG_REST = rf"(?:[^=>]++|{ATTRIBUTE_VALUE})*+"
#: The value of the first attribute that is called href; attributes are read one by one, so data-href is none.
HREF = rf"(?is)\A<a(?:[\s/]*+(?!href[\s=/>])(?:[^\s=>/]++(?:\s*+{ATTRIBUTE_VALUE})?+|{ATTRIBUTE_VALUE}))*+[\s/]*+href\s*+={ATTRIBUTE_VALUE[1:5]}({ATTRIBUTE_VALUE[5:]})"


def extract_links(
    pages: DataFrame, limit: int | None = None, redirect_prefix: str | None = None, redirect_parameter: str = "uddg",
) -> DataFrame:
    """Links of each page, numbered from 1: text (the address when empty) and absolute address.

    With ``redirect_prefix`` a wrapped address is taken out of its query parameter; a wrapper without it
    is skipped.  ``limit`` keeps the first links of each page.
    """
    shown = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    # an anchor without an end reaches to the next one
    anchors = F.regexp_extract_all(shown, F.lit(rf"(?is)(<a(?=[\s/>]){TAG_REST}>.*?)(?=</a\s*>|<a[\s/>]|\z)"), F.lit(1))
    def resolve(anchor: Column) -> Column:
        value = F.regexp_extract(anchor, HREF, 1)
        href = strip(unescape(F.regexp_replace(value, r"""(?s)\A"(.*)"\z|\A'(.*)'\z""", "$1$2")))
        label = strip(F.regexp_replace(unescape(F.regexp_replace(anchor, rf"(?is)<[a-z/!?](?:{TAG_REST})>", " ")), r"\s+", " "))
        target = F.when(F.length(href) > 0, href)
        if redirect_prefix is not None:
            inner = F.try_url_decode(F.regexp_extract(href, rf"[?&]{redirect_parameter}=([^&#]*)", 1))
            target = F.when(href.startswith(redirect_prefix), F.when(F.length(inner) > 0, inner)).otherwise(target)
        return F.struct(label.alias("label"), absolute_url(F.col("url"), target).alias("link"))

    # everything happens on the array of one page: no shuffle, and numbering comes from the array
    listed = pages.select("page_id", "url", F.filter(F.transform(anchors, resolve), lambda x: x["link"].isNotNull()).alias("_l"))
    kept = F.col("_l") if limit is None else F.slice("_l", 1, limit)
    out = listed.select("page_id", "url", F.posexplode(kept).alias("_i", "_x"))
    return out.select(
        "page_id", "url", (F.col("_i") + 1).cast("bigint").alias("link_no"),
        F.when(F.length("_x.label") > 0, F.col("_x.label")).otherwise(F.col("_x.link")).alias("label"),
        F.col("_x.link").alias("link"),
    )


def link_texts(links: DataFrame) -> DataFrame:
    """Distinct texts of each link address, one row per text, so a popular address stays spread out."""
    return links.groupBy("link", "label").agg(F.count(F.lit(1)).alias("uses"))


def resolve_links(pages: DataFrame, links: DataFrame, wanted: list[str]) -> DataFrame:
    """Best link of each page for each wanted name.

    A link whose text contains the name, else one whose address does, else the page address with a
    ``tab`` parameter.  Among equals the first link on the page wins.
    """
    names = F.array(*[F.lit(w.lower()) for w in wanted])
    asked = links.select("page_id", "link_no", "label", "link", F.explode(names).alias("wanted"))
    rank = F.when(F.contains(F.lower("label"), F.col("wanted")), 1).when(F.contains(F.lower("link"), F.col("wanted")), 2)
    best = asked.withColumn("rank", rank).filter("rank is not null").groupBy("page_id", "wanted").agg(
        F.min(F.struct("rank", "link_no", "link")).alias("_b")
    )
    every = pages.select("page_id", "url", F.explode(names).alias("wanted"))
    return every.join(best, ["page_id", "wanted"], "left").select(
        "page_id", "wanted", F.coalesce("_b.rank", F.lit(3)).cast("bigint").alias("rank"),
        F.coalesce("_b.link", F.concat(F.col("url"), F.lit("?tab="), F.col("wanted"))).alias("link"),
    )


def drop_blocked_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable pages, challenge pages)."""
    blocked = F.coalesce(F.contains("html", F.lit(CHALLENGE_TEXTS[0])) | F.contains("html", F.lit(CHALLENGE_TEXTS[1])), F.lit(False))
    return pages.filter(~blocked), pages.filter(blocked)


def split_errors(df: DataFrame, key: str, checks: dict[str, tuple[Column, Column]]) -> tuple[DataFrame, DataFrame]:
    """(good rows, one error row per failed record).

    ``checks`` maps an error type to (failed condition, error text); the first that fails counts, and a
    bad record never stops the others.
    """
    kind, message = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (failed, text) in reversed(checks.items()):
        bad = F.coalesce(failed, F.lit(False))
        kind, message = F.when(bad, F.lit(name)).otherwise(kind), F.when(bad, text).otherwise(message)
    tagged = df.withColumns({"_kind": kind, "_message": message})
    good = tagged.filter(F.col("_kind").isNull()).drop("_kind", "_message")
    errors = tagged.filter(F.col("_kind").isNotNull()).select(
        key, F.col("_kind").alias("error_type"), F.col("_message").alias("error_text")
    )
    return good, errors


def _keyed(headers: Column, cells: Column) -> Column:
    by_name = F.zip_with(headers, cells, lambda h, c: F.struct(h.alias("key"), c.alias("value")))
    # a repeated header keeps its last cell
    last = F.filter(by_name, lambda x, i: ~F.array_contains(F.slice(headers, i + 2, F.size(headers)), x["key"]))
    by_place = F.transform(cells, lambda c, i: F.struct(i.cast("string").alias("key"), c.alias("value")))
    named = (F.size(headers) > 0) & (F.size(headers) == F.size(cells))
    return F.map_from_entries(F.when(named, last).otherwise(by_place))


def extract_tables(parsed: DataFrame) -> DataFrame:
    """Table rows keyed by header when the counts match, else by position."""
    tables = parsed.select("page_id", F.posexplode("tables").alias("table_no", "_t"))
    rows = tables.select("page_id", "table_no", F.col("_t.headers").alias("headers"), F.posexplode("_t.rows").alias("row_no", "_c"))
    return rows.select("page_id", "table_no", "row_no", "headers", _keyed(F.col("headers"), F.col("_c")).alias("cells"))


def with_members(parsed: DataFrame) -> DataFrame:
    """Add ``members``, array<struct<representative, party, state, vote>>, to parsed pages.

    The rows are those of the first table about representatives, states and votes, else of the first table;
    columns are found by name, then by position.
    """
    has = lambda t, word: F.exists(t["headers"], lambda h: F.contains(F.lower(h), F.lit(word)))
    fitting = F.get(F.filter("tables", lambda t: has(t, "representative") & has(t, "vote") & has(t, "state")), F.lit(0))
    chosen = parsed.withColumn("_t", F.coalesce(fitting, F.get("tables", F.lit(0))))
    keyed = chosen.withColumn("_m", F.transform("_t.rows", lambda c: _keyed(F.col("_t.headers"), c)))

    def cell(values: Column, name: str, place: int) -> Column:
        tries = [F.try_element_at(values, F.lit(k)) for k in (name, name.lower(), str(place))]
        return F.coalesce(*[F.nullif(v, F.lit("")) for v in tries], F.lit(""))

    names = ["Representative", "Party", "State", "Vote"]
    members = F.transform("_m", lambda m: F.struct(*[cell(m, n, i).alias(n.lower()) for i, n in enumerate(names)]))
    return keyed.withColumn("members", members).drop("_t", "_m")


def locate_member_rows(parsed: DataFrame) -> DataFrame:
    """Representative, party, state and vote of the rows of each page's member table."""
    rows = with_members(parsed).select("page_id", F.posexplode("members").alias("row_no", "_m"))
    return rows.select("page_id", "row_no", "_m.representative", "_m.party", "_m.state", "_m.vote")


def extract_grouped_lists(parsed: DataFrame) -> DataFrame:
    """Names listed under Yea, Nay, Not Voting and Present headings; the first matching group counts."""
    rows = parsed.select("page_id", F.posexplode("groups").alias("_g", "_x"))
    low = F.lower("_x.heading")
    group = F.coalesce(*[F.when(F.contains(low, F.lit(g.lower())), F.lit(g)) for g in LIST_GROUPS])
    names = rows.select("page_id", "_g", group.alias("group"), F.posexplode("_x.items").alias("_i", "name"))
    return names.filter(F.col("group").isNotNull()).select(
        "page_id", "group", F.struct("_g", "_i").alias("position"), "name"
    )


def reported_count(group: int, text: str = "text") -> Column:
    """The yea (1) or nay (2) total a text states, null without one."""
    found = F.regexp_extract(text, r"(?is)Yea[:\s]+(\d+).*?Nay[:\s]+(\d+)", group)
    return F.when(found != "", found).cast("bigint")


def parse_reported_counts(pages: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """Totals each page states in its text."""
    return pages.select(key, reported_count(1, text).alias("yea"), reported_count(2, text).alias("nay"))


def reconcile(reported: DataFrame, counted: DataFrame, key: str = "page_id") -> DataFrame:
    """Stated totals next to counted ones; null totals cannot be compared."""
    return reported.join(counted, key, "left").withColumn(
        "agrees", (F.col("yea") == F.coalesce("votes_for", F.lit(0))) & (F.col("nay") == F.coalesce("votes_against", F.lit(0)))
    )


def entity_code(url: Column) -> Column:
    """Code such as HR498 from a record address, null when it is none of the known kinds."""
    kinds = "|".join(ENTITY_CODES)
    kind = F.lower(F.regexp_extract(url, rf"(?i)/({kinds})/(\d+)", 1))
    number = F.regexp_extract(url, rf"(?i)/({kinds})/(\d+)", 2)
    code = F.coalesce(*[F.when(kind == name, F.lit(short)) for name, short in ENTITY_CODES.items()])
    return F.concat(code, number)
