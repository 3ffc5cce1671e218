"""Corpus-wide text jobs: descriptions, topics, dates, templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.text import first_date, month_label, sentences, strip

# Page furniture; a sentence with one of these phrases is not part of a description.
BOILERPLATE = ["skip to main content", "navigation", "advanced searches", "browse", "help", "contact", "examples:"]

# Words that mark a sentence as saying what a text does.
ACTION_WORDS = [
    "prohibit", "prohibits", "ban", "bans", "prevent", "prevents", "restrict", "restricts", "require", "requires",
    "authorize", "authorizes", "allow", "allows", "establish", "establishes", "provide", "provides", "amend", "amends",
    "medicaid payment",
]

# Openings of a sentence about the text itself, as regular expressions.
KEY_PHRASES = ["This bill", "The bill", "This resolution", r"H\.R\.", r"S\."]

# Fixed value: a title is cut after this many words.
TITLE_WORDS = 28

# Ordered topic rules (label, fields, patterns); patterns of one rule are alternatives.
# "text" is the description alone, "both" the description and the title.
TOPIC_RULES = [
    ("health costs", "both", [r"(health\s*care|healthcare|insurance).*(premium|cost|affordable|lower)", r"(premium|cost).*(health|insurance|affordable)", r"lower.*health.*care.*premium"]),
    ("foreign influence in education", "both", [r"(school|education|lea|educational\s+agenc).*?(foreign\s+influence|china|adversar)", r"(transparency|reporting).*?(adversar|foreign).*?(education|school|contribut)", r"(parent|notif).*?(foreign|china|adversar)"]),
    ("foreign money in schools", "text", [r"school.*?(china|foreign|communist).*?(prohibit|ban|prevent|restrict|disclose)"]),
    ("foreign funding reports", "text", [r"school.*?(disclose|report).*?(foreign|china|contribution)"]),
    ("curriculum limits", "text", [r"(prohibit|ban|restrict).*?(curriculum|teaching|teach|material)"]),
    ("school funding rules", "text", [r"school.*?(prohibit|ban|restrict).*?(fund|money|contract)", r"(prohibit|ban|restrict).*?school.*?(fund|money)"]),
    ("gender care for minors", "text", [r"(gender|transition|medicaid|medicare).*?(prohibit|ban|restrict).*(minor|youth|child|under.*age)"]),
    ("public insurance limits", "text", [r"(medicaid|medicare).*?(prohibit|ban|restrict)"]),
    ("labor rights", "text", [r"(collective\s+bargain|union|worker.*right|labor.*right|federal.*employ)"]),
    ("child protection", "text", [r"(child.*protection|child.*safety|children.*protect|genital|abuse)"]),
    ("wildlife", "text", [r"(wildlife|endangered|fish|wolf|animal|endangered.*species)"]),
    ("environmental review", "both", [r"(nepa|national\s+environmental\s+policy).*?(limit|scope|narrow|redefine|reduce)", r"limit.*?(nepa|environmental\s+review|federal\s+action)"]),
    ("pipeline review", "both", [r"(pipeline|ferc|natural\s+gas).*?(review|coordinat|deadline|interagency)", r"interagency.*?(pipeline|coordinat|review)"]),
    # two patterns that must both hold
    ("agency process", "text", [(r"(ferc|regulatory|commission|federal.*agency|environmental.*review)", r"(deadline|process|review|authorize|expedite|shorten)")]),
    ("energy", "text", [r"(electric|generation|facility|generation facility|transmission|utility)"]),
    ("mining", "text", [r"(mining|mine|hardrock|mineral|extraction|resource)"]),
    ("investment", "text", [r"(closed.*end.*fund|investment|investor|securities|exchange|business)"]),
    ("fewer regulations", "text", [r"(regulatory|red tape|regulation|deregul|simplif|burden)"]),
    ("defense", "text", [r"(military|defense|department.*defense|armed.*forces|procurement|aircraft|missile|ship)"]),
    ("immigration", "text", [r"(immigration|border|citizen|visa|refugee|asylum)"]),
    ("tax cuts", "text", [r"(reduce|cut|relief|lower).*?(tax|income)", r"(tax|income).*(reduce|cut|relief|lower)"]),
    ("tax increases", "text", [r"(increase|raise|expand).*?(tax|income)", r"(tax|income).*(increase|raise|expand)"]),
    ("appropriations", "text", [r"(appropriat|budget|allocate).*?(fund|program|agency)"]),
    ("disclosure", "text", [r"(require|mandate).*?(disclose|report|transparency|register)"]),
]

_WORD = r"\p{L}\p{N}_"


def describe(docs: DataFrame, max_sentences: int = 2, key: str = "doc_id", text: str = "text", title: str | None = None) -> DataFrame:
    """A short description per text.

    The first sentences with an action word, else with a key phrase, else any that are not page furniture,
    else the shortened title.  Works inside each row.
    """
    actions = rf"{_starts(ACTION_WORDS)}(?<![{_WORD}])({'|'.join(ACTION_WORDS)})(?![{_WORD}])"
    phrases = rf"{_starts(KEY_PHRASES)}(?<![{_WORD}])({'|'.join(KEY_PHRASES).lower()})"

    def mentions(x: Column, words: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(x["low"], F.lit(w)) for w in words])

    # each sentence is lower-cased once; plain searches come first, the expressions only run where a stem is found
    both = F.transform(sentences(F.col(text)), lambda s: F.struct(s.alias("s"), F.lower(s).alias("low")))
    cut = docs.select(key, both.alias("_all"), (F.col(title) if title else F.lit("")).alias("_title"))
    cut = cut.withColumn("_s", F.filter("_all", lambda x: ~mentions(x, BOILERPLATE)))
    cut = cut.withColumn("_acting", F.filter("_s", lambda x: mentions(x, _stems(ACTION_WORDS)) & x["low"].rlike(actions)))
    with_phrase = F.filter("_s", lambda x: x["low"].rlike(phrases))
    cut = cut.withColumn("_about", F.when(F.size("_acting") == 0, with_phrase))
    chosen = F.when(F.size("_acting") > 0, F.col("_acting")).when(F.size("_about") > 0, F.col("_about")).otherwise(F.col("_s"))
    first = F.get(sentences(F.coalesce(F.col("_title"), F.lit(""))), F.lit(0))
    words = F.split(first, r"\s+")
    short = F.when(
        F.size(words) > TITLE_WORDS, F.concat(F.array_join(F.slice(words, 1, TITLE_WORDS), " "), F.lit("..."))
    ).otherwise(first)
    picked = F.array_join(F.slice(chosen, 1, max_sentences)["s"], " ")
    return cut.select(key, F.when(F.size("_s") > 0, picked).otherwise(F.coalesce(short, F.lit(""))).alias("description"))


def _stems(words: list[str]) -> list[str]:
    """The words that are not an extension of another one."""
    return [w for w in words if not any(w != v and w.startswith(v) for v in words)]


def _starts(words: list[str]) -> str:
    """Rules out most places by their first letter before anything else is tested."""
    return f"(?=[{''.join(sorted({w[0].lower() for w in words}))}])"


def label_topics(
    docs: DataFrame, rules=None, key: str = "doc_id", text: str = "text", title: str | None = None, default: str = "general",
) -> DataFrame:
    """First matching topic rule per text, tested on lower-cased text or on text and title.

    A rule holds when one of its patterns does; a tuple of patterns holds when all of them do.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    both = F.concat_ws(" ", low, F.lower(F.coalesce(F.col(title), F.lit("")))) if title else F.concat(low, F.lit(" "))
    tested = docs.select(key, low.alias("_text"), both.alias("_both"))
    label = None
    for name, field, patterns in TOPIC_RULES if rules is None else rules:
        every = [reduce(lambda a, b: a & b, [F.col(f"_{field}").rlike(q) for q in p]) for p in patterns if isinstance(p, tuple)]
        single = [p for p in patterns if isinstance(p, str)]
        some = [F.col(f"_{field}").rlike("|".join(f"(?:{p})" for p in single))] if single else []
        hit = reduce(lambda a, b: a | b, [*some, *every])
        label = F.when(hit, F.lit(name)) if label is None else label.when(hit, F.lit(name))
    return tested.select(key, label.otherwise(F.lit(default)).alias("topic"))


def is_adequate(description: str = "description") -> Column:
    """False for a description that is empty, shorter than 10 characters, or only names and references."""
    d = F.coalesce(F.col(description), F.lit(""))
    only_names = (
        d.rlike(r"^[A-Z][a-z]+,\s+[A-Z][a-z]+\s+\[")
        & ~F.contains(F.lower(d), F.lit("this bill"))
        & ~F.lower(d).rlike("(requires|prohibits|establishes|authorizes|amends)")
    )
    return (F.length(strip(d)) >= 10) & ~only_names


def find_dates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """First date in each text and its month label."""
    return docs.select(key, first_date(F.col(text)).alias("found_date")).withColumn(
        "month", month_label(F.col("found_date"))
    )


def value_text(value: Column) -> Column:
    """A VARIANT as it is written into a text: null is empty, a text is itself, lists and maps are JSON."""
    kind, plain = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    return (
        F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.to_json(value))
        .when(kind == "BOOLEAN", F.initcap(plain))  # fixed values: True and False
        .otherwise(F.coalesce(plain, F.lit("")))
    )


def fill_templates(templates: DataFrame, params: DataFrame, key: str = "template_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(filled texts, unknown names with their line and column).

    ``{$name}`` is replaced from ``params(name, value)``; a null value becomes an empty text.  Values are texts or
    VARIANTs of any kind, of which lists and maps are written as JSON (see ``value_text``).  A template
    with a name that is unknown, or given more than once, is reported and not filled.
    """
    body = F.col(text)
    names = F.regexp_extract_all(body, F.lit(r"\{\$([A-Za-z_]\w*)\}"), F.lit(1))
    uses = templates.select(key, text, F.explode(F.array_distinct(names)).alias("name"))
    if isinstance(params.schema["value"].dataType, T.VariantType):
        params = params.select("name", value_text(F.col("value")).alias("value"))
    given = params.groupBy("name").agg(F.first("value").alias("value"), F.count(F.lit(1)).alias("_times"))
    joined = uses.join(given.select("name", "value", F.when(F.col("_times") == 1, F.lit(True)).alias("_known")), "name", "left")
    before = F.expr(f"substring({text}, 1, instr({text}, concat('{{$', name, '}}')) - 1)")
    errors = joined.filter(F.col("_known").isNull()).select(
        key, "name",
        (F.size(F.split(before, "\n", -1))).cast("bigint").alias("line"),
        (F.length(F.element_at(F.split(before, "\n", -1), -1)) + 1).cast("bigint").alias("column"),
    )
    # a template has few names, so its replacements are one small array
    values = joined.groupBy(key).agg(
        F.collect_list(F.struct("name", F.coalesce("value", F.lit("")).alias("value"))).alias("_values"),
        F.bool_and(F.coalesce("_known", F.lit(False))).alias("_complete"),
    )
    filled = templates.join(values, key, "left").filter(F.coalesce("_complete", F.lit(True)))
    pieces = F.split(body, r"(?=\{\$[A-Za-z_]\w*\})|(?<=\})", -1)
    lookup = F.map_from_entries(F.coalesce("_values", F.array().cast("array<struct<name:string,value:string>>")))
    named = lambda x: F.regexp_extract(x, r"^\{\$([A-Za-z_]\w*)\}\z", 1)
    out = F.array_join(F.transform(pieces, lambda x: F.coalesce(F.element_at(lookup, named(x)), x)), "")
    return filled.select(key, out.alias(text)), errors
