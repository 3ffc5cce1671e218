"""Column expressions for text; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Drop white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1)))


def split_lines(text: Column, keep_trailing: bool = True) -> Column:
    """Lines of a text.  Without ``keep_trailing`` a final line break does not open another line."""
    lines = F.split(text, "\n", -1)
    if keep_trailing:
        return lines
    size = F.size(lines)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, size - 1)).otherwise(lines)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a one-element explode: Spark computes each once, however often later columns use it."""
    for name, value in columns.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def numbered_lines(text: Column) -> Column:
    """array<struct<line_no bigint, line string>>, 1-based."""
    return F.transform(
        F.split(text, "\n", -1),
        lambda x, i: F.struct((i + 1).cast("bigint").alias("line_no"), x.alias("line")),
    )


def sentences(text: Column) -> Column:
    """White space collapsed, cut after ``.``, ``!`` or ``?``; empty pieces dropped."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.filter(F.split(flat, r"(?<=[.!?])\s+"), lambda s: F.length(s) > 0)


def shorten(text: Column, width: int, placeholder: str = "...") -> Column:
    keep = width - len(placeholder)
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, keep), F.lit(placeholder)))


def shorten_words(text: Column, max_length: int = 100, placeholder: str = "...") -> Column:
    """Cut at a word end; a result shorter than ten characters plus the placeholder becomes empty."""
    flat = F.array_join(F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1)), " ")
    room = max_length - len(placeholder)
    head = F.rtrim(F.regexp_extract(flat, rf"^(.{{0,{room}}})(?=\s|\z)", 1))
    cut = F.when(F.length(flat) <= max_length, flat).otherwise(F.concat(head, F.lit(placeholder)))
    return (
        F.when(F.length(text) <= max_length, text)
        .when(F.length(cut) < 10 + len(placeholder), F.lit(""))
        .otherwise(cut)
    )


def is_camel_case(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^\p{Lu}[\p{L}\p{N}]*\z"), F.lit(False))


def to_camel_case(name: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(name, r"[_\-]", " "), r"\s+"), lambda w: F.length(w) > 0)
    joined = F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), ""
    )
    return F.when(is_camel_case(name) | (F.size(words) == 0), name).otherwise(joined)


def indent(text: Column, size: int = 4, char: str = " ") -> Column:
    pad = F.lit(char * size)
    lines = F.transform(
        F.split(text, "\n", -1), lambda l: F.when(F.length(strip(l)) > 0, F.concat(pad, l)).otherwise(l)
    )
    return F.array_join(lines, "\n")


def human_bytes(size: Column) -> Column:
    value = size.cast("double")
    expr = F.lit(None).cast("string")
    for power, unit in reversed(list(enumerate(["B", "KB", "MB", "GB"]))):
        scaled = value / F.lit(float(1024 ** power))
        expr = F.when(scaled < 1024, F.concat(F.format_string("%.1f", F.bround(scaled, 1)), F.lit(f" {unit}"))).otherwise(
            expr if power < 3 else F.concat(F.format_string("%.1f", F.bround(value / F.lit(float(1024 ** 4)), 1)), F.lit(" TB"))
        )
    return expr


def preview(text: Column, limit: int = 400, edge: int = 180) -> Column:
    """First and last part of a long value with its length."""
    n = F.length(text)
    long = F.concat(
        F.substring(text, 1, edge), F.lit(" ... "), text.substr(n - (edge - 1), F.lit(edge)),
        F.lit(" (length: "), n.cast("string"), F.lit(")"),
    )
    return F.when(n > limit, long).otherwise(text)


def strip_shebang(text: Column) -> Column:
    return F.regexp_replace(text, r"\A#![^\n]*\n?", "")


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_-]", "_")


def month_label(day: Column) -> Column:
    """A date as ``Jan2025``; text dates are read as MM/DD/YYYY and give null when they are not one."""
    return F.date_format(day, "MMMyyyy")


def first_date(text: Column) -> Column:
    """First MM/DD/YYYY in a text, else the first ``Month DD, YYYY``, as a date."""
    numeric = F.regexp_extract(text, r"\b(\d{1,2}/\d{1,2}/\d{4})\b", 1)
    worded = F.regexp_extract(
        text,
        r"\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4})\b",
        1,
    )
    tidy = F.regexp_replace(F.regexp_replace(worded, ",", ""), r"\s+", " ")
    return F.when(F.length(numeric) > 0, F.to_date(F.try_to_timestamp(numeric, F.lit("M/d/yyyy")))).when(
        F.length(worded) > 0, F.to_date(F.try_to_timestamp(tidy, F.lit("MMMM d yyyy")))
    )


def parse_entity(spec: Column) -> Column:
    """``agent X``, ``meeting X`` or bare ``X`` as struct(kind, id); ``user`` is an alias of ``human``.

    An empty specification gives kind ``error``.
    """
    s = strip(F.coalesce(spec, F.lit("")))
    kind = F.regexp_extract(s, r"^(agent|meeting)\s+", 1)
    rest = strip(F.regexp_replace(s, r"^(agent|meeting)\s+", ""))
    human = F.lower(rest).isin("human", "user")
    return F.struct(
        F.when((F.length(rest) == 0) | s.isin("agent", "meeting"), F.lit("error")).when(F.length(kind) > 0, kind)
        .otherwise(F.lit("agent")).alias("kind"),
        F.when(human & (kind != "meeting"), F.lit("human")).otherwise(rest).alias("id"),
    )


def minutes_in_bed(bedtime: Column, out_of_bed: Column) -> Column:
    """Minutes between two clock texts such as ``10:30 PM``; an earlier end is on the next day."""
    clock = lambda c: F.try_to_timestamp(c, F.lit("h:mm a"))
    minutes = (F.unix_seconds(clock(out_of_bed)) - F.unix_seconds(clock(bedtime))) / 60
    return F.when(minutes < 0, minutes + 24 * 60).otherwise(minutes)


def sleep_efficiency(in_bed: Column, awake: Column) -> Column:
    """Percent of the minutes in bed spent asleep."""
    return F.when(in_bed != 0, F.round((in_bed - awake) * 100 / in_bed, 1))


def meeting_tag(message_type: Column, meeting_id: Column) -> Column:
    return F.coalesce(
        F.when(message_type == "meeting_invitation", F.concat(F.lit(" [MEETING_INVITATION for meeting "), meeting_id, F.lit("]")))
        .when(message_type == "meeting_broadcast", F.concat(F.lit(" [in meeting "), meeting_id, F.lit("]"))),
        F.lit(""),
    )
