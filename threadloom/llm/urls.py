"""URL filters: rules, host word segmentation and naive Bayes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.checkpoints import stored

#: Rules (verdict, host, path); a rule fits its host and all subdomains, if the path starts with the rule's.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Longest word of a segmentation, in letters.
LONGEST_WORD = 16
SMOOTHING = 1.0


def parsed(pages: DataFrame) -> DataFrame:
    """Adds host and path of url; null or no ``://``: both empty."""
    rest = F.when(F.col("url").contains("://"), F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    pages = pages.withColumn("_rest", F.coalesce(rest, F.lit("")))
    host = F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)).drop("_rest")


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds rule (``host`` + ``path`` of the longest that fits, else null) and rule_verdict."""
    fits = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # a longer rule is asked before a shorter one
        here = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        fits = F.when(here, F.lit(host + path)).otherwise(fits)
        verdict = F.when(here, F.lit(kind)).otherwise(verdict)
    return pages.withColumn("rule", fits).withColumn("rule_verdict", verdict)


def word_counts(pages: DataFrame) -> DataFrame:
    """The unigram dictionary: rows (word, n) over lower-case letter runs of all page titles and visible texts.

    Hosts and paths are not counted, nor urls inside a text: a name that is to be split would be a known word.
    """
    hidden = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)", " ")
    text = F.regexp_replace(F.regexp_replace(hidden, r"<[^>]*>", " "), r"\S*://\S*|&[A-Za-z]+;", " ")
    runs = F.split(F.lower(text), r"[^\p{L}]+")
    return pages.select(F.explode(runs).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def segmented(names: DataFrame, counts: DataFrame, longest: int = LONGEST_WORD) -> DataFrame:
    """Rows (name, words): the most probable split of each distinct name into words (unigram Viterbi).

    Every substring of a name of at most ``longest`` letters is joined to its count; one name's substrings (a name has
    at most 63 letters in a host, longer ones are cut into pieces of 63 first by the caller) meet in one row, where the
    split is found.  A word that was never seen has chance 10 / (N * 10**length).
    """
    total = counts.agg(F.sum("n")).first()[0] or 1
    names = names.select("name").distinct()
    spots = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("at"))
    spots = spots.select("name", "at", F.explode(F.expr(f"sequence(1, least({longest}, length(name) - at + 1))")).alias("size"))
    spots = spots.withColumn("word", F.expr("substring(name, at, size)"))
    found = spots.join(counts, "word").select("name", "at", "size", "n")
    lists = names.join(found.groupBy("name").agg(F.collect_list(F.struct("at", "size", "n")).alias("known")), "name", "left")

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for name, known in zip(batch.column("name").to_pylist(), batch.column("known").to_pylist()):
                have = {(k["at"] - 1, k["size"]): k["n"] for k in known or ()}
                best = [(0.0, 0)] + [(-math.inf, 0)] * len(name)
                for end in range(1, len(name) + 1):
                    for size in range(1, min(end, longest) + 1):
                        n = have.get((end - size, size))
                        value = math.log(n / total) if n else math.log(10.0 / total) - size * math.log(10.0)
                        value += best[end - size][0]
                        if value > best[end][0]:
                            best[end] = (value, size)
                words, end = [], len(name)
                while end:
                    words.append(name[end - best[end][1]: end])
                    end -= best[end][1]
                out.append(words[::-1])
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.list_(pa.string()))], ["name", "words"])

    return lists.mapInArrow(split, "name string, words array<string>")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, counts: DataFrame | None = None) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, log_odds), one for each input row.

    Names of host and path (runs of letters; digits are one token) are split into words; a multinomial naive Bayes model
    over them is trained on the urls that a rule decides, each with its rule's verdict, and judges all others: block if
    log_odds > 0.  The last label of a host is no feature: rules of whole domains would make it a copy of themselves.

    Null urls or urls without ``://``: empty host and path, no rule, judged by the prior alone.  Without any decided
    url all verdicts of the method are allow.  Repeated rows are judged and counted each; empty tables give no rows.
    counts: rows (word, n) of a dictionary; by default that of the pages themselves, which then need html.
    """
    base = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", *(["html"] if counts is None else []))
    base = ruled(parsed(base), rules)
    counts = stored(word_counts(base) if counts is None else counts, "words")
    urls = stored(base.select("row", "page_id", "host", "path", "rule", "rule_verdict"), "urls")
    name = F.concat_ws(" ", F.regexp_replace("host", r"\.[^.]*$", ""), "path")
    # names of more than 63 letters come in pieces; each run of digits is one mark
    tokens = F.regexp_extract_all(F.lower(name), F.lit(r"\p{L}{1,63}|[0-9]+"), F.lit(0))
    tokens = urls.select("row", "rule_verdict", F.explode(F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]"), F.lit("#")).otherwise(t))).alias("name"))
    each = tokens.groupBy("row", "rule_verdict", "name").agg(F.count("*").alias("times"))
    each = stored(each, "names")
    split = stored(segmented(each.filter("name <> '#'"), counts), "segments").unionByName(
        each.sparkSession.createDataFrame([("#", ["#"])], "name string, words array<string>"))
    # words per verdict: counted by name first, so that a name of many urls is few rows
    by_name = each.filter("rule_verdict is not null").groupBy("name", "rule_verdict").agg(F.sum("times").alias("times"))
    learned = by_name.join(split, "name").select("rule_verdict", "times", F.explode("words").alias("word"))
    block = F.sum(F.when(F.col("rule_verdict") == "block", F.col("times")).otherwise(0)).alias("block")
    allow = F.sum(F.when(F.col("rule_verdict") == "allow", F.col("times")).otherwise(0)).alias("allow")
    learned = stored(learned.groupBy("word").agg(block, allow), "learned")
    vocabulary, blocked, allowed = learned.agg(F.count("*"), F.sum("block"), F.sum("allow")).first()
    urls_of = dict(urls.groupBy("rule_verdict").count().collect())  # at most three rows
    b, a = blocked or 0, allowed or 0
    room = SMOOTHING * max(vocabulary, 1)
    prior = math.log((urls_of.get("block", 0) + SMOOTHING) / (urls_of.get("allow", 0) + SMOOTHING)) if b or a else 0.0
    weight = F.log((F.col("block") + SMOOTHING) / F.lit(b + room)) - F.log((F.col("allow") + SMOOTHING) / F.lit(a + room))
    weights = learned.select("word", weight.alias("w"))
    odds = split.select("name", F.explode("words").alias("word")).join(weights, "word").groupBy("name").agg(F.sum("w").alias("w"))
    scored = each.join(odds, "name").groupBy("row").agg(F.sum(F.col("times") * F.col("w")).alias("w"))
    out = urls.join(scored, "row", "left").withColumn("log_odds", F.lit(prior) + F.coalesce("w", F.lit(0.0)))
    method = F.when(F.col("log_odds") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "log_odds")


def op5_urls(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op5_urls": op5_urls}
SQL: dict[str, str] = {}
