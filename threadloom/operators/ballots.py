"""Ballots: classes, tallies, joins of the records of one entity."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import strip

# Names of states and their codes.
STATE_CODES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO",
    "Connecticut": "CT", "Delaware": "DE", "District of Columbia": "DC", "Florida": "FL", "Georgia": "GA", "Hawaii": "HI",
    "Idaho": "ID", "Illinois": "IL", "Indiana": "IN", "Iowa": "IA", "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA",
    "Maine": "ME", "Maryland": "MD", "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN", "Mississippi": "MS",
    "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH", "New Jersey": "NJ",
    "New Mexico": "NM", "New York": "NY", "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK",
    "Oregon": "OR", "Pennsylvania": "PA", "Rhode Island": "RI", "South Carolina": "SC", "South Dakota": "SD",
    "Tennessee": "TN", "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA", "Washington": "WA",
    "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
}
NO_STATE = "--"
BUCKETS = ["for", "against", "abstained"]


def ballot_class(vote: Column) -> Column:
    """for, against or abstained; absence counts before the words for and against."""
    v = F.lower(strip(F.coalesce(vote, F.lit(""))))
    has = lambda word: F.contains(v, F.lit(word))
    return (
        F.when(has("not voting") | has("present"), F.lit("abstained"))
        .when(has("yea") | has("aye") | has("yes"), F.lit("for"))
        .when(v.rlike(r"\b(nay|no)\b"), F.lit("against"))
        .otherwise(F.lit("abstained"))
    )


def party_class(party: Column) -> Column:
    p = F.lower(F.coalesce(party, F.lit("")))
    return (
        F.when(F.contains(p, F.lit("dem")), F.lit("democrat"))
        .when(F.contains(p, F.lit("rep")) | F.contains(p, F.lit("gop")), F.lit("republican"))
        .otherwise(F.lit("other"))
    )


def state_code(state: Column) -> Column:
    """Two-letter code of a state name; an unknown name gives the first two letters of its last word."""
    s = strip(state)
    table = F.create_map(*[F.lit(x) for pair in STATE_CODES.items() for x in pair])
    words = F.filter(F.split(s, r"\s+"), lambda w: F.length(w) > 0)
    title = F.array_join(F.transform(words, lambda w: F.initcap(F.lower(w))), " ")
    return (
        F.when(F.coalesce(F.length(state), F.lit(0)) == 0, F.lit(NO_STATE))
        .when(s.rlike(r"^[A-Za-z]{2}\z"), F.upper(s))
        .otherwise(F.coalesce(
            F.try_element_at(table, s), F.try_element_at(table, title),
            F.upper(F.substring(F.try_element_at(words, F.lit(-1)), 1, 2)), F.lit(NO_STATE),
        ))
    )


def classify(votes: DataFrame) -> DataFrame:
    return votes.withColumns({
        "bucket": ballot_class(F.col("vote")), "party_class": party_class(F.col("party")), "state_code": state_code(F.col("state")),
    })


def reconcile_pages(parsed: DataFrame) -> DataFrame:
    """Totals a page states next to the votes counted in its member table, in one pass over the page."""
    from threadloom.operators.pages import reported_count, with_members

    classed = with_members(parsed).withColumn("_b", F.transform("members", lambda m: ballot_class(m["vote"])))
    counted = lambda bucket: F.size(F.filter("_b", lambda b: b == bucket)).cast("bigint")
    facts = classed.select(
        "page_id", reported_count(1).alias("yea"), reported_count(2).alias("nay"),
        counted("for").alias("votes_for"), counted("against").alias("votes_against"),
    )
    return facts.withColumn(
        "agrees", (F.col("yea") == F.col("votes_for")) & (F.col("nay") == F.col("votes_against"))
    )


def _bucket_counts() -> list[Column]:
    return [F.count_if(F.col("bucket") == b).alias(f"votes_{b}") for b in BUCKETS]


def tally(votes: DataFrame, by: list[str]) -> DataFrame:
    """Votes per bucket and group."""
    return classify(votes).groupBy(*by).agg(*_bucket_counts())


def tally_multi(votes: DataFrame, item: str, per_row: int = 10) -> DataFrame:
    """Votes per item and, with a null item, overall; rows a grid of ``per_row`` needs for the largest bucket."""
    counted = classify(votes).rollup(item).agg(*_bucket_counts())
    most = F.greatest(*[F.col(f"votes_{b}") for b in BUCKETS])
    return counted.withColumn("grid_rows", F.greatest(F.lit(1), F.ceil(most / per_row)).cast("bigint"))


def sorted_members(votes: DataFrame, id_column: str) -> DataFrame:
    """Members by bucket and state code, blank codes first."""
    code = F.upper(F.coalesce("state_code", F.lit("")))
    return classify(votes).orderBy("bucket", code, id_column)


def filter_month_and_question(votes: DataFrame, month: dt.date, phrase: str = "On Passage", date: str = "vote_date", question: str = "question") -> DataFrame:
    """Votes of one calendar month whose question contains the phrase, in its own or lower case.

    The month is a range on the stored column, so it prunes partitions and row groups.
    """
    first = month.replace(day=1)
    after = (first + dt.timedelta(days=32)).replace(day=1)
    asked = F.contains(question, F.lit(phrase)) | F.contains(question, F.lit(phrase.lower()))
    return votes.filter((F.col(date) >= F.lit(first)) & (F.col(date) < F.lit(after)) & asked)


def join_entity_records(bills: DataFrame, votes: DataFrame, analyses: DataFrame, keys=("month", "entity")) -> DataFrame:
    """Bills with their votes and, where there is one, their analysis."""
    return bills.join(votes, list(keys)).join(analyses, list(keys), "left")


def missing_entities(expected: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Expected entities without a stored record."""
    return expected.select(*keys).distinct().join(have.select(*keys), keys, "left_anti")


def files_per_entity(have: DataFrame, needed: list[str], entity: str = "entity", kind: str = "kind") -> DataFrame:
    """Entities with whether every needed file is present, and how many are."""
    present = [F.coalesce(F.bool_or(F.col(kind) == n), F.lit(False)) for n in needed]
    count = sum((p.cast("bigint") for p in present), F.lit(0).cast("bigint"))
    return have.groupBy(entity).agg(count.alias("present")).withColumn("is_complete", F.col("present") == len(needed))


def active_summary(users: DataFrame, tasks: DataFrame) -> DataFrame:
    """Totals of users and tasks, active users and completed tasks, in one row."""
    rows = users.select(F.lit(1).alias("u"), F.col("active").alias("a"), F.lit(0).alias("t"), F.lit(False).alias("c")).unionByName(
        tasks.select(F.lit(0).alias("u"), F.lit(False).alias("a"), F.lit(1).alias("t"), F.col("completed").alias("c"))
    )
    return rows.agg(
        F.sum("u").alias("users"), F.count_if("a").alias("active_users"), F.sum("t").alias("tasks"),
        F.count_if("c").alias("completed_tasks"), F.count_if((F.col("t") == 1) & ~F.col("c")).alias("open_tasks"),
    )
