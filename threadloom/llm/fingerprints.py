"""Document fingerprints by winnowing; DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.checkpoints import stored
from threadloom.llm.common import documents

#: Words of a gram and grams of a window: any run of GRAM + WINDOW - 1 common words shares a fingerprint.
GRAM = 5
WINDOW = 16
#: Low bits of a packed value hold the reversed position, so the smallest value of a window is its rightmost minimum.
POSITION_BITS = 24


def _fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a one-element explode, so that Spark computes each once however often it is used."""
    for name, value in columns.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def fingerprint(df: DataFrame, text: str, name: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Adds array ``name`` of packed fingerprints: 39 bits of the gram's hash, 24 bits of the reversed position.

    Grams are ``gram`` words in a row of the lower-cased text; fewer words are one gram.  Of each ``window`` grams in a
    row (or all, if fewer) the smallest hash is chosen, the rightmost of equal ones.  ``position_of`` gives a value's
    gram number.  No words: an empty array.
    """
    mask = (1 << POSITION_BITS) - 1
    df = _fixed(df, _w=F.filter(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"), lambda x: x != ""))
    df = _fixed(df, _h=F.transform("_w", lambda x: F.xxhash64(x))).drop("_w")
    rest = ", ".join(f"_h[i + {j}]" for j in range(1, gram))
    grams = f"CASE WHEN size(_h) >= {gram} THEN transform(slice(_h, 1, size(_h) - {gram - 1}), (x, i) -> xxhash64(x, {rest})) " \
            "WHEN size(_h) > 0 THEN array(xxhash64(_h)) ELSE slice(_h, 1, 0) END"
    packed = f"transform({grams}, (x, i) -> shiftleft(shiftrightunsigned(x, {POSITION_BITS + 1}), {POSITION_BITS}) | ({mask}L - (cast(i as bigint) & {mask}L)))"
    df = _fixed(df, _p=F.expr(packed)).drop("_h")
    chosen = f"CASE WHEN size(_p) > {window} THEN transform(slice(_p, 1, size(_p) - {window - 1}), (x, i) -> array_min(slice(_p, i + 1, {window}))) " \
             "WHEN size(_p) > 0 THEN array(array_min(_p)) ELSE _p END"
    return _fixed(df, **{name: F.array_distinct(F.expr(chosen))}).drop("_p")


def position_of(value: Column) -> Column:
    mask = (1 << POSITION_BITS) - 1
    return F.lit(mask) - value.bitwiseAND(F.lit(mask))


def likeness(a: str, b: str) -> Column:
    """Jaccard index of the chosen hashes of two fingerprints; 1 if neither has any."""
    x, y = (F.expr(f"array_distinct(transform({c}, v -> shiftright(v, {POSITION_BITS})))") for c in (a, b))
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1)))


def neighbours(keys: DataFrame) -> DataFrame:
    """Each row's successor in descending (doc_id, th): adds next_id and next_th; the last row's is the first.

    Range partitions are numbered and written; a window works within a partition, and the first row of one takes the
    last row of the partition before it.  Only one row for each partition is ordered as a whole.
    """
    dealt = stored(keys.repartitionByRange("doc_id", "th").withColumn("part", F.spark_partition_id()), "order")
    row = F.struct("doc_id", "th")
    inside = Window.partitionBy("part").orderBy("doc_id", "th")
    ends = dealt.groupBy("part").agg(F.max(row).alias("last"))
    before = F.lag("last").over(Window.orderBy("part"))
    top = ends.agg(F.max(F.struct("part", "last")).alias("top")).select("top.last")
    ends = ends.select("part", before.alias("before")).join(F.broadcast(top), F.lit(True))
    found = dealt.withColumn("own", F.lag(row).over(inside)).join(ends, "part")
    return found.withColumn("next", F.coalesce("own", "before", "last")).select(*keys.columns, F.col("next.doc_id").alias("next_id"), F.col("next.th").alias("next_th"))


def edited_fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    Rows (doc_id, text, edited, fp, edited_fp, next_fp, n_chars).  edited: the last n_chars // 2 code points replaced
    by the first as many (or all) of the next document's, in descending doc_id; after the last row comes the first.

    Null text is empty.  Rows of one doc_id and text are one document; different texts of one id are ordered by their
    hash; a null id is the last one.  One document is its own next.  Empty tables give no rows.
    """
    texts = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    keys = texts.groupBy("doc_id", "th").agg(F.max(F.char_length("text")).alias("n"), F.count("*").alias("c"))
    keys = stored(neighbours(keys), "neighbours")
    if keys.filter("c > 1").limit(1).count():
        texts = texts.dropDuplicates(["doc_id", "th"])
    printed = fingerprint(texts, "text", "fp", gram, window)
    # a null id joins as well: an extra column keeps it apart from all numbers
    tag = lambda c: (F.coalesce(c, F.lit(0)).alias("k"), c.isNull().alias("z"))
    printed = printed.select(*tag(F.col("doc_id")), "th", "text", "fp")  # the same columns for both joins: one shuffle
    take = keys.select(*tag(F.col("next_id")), F.col("next_th").alias("th"), F.col("doc_id").alias("to"), F.col("th").alias("to_th"), F.expr("n div 2").alias("half"))
    given = printed.join(take, ["k", "z", "th"]).select(
        *tag(F.col("to")), F.col("to_th").alias("th"), F.col("half"), F.expr("substring(text, 1, cast(half as int))").alias("tail"), F.col("fp").alias("next_fp"))
    both = printed.join(given, ["k", "z", "th"]).withColumn("doc_id", F.when(~F.col("z"), F.col("k")))
    edited = F.expr("concat(substring(text, 1, cast(char_length(text) - half as int)), tail)")
    both = _fixed(both.select("doc_id", "text", "fp", "next_fp", "half", "tail"), edited=edited).drop("half", "tail")
    both = both.withColumn("n_chars", F.char_length("text").cast("long"))
    return fingerprint(both, "edited", "edited_fp", gram, window)


def as_text(fp: str) -> Column:
    """A fingerprint as text: hexadecimal packed values in order of their position."""
    return F.array_join(F.transform(fp, lambda x: F.hex(x)), " ")


def op3_winnowing(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("fp").alias("fingerprint"),
        as_text("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
    )


QUERIES = {"op3_winnowing": op3_winnowing}
SQL: dict[str, str] = {}
