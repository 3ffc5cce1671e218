"""Trie of conversation prefixes, summed by depth bands."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.checkpoints import stored, tidy

#: Depths of a band: a node is added to so many ancestors at most in one round.
BAND = 16
#: Turns of one conversation that a window reads at once.
BLOCK = 4096
#: A key with more than this share of all rows is joined by broadcast: there are fewer than HEAVY of them.
HEAVY = 1000
#: Ids joined to one piece of text before a digest reads them.
IDS = 4096
#: Conversations of so many ids in a row share first turns.
GROUP = 20
WORDS = r"[^\x20\x09-\x0D]+"


def attach(rows: DataFrame, traits: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` with the columns of ``traits`` (one row for each key; ``size`` is the number of rows of the key).

    Keys with more than 1 / HEAVY of all rows, fewer than HEAVY by definition, are joined by broadcast where their rows
    are; all others by a shuffle, in which no key is large.
    """
    total = traits.agg(F.sum(size)).first()[0] or 0
    heavy = F.broadcast(traits.filter(F.col(size) > total / HEAVY))
    light = rows.join(heavy.select(*keys), keys, "left_anti").join(traits.filter(F.col(size) <= total / HEAVY), keys)
    return rows.join(heavy, keys).unionByName(light)


def shared_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string")) % 4


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, place, a, b, words): turns numbered from 0 by (turn, nulls first; ties: content hash).

    All turns are sorted by range, so a conversation of any size lies in as many tasks as it needs; numbers count
    inside a task, and what earlier tasks hold of its first conversation is added from one row for each task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(1), text, role).alias("b"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b"), F.col("row")]

    def number(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, first, last, count, waiting = TaskContext.get().partitionId(), None, None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id").to_numpy()
            first = ids[0] if first is None else first
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
            if ids[0] == last:
                place[: starts[1] if len(starts) > 1 else len(ids)] += count
            last, count = ids[-1], place[-1] + 1
            if waiting is not None:
                yield waiting
            flag = np.zeros(len(ids), bool)
            waiting = pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "a", "b", "words")), pa.array(place), pa.array(np.full(len(ids), task, np.int32)), pa.array(ids == first), pa.array(flag)],
                ["conv_id", "a", "b", "words", "place", "task", "open", "tail"])
        if waiting is not None:
            flag = np.zeros(waiting.num_rows, bool)
            flag[-1] = True
            yield waiting.set_column(7, "tail", pa.array(flag))

    schema = "conv_id long, a long, b long, words long, place long, task int, open boolean, tail boolean"
    sorted_turns = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(sorted_turns.mapInArrow(number, schema), "turns")
    tails = rows.filter("tail").select("task", "conv_id", F.lit(1).alias("kind"), (F.col("place") + 1).alias("n"))
    heads = rows.filter("open and place = 0").select("task", "conv_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("task", "kind").rowsBetween(Window.unboundedPreceding, -1))
    carried = heads.unionAll(tails).withColumn("carried", before).filter("kind = 0 and carried > 0").select("task", "conv_id", "carried")
    rows = rows.join(F.broadcast(carried), ["task", "conv_id"], "left")  # one row a task at most
    return rows.select("conv_id", (F.col("place") + F.coalesce("carried", F.lit(0))).alias("place"), "a", "b", "words")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: rows (conv_id, depth, a, b, words, last) and one row (conv_id, size) for each conversation.

    A conversation c takes its first h = crc32(c) % 4 turns from conversation c - c % GROUP (all of them, if it has
    fewer) and then follows with its own turns after the first h.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = stored(convs.select("conv_id", "n", shared_turns(F.col("conv_id")).alias("h"), F.expr(f"conv_id - conv_id % {GROUP}").alias("base")), "conversations")
    bases = convs.filter(f"conv_id % {GROUP} = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = stored(convs.select("conv_id", "base", "n", "h", "m", F.expr("m + greatest(0, n - h)").alias("size")), "conversations")
    own = attach(turns.filter(F.col("place") >= shared_turns(F.col("conv_id"))), convs.select("conv_id", "n", "h", "m", "size"), ["conv_id"], "n")
    own = own.select("conv_id", F.expr("place - h + m + 1").alias("depth"), "a", "b", "words", "size")
    first = turns.filter(f"conv_id % {GROUP} = 0 and place < 3").withColumnRenamed("conv_id", "base")
    first = first.join(convs.select("conv_id", "base", "h", "size"), "base").filter("place < h")
    first = first.select("conv_id", (F.col("place") + 1).alias("depth"), "a", "b", "words", "size")
    rows = own.unionByName(first).withColumn("last", F.expr("depth = size")).drop("size")
    return rows, convs.select("conv_id", "size")


def prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, a, b, words, last) from depth 0 on; (a, b) identifies the sequence of turns up to there.

    The hash of a turn depends on its depth, and a prefix is their running xor: inside blocks of a conversation, and
    over one row for each block.
    """
    turn = rows.select("conv_id", "depth", F.xxhash64("depth", "a").alias("a"), F.xxhash64("depth", "b").alias("b"), "words", "last", F.expr(f"(depth - 1) div {BLOCK}").alias("block"))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth")
    turn = turn.select("conv_id", "depth", "block", F.bit_xor("a").over(inside).alias("a"), F.bit_xor("b").over(inside).alias("b"), "words", "last")
    turn = stored(turn, "prefixes")
    ends = turn.filter(f"depth % {BLOCK} = 0").select("conv_id", (F.col("block") + 1).alias("block"), F.col("a").alias("x"), F.col("b").alias("y"))
    before = Window.partitionBy("conv_id").orderBy("block")
    ends = ends.select("conv_id", "block", F.bit_xor("x").over(before).alias("x"), F.bit_xor("y").over(before).alias("y"))
    columns = ["conv_id", "depth", "a", "b", "words", "last"]
    later = turn.filter("block > 0").join(ends, ["conv_id", "block"]).withColumn("a", F.expr("a ^ x")).withColumn("b", F.expr("b ^ y"))
    root = convs.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in columns[1:5]], F.expr("size = 0").alias("last"))
    return turn.filter("block = 0").select(*columns).unionAll(later.select(*columns)).unionAll(root)


def end_digests(ends: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, ends_sha256) of rows (conv_id, depth, end): SHA-256 of the ends, ascending, joined by commas.

    Ids are sorted by range and joined to pieces in many tasks; only the digest of a node, which is sequential by
    nature, reads its pieces in one, as a stream.
    """
    order = ["conv_id", "depth", "end"]

    def pieces(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            conv, depth, end = (batch.column(c).to_numpy() for c in order)
            cut = np.flatnonzero(np.r_[True, (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1])])
            starts = np.concatenate([np.arange(a, b, IDS) for a, b in zip(cut, [*cut[1:], len(conv)])])
            text = [",".join(map(str, end[a:b].tolist())) for a, b in zip(starts, [*starts[1:], len(conv)])]
            yield pa.RecordBatch.from_arrays([pa.array(conv[starts]), pa.array(depth[starts]), pa.array(end[starts]), pa.array(text, pa.string())], [*order, "ids"])

    def digest(batches):
        import pyarrow as pa

        at, sha = None, None
        for batch in batches:
            done = []
            for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids"))):
                if at != (conv, depth):
                    if at is not None:
                        done.append((*at, sha.hexdigest()))
                    at, sha = (conv, depth), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "depth", "ends_sha256"), d)) for d in done], schema)
        if at is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": at[0], "depth": at[1], "ends_sha256": sha.hexdigest()}], schema)

    import pyarrow as pa

    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    parts = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "conv_id long, depth long, end long, ids string")
    dealt = parts.repartition("conv_id", "depth").sortWithinPartitions(*order)
    return dealt.mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def subtree_sums(members: DataFrame, own: DataFrame, values: list[str], band: int = BAND) -> DataFrame:
    """Rows (conv_id, depth, *values): the sums of ``own`` over each node's subtree.

    ``members`` has (conv_id, depth, rep): the node (rep, depth) on the way of conversation ``conv_id``; ``own`` has a
    node's values.  Upwards, a node is added to its ancestors inside its band of ``band`` depths only; the roots of
    bands, with the sums of their bands, form a smaller tree of the same kind, and so on until one band is left.
    Downwards, a band root's complete sum is added to its ancestors in the band above.  Rounds grow with the logarithm
    of the depth to the base ``band``, and no row becomes more than ``band`` rows in one.
    """
    deepest = members.agg(F.max("depth")).first()[0] or 0
    sums = [F.sum(v).cast("long").alias(v) for v in values]
    ways, partial, unit = [], [], 1
    while True:
        level = members.filter(F.col("depth") % unit == 0).groupBy("conv_id", F.expr(f"depth div {unit * band}").alias("band"))
        ways.append(stored(level.agg(F.collect_list(F.struct("depth", "rep")).alias("way")), "ways"))  # band entries at most
        above = own.withColumn("band", F.expr(f"depth div {unit * band}")).join(ways[-1], ["conv_id", "band"])
        above = above.select("depth", *values, F.explode("way").alias("to")).filter("to.depth <= depth")
        partial.append(stored(above.groupBy(F.col("to.rep").alias("conv_id"), F.col("to.depth").alias("depth")).agg(*sums), "band-sums"))
        if unit * band > deepest:
            break
        unit *= band
        own = partial[-1].filter(F.col("depth") % unit == 0)
    whole = partial.pop()
    while partial:
        roots = whole.filter("depth > 0").withColumn("band", F.expr(f"depth div {unit} - 1")).join(ways[len(partial) - 1], ["conv_id", "band"])
        down = roots.select(*values, F.explode("way").alias("to")).select(F.col("to.rep").alias("conv_id"), F.col("to.depth").alias("depth"), *values)
        whole = stored(partial.pop().unionByName(down).groupBy("conv_id", "depth").agg(*sums), "band-sums")
        unit //= band
    return whole


@tidy
def trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations (see ``rebuilt_turns``).

    conv_id (smallest member) and depth name a node; parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, (n_convs - 1) times the words of the last text) and ends_sha256 describe it.

    Turns are ordered by turn, nulls first, rows of one turn by a hash of their content.  A null role or text is empty;
    repeated rows are turns of their own; a row without conv_id belongs to no conversation and is left out; c % GROUP
    has the sign of c.  Other columns are ignored.  An empty table gives no rows.
    """
    rows, convs = rebuilt_turns(numbered_turns(conversations))
    path = stored(prefixes(rows, convs), "prefixes")
    nodes = path.groupBy("depth", "a", "b").agg(
        F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("last").alias("leaf"))
    nodes = stored(nodes, "nodes")
    members = attach(path.select("conv_id", "depth", "a", "b", "last"), nodes, ["depth", "a", "b"], "n_convs")
    members = stored(members.select("conv_id", "depth", "rep", "last"), "members")
    own = nodes.select(F.col("rep").alias("conv_id"), "depth", "n_convs", F.expr("int(leaf)").cast("long").alias("n_leaves"), F.expr("(n_convs - 1) * words").alias("saved_tokens"))
    sums = subtree_sums(members, own.drop("n_convs"), ["n_leaves", "saved_tokens"], band)
    parents = members.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent_conv_id"))
    key = ["conv_id", "depth"]
    tree = stored(own.select(*key, "n_convs").join(parents, key, "left"), "nodes")
    children = tree.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    ends = end_digests(members.filter("last").select(F.col("rep").alias("conv_id"), "depth", F.col("conv_id").alias("end")))
    return tree.join(sums, key).join(children, key, "left").join(ends, key, "left").select(
        *key, "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: crc32 of the decimal id: each byte is followed by eight shifts.
_CRC = (
    "xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: "
    "[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda v, s: "
    "CASE WHEN s >= 0 THEN xor(v, s) ELSE xor(v >> 1, 3988292384 * (v & 1)) END), 4294967295)"
)

SQL = {"op12_prefix_trie": f"""
    WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place FROM conversations WHERE conv_id IS NOT NULL),
         c AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
         r AS (SELECT c.conv_id, 0 AS part, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.place < c.h
               UNION ALL SELECT c.conv_id, 1, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.place >= c.h),
         d AS (SELECT conv_id, row_number() OVER w AS depth, list({{'role': role, 'text': text}}) OVER w AS way,
                      len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)
               UNION ALL SELECT conv_id, 0, [], 0 FROM c),
         m AS MATERIALIZED (SELECT conv_id, depth, words, min(conv_id) OVER (PARTITION BY depth, way) AS rep, count(*) OVER (PARTITION BY depth, way) AS n,
                      depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM d),
         k AS (SELECT rep, depth, any_value(n) AS n, any_value(words) AS words, bool_and(last) AS leaf,
                      sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (last), '')) AS ends FROM m GROUP BY rep, depth),
         s AS (SELECT a.rep, a.depth, sum(k.leaf::INT)::BIGINT AS leaves, sum((k.n - 1) * k.words)::BIGINT AS saved
               FROM k JOIN m a ON a.conv_id = k.rep AND a.depth <= k.depth GROUP BY a.rep, a.depth),
         p AS (SELECT k.*, m.rep AS parent FROM k LEFT JOIN m ON m.conv_id = k.rep AND m.depth = k.depth - 1),
         f AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM p WHERE parent IS NOT NULL GROUP BY ALL)
    SELECT p.rep AS conv_id, p.depth, p.parent AS parent_conv_id, p.n AS n_convs, coalesce(f.n, 0) AS n_children, s.leaves AS n_leaves,
           s.saved AS saved_tokens, p.ends AS ends_sha256
    FROM p JOIN s ON s.rep = p.rep AND s.depth = p.depth LEFT JOIN f ON f.parent = p.rep AND f.depth = p.depth"""}
QUERIES = {"op12_prefix_trie": op12_prefix_trie}
