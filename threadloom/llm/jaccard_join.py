"""Set similarity join with adaptive multi-match prefixes over word shingles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.checkpoints import stored, tidy
from threadloom.llm.common import bit_set, chunks, components, documents, in_bit_set, lower_ascii, mix, shingles, utf8, words

#: Buckets of the token counts that order prefixes: one byte each on every executor.
SKETCH_BITS = 24
SLICE_BITS = 16
#: Longest extension of a prefix: up to this many shared tokens are required.
MOST_MATCHES = 6
#: Longs of the bit map of a prefix, a power of two.
WORDS = 2
#: Members of one hub are spread over so many groups.
SALTS = 16


def _sets(array, size: int):
    data, offsets = utf8(array)
    hashes, _, _, bounds = words(lower_ascii(data), offsets)
    return shingles(hashes, bounds, size)


def _level(count: np.ndarray) -> np.ndarray:
    """One byte in the order of the counts: exact up to 200, then logarithmic."""
    high = 200 + 2 * np.log2(np.maximum(count, 200) / 200.0)
    return np.where(count < 200, count, np.minimum(high, 255)).astype(np.uint8)


def frequency_levels(docs: DataFrame, size: int) -> np.ndarray:
    """Levels of the corpus count of each of 2**SKETCH_BITS shingle buckets: a fixed 16 MB, whatever the corpus.

    They order tokens from rare to frequent.  Any order gives right results; this one keeps frequent tokens out of
    prefixes.  A task's own counts are sent as bytes, so one above 255 counts as 255 there.
    """
    def count(batches):
        import pyarrow as pa

        waiting, held, total = [], 0, np.zeros(1 << SKETCH_BITS, np.uint8)

        def add():
            # sorted, so that memory goes with the values that wait and not with all buckets
            found = np.sort(np.concatenate(waiting))
            first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
            slot = found[first]
            total[slot] = np.minimum(np.diff(first, append=len(found)) + total[slot], 255)

        for part in chunks(batches):
            value, _ = _sets(part.column("text"), size)
            waiting.append((value & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int32))
            held += len(value)
            if held > 1 << 22:
                add()
                waiting, held = [], 0
        if held:
            add()
        for at, piece in enumerate(total.reshape(-1, 1 << SLICE_BITS)):
            if piece.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([at], pa.int32()), "counts": pa.array([piece.tobytes()], pa.binary())})

    def add_slices(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, x in zip(batch.column("slice").to_pylist(), batch.column("counts")):
                piece = np.frombuffer(x.as_buffer(), np.uint8)
                sums[at] = sums[at] + piece if at in sums else piece.astype(np.uint64)
        level = {k: _level(v).tobytes() for k, v in sums.items()}
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(level), pa.int32()), "level": pa.array(list(level.values()), pa.binary())})

    rows = docs.select("text").mapInArrow(count, "slice int, counts binary").repartition("slice").mapInArrow(add_slices, "slice int, level binary")
    levels = np.zeros((1 << SKETCH_BITS - SLICE_BITS, 1 << SLICE_BITS), np.uint8)
    for r in rows.collect():
        levels[r.slice] = np.frombuffer(r.level, np.uint8)
    return levels.ravel()


def _profiles(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows (doc_id, n, s1, s2, prefix): set size, 128-bit set signature, first tokens of the set in the common order."""
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs, size))

    def profile(batches):
        import pyarrow as pa

        level = levels.value
        for part in chunks(batches):
            value, bounds = _sets(part.column("text"), size)
            n, sums, tokens = [], [], []
            order = np.uint64(SKETCH_BITS)
            for a, b in zip(bounds[:-1], bounds[1:]):
                own = np.unique(value[a:b])
                n.append(len(own))
                sums.append((mix(own).sum(dtype=np.uint64), mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                keep = len(own) - (percent * len(own) + 99) // 100 + MOST_MATCHES
                rank = level[own & np.uint64((1 << SKETCH_BITS) - 1)]
                tokens.append(own[np.lexsort((own >> order, rank))[:keep]].view(np.int64))
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
            sums = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                ["doc_id", "n", "s1", "s2", "prefix"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(profile, "doc_id long, n long, s1 long, s2 long, prefix array<long>")


def verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (hub, member) whose texts' shingle sets reach the threshold.

    Sets are built from whole texts again, only for documents that a fixed-size bit set lets through.  A member's set
    travels once per pair to its hub; a hub's members are dealt over ``SALTS`` groups, read as a stream.
    """
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(SALTS)).cast("int"))
    ids = pairs.select(F.col("hub").alias("id")).unionAll(pairs.select(F.col("member").alias("id")))
    bits = bit_set(ids.select(F.xxhash64("id").alias("hash")), "hash")
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def sets(batches):
        import pyarrow as pa

        for batch in batches:
            batch = batch.filter(pa.array(in_bit_set(shared.value, batch.column("hash").to_numpy())))
            for part in chunks([batch]):
                value, bounds = _sets(part.column("text"), size)
                own = [np.unique(value[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own, pa.binary())], ["doc_id", "tokens"])

    numbered = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = numbered.select("doc_id", "text", F.xxhash64("doc_id").alias("hash")).mapInArrow(sets, "doc_id long, tokens binary")
    found = found.join(ids.distinct(), found.doc_id == F.col("id"), "left_semi")
    found = stored(found, "sets")
    members = pairs.join(found, pairs.member == found.doc_id).select("hub", "salt", F.col("member"), "tokens")
    hubs = pairs.select("hub", "salt").distinct().join(found, F.col("hub") == found.doc_id)
    hubs = hubs.select("hub", "salt", F.lit(None).cast("long").alias("member"), "tokens")
    dealt = hubs.unionAll(members).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("member").asc_nulls_first())

    def test(batches):
        import pyarrow as pa

        at, own = None, []
        for batch in batches:
            good = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("hub", "salt", "member")), batch.column("tokens"))
            for hub, salt, member, tokens in rows:
                if at != (hub, salt):
                    at, own = (hub, salt), []
                have = np.frombuffer(tokens.as_buffer(), np.uint64)
                if member is None:
                    own.append(have)  # more than one only for repeated ids
                    continue
                for other in own:
                    both = len(np.intersect1d(other, have, assume_unique=True))
                    if 100 * both >= percent * (len(other) + len(have) - both):
                        good.append((hub, member))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in good], pa.int64()), pa.array([g[1] for g in good], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(test, "a long, b long")


def _prefix_bits(tokens: str, word: int) -> Column:
    """A long of the bit map of prefix tokens: each token sets one bit, by digits that neither order of tokens looks at first."""
    own = f"filter({tokens}, t -> (shiftright(t, {SKETCH_BITS + 6}) & {WORDS - 1}) = {word})"
    return F.expr(f"aggregate({own}, 0L, (a, t) -> a | shiftleft(1L, cast(shiftright(t, {SKETCH_BITS}) & 63 as int)))")


def _overlap(percent: int) -> str:
    """Shared tokens that the threshold asks of the rows x and y."""
    return f"(({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent})"


def _wanted(percent: int) -> str:
    """So many shared tokens stand in both lengthened prefixes if x and y link."""
    return f"greatest(least(x.matches, y.matches), least(x.length - x.n, y.length - y.n) + {_overlap(percent)})"


def _may_link(percent: int) -> str:
    """Whether sizes, the places of a shared token and the prefixes' bit maps allow a link of x and y; true for each link.

    A bit of one side only is a token of that side only, so it bounds the shared tokens before any pair is made.
    """
    overlap = _overlap(percent)
    only = lambda a, b: " + ".join(f"bit_count({a}.bits{k} & ~{b}.bits{k})" for k in range(WORDS))
    return (
        f"least(x.n, y.n) * 100 >= greatest(x.n, y.n) * {percent} and x.place <= x.n - {overlap} and y.place <= y.n - {overlap} "
        f"and {only('x', 'y')} <= x.length - {_wanted(percent)} and {only('y', 'x')} <= y.length - {_wanted(percent)}"
    )


@tidy
def link_components(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each input row.

    Two documents link when their sets of distinct ``size``-word shingles have a Jaccard index of at least
    ``percent`` / 100; component_id is the smallest doc_id reachable by links, itself included.

    1. Documents with one set form a class, represented by the smallest id.
    2. A document's prefix is its n - ceil(t n) + 1 rarest tokens; by the number of candidates that they would bring,
       it is lengthened by l - 1 tokens and then l shared tokens are required of a pair (the smaller l of both).
       Tokens outside the overlap that a pair's sizes ask for can only stand before so many shared ones: a pair meets
       through a shared token that stands early enough in both, and the number of shared prefix tokens that is required
       of it follows from its two sizes and is never below l.  Bit maps of both prefixes bound what they share inside
       the join, so chance pairs through one rare token, whose number grows with the square of the table, leave no row.
    3. Tokens are joined within size classes (sizes differ by the threshold at most).  First each document is tested
       against one hub per token group, over rounds; pairs within one component need no test any more.  As soon as
       what is left is linear in the tokens, or a round finds no link, all remaining pairs are counted and tested.

    No words or null text: 0 shingles, component is the own id.  Null ids: linked with nothing, component null.  Rows
    with one id are one document.  Empty tables give no rows; other columns are ignored.
    """
    profile = stored(_profiles(docs, size, percent), "profiles")
    full = profile.filter("n > 0 and doc_id is not null")
    classes = stored(full.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix")), "classes")
    need = F.expr(f"cast((n * {percent} + 99) div 100 as int)")
    classes_ = classes.withColumn("need", need).withColumn("plain", F.expr("cast(n as int) - need + 1"))
    plain = classes_.select(F.posexplode(F.expr("slice(prefix, 1, plain)")).alias("place", "token"), "rep").repartition("token")
    met = plain.join(plain.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "token")
    cost = met.groupBy("rep").agg(F.sum(F.col("df") - 1).alias("cost"))
    # four candidates for each prefix token are cheap; each four times that asks for one more match
    more = F.floor(F.log(F.greatest(F.lit(1.0), F.col("cost") / (4.0 * F.col("plain")))) / F.log(F.lit(4.0)))
    matches = F.least(F.lit(MOST_MATCHES), F.greatest(F.lit(1), F.least(F.col("need"), 1 + more))).cast("int")
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    chosen = classes_.join(cost, "rep").withColumn("matches", matches).withColumn("own", step)
    chosen = chosen.withColumn("length", F.expr("plain + matches - 1")).withColumn("tokens", F.expr("slice(prefix, 1, length)"))
    traits = chosen.select("rep", "n", "matches", "cost", "length", "own", *[_prefix_bits("tokens", k).alias(f"bits{k}") for k in range(WORDS)])
    # a pair meets at a place that the sizes allow: never in the part by which a prefix is lengthened
    rows = met.select("token", "place", "rep").join(traits, "rep").withColumn("step", F.explode(F.array("own", F.col("own") + 1)))
    rows = stored(rows, "tokens")
    prefixes = chosen.select("rep", "tokens")
    bits = [f"bits{k}" for k in range(WORDS)]
    links, tested = None, None
    found = None
    before = None
    while True:
        if found is None:
            labelled = rows.withColumn("component", F.col("rep"))
        else:
            labelled = rows.join(found, rows.rep == found.node, "left").withColumn("component", F.coalesce("component", "rep")).drop("node")
            labelled = stored(labelled, "labelled")
        parts = labelled.withColumn("c", F.lit(1))
        if found is not None:  # before, each row is a component of its own
            parts = labelled.groupBy("token", "step", "component").agg(F.count("*").alias("c"))
        left = parts.groupBy("token", "step").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("s"), F.count("*").alias("k")).filter("k > 1")
        todo, most = left.agg(F.sum(F.expr("(m * m - s) / 2")), F.sum("m")).first()
        if not todo:
            break
        labelled = labelled.join(left.select("token", "step"), ["token", "step"], "left_semi")
        rows = labelled.drop("component")  # groups of one component are done
        final = todo <= 20 * most or before is not None and todo > 0.4 * before
        before = todo
        x, y = labelled.alias("x"), labelled.alias("y")
        wanted = F.expr(_wanted(percent)).alias("wanted")
        sizes = _may_link(percent)
        if final:
            meet = x.join(y, F.expr(f"x.token = y.token and x.step = y.step and x.rep < y.rep and x.component <> y.component and {sizes} "
                                    "and (x.own = x.step or y.own = y.step)"))
        else:
            hubs = labelled.groupBy("token", "step").agg(F.max_by(F.struct("rep", "n", "component", "matches", "length", "place", *bits), F.struct("cost", -F.col("rep"))).alias("hub"))
            hubs = hubs.select("token", "step", "hub.*")
            meet = hubs.alias("x").join(y, F.expr(f"x.token = y.token and x.step = y.step and x.rep <> y.rep and x.component <> y.component and {sizes}"))
        pairs = meet.select(F.expr("x.rep").alias("hub"), F.expr("y.rep").alias("member"), wanted)
        pairs = pairs.groupBy("hub", "member").agg(F.count("*").alias("early"), F.max("wanted").alias("wanted"))
        if not final:  # one hub for each member: that with most early shared tokens
            pairs = pairs.groupBy("member").agg(F.max_by(F.struct("hub", "wanted"), F.struct("early", -F.col("hub"))).alias("best")).select("best.*", "member")
        # the multi-match test: shared tokens of both prefixes
        pairs = pairs.join(prefixes.select(F.col("rep").alias("hub"), F.col("tokens").alias("p")), "hub")
        pairs = pairs.join(prefixes.select(F.col("rep").alias("member"), F.col("tokens").alias("q")), "member")
        pairs = pairs.filter(F.size(F.array_intersect("p", "q")) >= F.col("wanted"))
        pairs = stored(pairs.select("hub", "member"), "pairs")
        if final and tested is not None:
            pairs = pairs.join(tested, ["hub", "member"], "left_anti").join(
                tested.select(F.col("member").alias("hub"), F.col("hub").alias("member")), ["hub", "member"], "left_anti")
        good = stored(verified(docs, pairs, size, percent), "links")
        links = good if links is None else links.unionAll(good)
        tested = pairs if tested is None else tested.unionAll(pairs)
        found = components(links)
        if final:
            break
    member = full.join(classes.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"]).select("doc_id", "rep")
    if found is not None:
        member = member.join(found, member.rep == found.node, "left").select("doc_id", F.coalesce("component", "rep").alias("rep"))
    placed = member.withColumnRenamed("rep", "component")
    placed = placed.groupBy("doc_id").agg(F.min("component").alias("component"))
    return profile.select("doc_id", F.col("n").alias("n_shingles")).join(placed, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents with only the smallest id of each component kept, all columns; null ids are kept."""
    linked = link_components(docs, size, percent).select("doc_id", "component_id").distinct()
    gone = linked.filter("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return link_components(documents(spark, sf_dir))


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
SQL: dict[str, str] = {}
