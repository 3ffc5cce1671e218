"""Language-model scores by context-tree weighting over binary-decomposed bytes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.checkpoints import stored, tidy
from threadloom.llm.common import documents, id_mod, lower_ascii, utf8, words

#: Bytes of context at the deepest level.
DEPTH = 5
#: Levels below are weighted inside groups of one context of so many bytes.
SHALLOW = 3
BLOCK_BYTES = 16 << 20
GROUP_GRAMS = 400_000
SPACE, END = 32, 10


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight; for x > 0."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    low = x.copy()
    for i in range(1, 8):
        low *= x + i
    return series - np.log(low)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of so many zeros and ones."""
    big = np.maximum(zeros, ones) > 1e6  # the product in log_gamma would lose digits
    a, b = zeros + 0.5, ones + 0.5
    out = log_gamma(a) + log_gamma(b) - log_gamma(a + b) - math.log(math.pi)
    return np.where(big, np.minimum(out, 0.0), out)


def stream(array):
    """Lower-cased texts as words, each with a blank behind it, and one end byte, after DEPTH end bytes of context.

    Returns the 6-byte grams of all places (context, then the byte), the text number of each, word hashes (negative
    numbers) and the text number of each word.
    """
    data, offsets = utf8(array)
    data = lower_ascii(data)
    hashes, start, length, bounds = words(data, offsets)
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(bounds))
    size = np.bincount(text, length + 1, minlength=n).astype(np.int64) + 1 + DEPTH
    first = np.cumsum(size) - size
    out = np.full(int(size.sum()), END, np.uint8)
    before = np.cumsum(length + 1) - (length + 1)
    begin = first[text] + DEPTH + before - before[bounds[:-1][text]] if len(text) else start
    inside = np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())
    source = np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())
    out[inside] = data[source]
    out[begin + length] = SPACE
    gram = np.zeros(max(len(out) - DEPTH, 0), np.int64)
    for j in range(DEPTH + 1):
        gram = gram << 8 | out[j: len(out) - DEPTH + j]
    owner = np.repeat(np.arange(n), size)
    good = owner[: len(gram)] == owner[DEPTH:]
    return gram[good], owner[DEPTH:][good], (hashes | np.uint64(1 << 63)).view(np.int64), text


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key of parts (sorted keys, numbers): their runs are merged, not sorted anew."""
    key = np.concatenate([k for k, _ in parts])
    number = np.concatenate([n for _, n in parts])
    if not len(key):
        return key, number
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(number[order], first)


def _levels(gram: np.ndarray, count: np.ndarray, top: int) -> dict[int, tuple]:
    """Nodes of levels DEPTH to ``top``: sorted keys (context, bit place), zeros, ones, log KT, log weighted probability."""
    key, ones, zeros = [], [], []
    target = gram & 255
    for j in range(8):
        key.append((gram >> 8) << 8 | (1 << j) | target >> (8 - j))
        bit = target >> (7 - j) & 1
        ones.append(count * bit)
        zeros.append(count * (1 - bit))
    key, zeros, ones = (np.concatenate(x) for x in (key, zeros, ones))
    log_weight = None
    found = {}
    for level in range(DEPTH, top - 1, -1):
        context = key >> 8 & (1 << 8 * level) - 1
        nodes, place = np.unique(context << 8 | key & 255, return_inverse=True)
        zeros, ones = (np.bincount(place, x, minlength=len(nodes)) for x in (zeros, ones))
        kt = log_kt(zeros, ones)
        if log_weight is None:
            log_weight = kt
        else:
            log_weight = math.log(0.5) + np.logaddexp(kt, np.bincount(place, log_weight, minlength=len(nodes)))
        key = nodes
        found[level] = (nodes, zeros, ones, kt, log_weight)
    return found


def _mixed(level: int, nodes, a, b):
    """Continue a mixture a + b * (what lies deeper) through one level's nodes; returns the chance of a one so far."""
    _, zeros, ones, kt, log_weight = nodes
    stop = np.ones(len(kt)) if level == DEPTH else np.exp(np.minimum(math.log(0.5) + kt - log_weight, 0.0))
    return a + b * stop * (ones + 0.5) / (zeros + ones + 1), b * (1 - stop)


def _context(level: int) -> Column:
    return F.expr(f"shiftright(gram, 8) & {(1 << 8 * level) - 1}L")


def gram_scores(grams: DataFrame) -> DataFrame:
    """Rows (gram, value): log10 of the tree's probability of each gram's last byte after its context.

    grams: rows (gram, n), n occurrences in training (0: only asked for).  Weighted probabilities go up from the
    deepest level inside groups of one ``SHALLOW``-byte context (at most 256**3 grams), above it by aggregation;
    mixtures come down by joins on the parent context, and through the deep levels inside the groups again.  A context
    that training never saw leaves its bits at one half.
    """
    groups = max(1, -(-grams.count() // GROUP_GRAMS))
    grams = grams.withColumn("bucket", F.pmod(F.xxhash64(_context(SHALLOW)), F.lit(groups)).cast("int"))
    schema = "key long, zeros double, ones double, weight double"

    def up(table):
        import pyarrow as pa

        nodes, zeros, ones, _, weight = _levels(table.column("gram").to_numpy(), table.column("n").to_numpy().astype(float), SHALLOW)[SHALLOW]
        return pa.table({"key": nodes, "zeros": zeros, "ones": ones, "weight": weight})

    def weigh(batches):
        import pyarrow as pa

        for batch in batches:
            zeros, ones, below = (batch.column(c).to_numpy() for c in ("zeros", "ones", "below"))
            kt = log_kt(zeros, ones)
            weight = math.log(0.5) + np.logaddexp(kt, below)
            stop = np.exp(np.minimum(math.log(0.5) + kt - weight, 0.0))
            columns = [batch.column("key"), batch.column("zeros"), batch.column("ones"), pa.array(weight), pa.array(stop)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "zeros", "ones", "weight", "stop"])

    at = stored(grams.filter("n > 0").select("bucket", "gram", "n").groupBy("bucket").applyInArrow(up, schema), "nodes")
    tables = []
    for level in range(SHALLOW - 1, -1, -1):
        parent = F.expr(f"(key & {(1 << 8 * (level + 1)) - 1}L)")
        at = at.groupBy(parent.alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weight").alias("below"))
        at = stored(at.mapInArrow(weigh, schema + ", stop double"), "nodes")
        tables.append(at)
    mixture, wanted = None, None
    for level, table in enumerate(reversed(tables)):
        own = F.col("stop") * (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
        if mixture is None:
            mixture = table.select("key", own.alias("a"), (1 - F.col("stop")).alias("b"))
        else:
            above = mixture.select(F.col("key").alias("up"), F.col("a").alias("a0"), F.col("b").alias("b0"))
            joined = table.withColumn("up", F.expr(f"key & {(1 << 8 * level) - 1}L")).join(above, "up")
            mixture = joined.select("key", (F.col("a0") + F.col("b0") * own).alias("a"), (F.col("b0") * (1 - F.col("stop"))).alias("b"))
        mixture = stored(mixture, "mixture")
        # a group gets the mixtures of its contexts at every shallow level: a deeper one may be unknown
        asked = grams.select("bucket", _context(level).alias("context")).distinct()
        part = asked.join(mixture.withColumn("context", F.shiftright("key", 8)), "context")
        part = part.select((F.col("bucket") + 0).alias("bucket"), F.lit(level).alias("level"), "key", "a", "b")
        wanted = part if wanted is None else wanted.unionAll(part)

    def down(left, right):
        import pyarrow as pa

        gram, n = left.column("gram").to_numpy(), left.column("n").to_numpy().astype(float)
        seen = n > 0
        levels = _levels(gram[seen], n[seen], SHALLOW) if seen.any() else {}
        known = {}
        at, *columns = (right.column(c).to_numpy() for c in ("level", "key", "a", "b"))
        for level in range(SHALLOW):
            own = [c[at == level] for c in columns]
            order = np.argsort(own[0], kind="stable")
            known[level] = tuple(c[order] for c in own)
        for level in sorted(levels):
            nodes = levels[level][0]
            above, up_a, up_b = known[level - 1]
            place = np.searchsorted(above, nodes & (1 << 8 * level) - 1)
            known[level] = (nodes, *_mixed(level, levels[level], up_a[place], up_b[place]))
        total = np.zeros(len(gram))
        target = gram & 255
        for j in range(8):
            bit = (target >> (7 - j) & 1).astype(bool)
            one = np.full(len(gram), 0.5)
            for level in range(DEPTH + 1):
                if level not in known or not len(known[level][0]):
                    continue
                nodes, a, b = known[level]
                node = (gram >> 8 & (1 << 8 * level) - 1) << 8 | (1 << j) | target >> (8 - j)
                place = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
                hit = nodes[place] == node
                one = np.where(hit, a[place] + b[place] * 0.5, one)
            total += np.log10(np.clip(np.where(bit, one, 1 - one), 1e-300, 1.0))
        return pa.table({"gram": gram, "value": total})

    return grams.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(down, "gram long, value double")


@tidy
def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Scores of all texts by a tree trained on those that are not ``held_out``.

    Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte), one for each
    input row.  Texts are lower-cased (A-Z) and taken as words, each with one blank behind it, and an end.  score is
    log10 of the text's probability under the tree, base_score under a smoothed unigram model of words and end.

    Texts are dealt by hash to blocks of about ``BLOCK_BYTES``.  A block sends each of its distinct words and grams once
    with its training count; totals are weighted as in ``gram_scores`` and come back to the blocks that asked for them,
    so no task and no driver holds the model.

    Null text is empty (one end token); a null id's remainder is that of the empty text.  Without training texts
    base_score is 0 and bits have chance one half.  Empty tables give no rows; other columns are ignored; repeated rows
    are scored and counted each.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    size, trained = rows.agg(F.sum(F.octet_length("text")), F.sum((~F.col("held_out")).cast("long"))).first()
    blocks = max(1, -(-(size or 0) // BLOCK_BYTES))
    trained = trained or 0
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block")
    rows = rows.select(block, "doc_id", "held_out", "text")

    def parts(table):
        from threadloom.llm.common import chunks

        for part in chunks(table.combine_chunks().to_batches()):
            yield part

    def count(table):
        import pyarrow as pa

        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part in parts(table):
            train = ~part.column("held_out").to_numpy(zero_copy_only=False)
            gram, of, word, owner = stream(part.column("text"))
            found = [(keys, sums)]
            for key, own in ((gram, train[of]), (word, train[owner])):
                found.append(np.unique(key[own], return_counts=True))
                rest = np.unique(key[~own])
                found.append((rest, np.zeros(len(rest), np.int64)))
            keys, sums = merged(found)
        return pa.table({"block": np.full(len(keys), table.column("block")[0].as_py() if table.num_rows else 0, np.int32), "key": keys, "n": sums})

    asked = stored(rows.groupBy("block").applyInArrow(count, "block int, key long, n long"), "asked")
    totals = stored(asked.groupBy("key").agg(F.sum("n").alias("n")), "totals")
    seen, distinct = totals.filter("key < 0 and n > 0").agg(F.sum("n"), F.count("*")).first()
    train_tokens = (seen or 0) + trained
    base = train_tokens + 0.5 * (distinct + (trained > 0) + 1)
    values = gram_scores(totals.filter("key >= 0").select(F.col("key").alias("gram"), "n")).select(F.col("gram").alias("key"), "value")
    values = stored(values.unionAll(totals.filter("key < 0").select("key", F.col("n").cast("double").alias("value"))), "values")
    answers = asked.select("block", "key").join(values, "key").select("block", "key", "value")

    def judge(left, right):
        import pyarrow as pa

        import pyarrow.compute as pc

        key, value = right.column("key").combine_chunks(), right.column("value").to_numpy()

        def answer(asked):
            """Every asked key has an answer: it is looked up in a hash table, not searched in a sorted list."""
            return value[pc.index_in(pa.array(asked), key).to_numpy(zero_copy_only=False)]

        out = []
        for part in parts(left):
            gram, of, word, owner = stream(part.column("text"))
            n = part.num_rows
            tokens = np.bincount(owner, minlength=n) + 1
            counts = answer(word) if len(word) else np.zeros(0)
            known = np.bincount(owner, counts > 0, minlength=n) + (trained > 0)
            base_score = np.bincount(owner, np.log10((counts + 0.5) / base), minlength=n) + math.log10((trained + 0.5) / base)
            model = np.bincount(of, answer(gram), minlength=n)
            size = np.bincount(of, minlength=n)
            out.append(pa.table({
                "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": tokens.astype(np.int64),
                "n_known": known.astype(np.int64), "train_tokens": np.full(n, train_tokens, np.int64),
                "base_score": base_score, "score": model, "n_bytes": size.astype(np.int64), "bits_per_byte": -model / math.log10(2) / size,
            }))
        return pa.concat_tables(out)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        judge, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")


def op2_context_tree(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), id_mod() == 1)


QUERIES = {"op2_context_tree": op2_context_tree}
SQL: dict[str, str] = {}
