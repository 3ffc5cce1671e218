import hashlib
import random
import re
import zlib

import pytest

from threadloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, rep string, a int, task string, size int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        turns.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c - 20 * int(c / 20))
        built[c] = tuple(turns.get(base, [])[:h] + own[h:])
    nodes = {}
    for c, way in built.items():
        for d in range(len(way) + 1):
            nodes.setdefault(way[:d], []).append(c)
    out = []
    for way, members in nodes.items():
        below = [w for w in nodes if w[: len(way)] == way]
        leaf = lambda w: not any(len(x) == len(w) + 1 and x[: len(w)] == w for x in nodes)
        saved = sum((len(nodes[w]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", w[-1][1])) for w in below if w)
        ends = ",".join(map(str, sorted(c for c in members if built[c] == way)))
        out.append((min(members), len(way), min(nodes[way[:-1]]) if way else None, len(members),
                    sum(len(w) == len(way) + 1 for w in below), sum(map(leaf, below)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "r", 2, "t", 3) for r in rows], SCHEMA)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: r[:2])


def chats(n, longest, texts, seed):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for c in range(n) for t in range(rng.randrange(longest + 1))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("band", [2, 3, 16])
def test_equals_brute_force(spark, band):
    rows = chats(70, 7, ["hello there", "yes", "one  two\tthree ", ""], band)
    assert got(prefix_trie.trie(table(spark, rows).repartition(5), band)) == brute(rows)


def test_odd_rows(spark):
    rows = chats(45, 4, ["a b", None], 5) + [
        (None, 1, "user", "no conversation"), (100, None, None, "first: no turn"), (100, 0, "user", "x y"), (100, 5, None, None),
        (-7, 1, "user", "negative"), (-19, 2, "assistant", "negative too"), (-20, 3, "user", "base"),
        (101, 3, "same", "repeated row"), (101, 3, "same", "repeated row"), (102, 1, "a\nb", "c"), (103, 1, "a", "b\nc"),
        (141, 1, "user", "word " * 40_000), (161, 1, "user", "only own turn")]
    assert got(prefix_trie.trie(table(spark, rows))) == brute(rows)


def test_deep_conversation_and_common_first_turn(spark):
    """One conversation with most rows, over tasks, window blocks and several levels of bands; one first turn for many."""
    rows = [(5, t, "user", f"turn {t % 7}") for t in range(300)] + [(c, t, "user", f"turn {t % 7}") for c in (25, 45, 900) for t in range(120)]
    rows += [(c, 0, "user", "turn 0") for c in range(1000, 1200)]
    before, prefix_trie.BLOCK, prefix_trie.IDS = (prefix_trie.BLOCK, prefix_trie.IDS), 32, 16
    try:
        assert got(prefix_trie.trie(table(spark, rows).repartition(8), 4)) == brute(rows)
    finally:
        prefix_trie.BLOCK, prefix_trie.IDS = before


def test_ties_have_one_result(spark):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "y"), (1, 0, "assistant", "x"), (3, 1, "user", "z")]
    assert got(prefix_trie.trie(table(spark, rows))) == got(prefix_trie.trie(table(spark, rows[::-1]).repartition(3)))


def test_no_rows(spark):
    none = prefix_trie.trie(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns == COLUMNS
    assert prefix_trie.trie(table(spark, [(None, 1, "user", "x")])).count() == 0
