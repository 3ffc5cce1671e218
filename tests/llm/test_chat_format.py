import math
import re

import pytest
from pyspark.sql import functions as F

from threadloom.llm import chat_format as chat

SCHEMA = f"conv_id long, turn long, role string, parts array<{chat.PART}>, seq int, formatted string, tokens int, start int, p string"


def text(t):
    return ("text", t, None, None, None, None, None)


IMAGE = ("image", None, "cat.png", 30, 14, None, None)
AUDIO = ("audio", None, "a.wav", None, None, 1.5, None)
PAGES = ("document", None, "d.pdf", None, None, None, 3)
NASTY = ["", "<", "|", "\\", "<|", "<\\|", "<\\\\|", "<|end|>", "<|turn|>user<|says|>x<|end|>", "<|image 1|>", "a <", "| b", "<<|>|", "\\### Assistant: </turn> ok", "é😀<|é", "\n", "$1 \\1"]


def escape(s):
    return re.sub(r"<(\\*)\|", r"<\\\1|", s)


def brute(rows):
    """Conversations formatted by a plain loop over parts."""
    out = {}
    for conv, turn, role, parts in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        c = out.setdefault(conv, {"formatted": "", "learned": [], "attachments": [], "tokens": 0, "turn": 0})
        begin, c["formatted"] = len(c["formatted"]), c["formatted"] + "<|turn|>" + escape(role or "") + "<|says|>"
        for part in (p for p in parts or [] if p):
            kind, said, ref, width, height, seconds, pages = part
            start = len(c["formatted"])
            if kind == "text":
                tokens = len(re.findall(r"[^\x20\x09-\x0D]+", said or ""))
                c["formatted"] += escape(said or "")
                if role == "assistant":
                    c["learned"].append((c["turn"], start - begin, start, len(c["formatted"]) - start))
            else:
                tokens = {"image": math.ceil((width or 0) / 14) * math.ceil((height or 0) / 14), "audio": math.ceil((seconds or 0) * 25), "document": (pages or 0) * 512}[kind]
                c["attachments"].append((len(c["attachments"]) + 1, kind, ref, tokens))
                c["formatted"] += f"<|{kind} {len(c['attachments'])}|>"
            c["tokens"] += tokens
        c["formatted"] += "<|end|>"
        c["turn"] += 1
    return {k: (v["formatted"], v["learned"], v["attachments"], v["tokens"]) for k, v in out.items()}


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "f", 2, 3, "p") for r in rows], SCHEMA)


def got(df):
    return {r.conv_id: (r.formatted, [tuple(x) for x in r.learned], [tuple(x) for x in r.attachments], r.tokens) for r in df.collect()}


ROWS = [
    (1, 2, "assistant", [text("two "), IMAGE, text("parts"), AUDIO, text("")]), (1, 1, "user", [PAGES, text("see <|image 1|>"), None, IMAGE]),
    (2, None, None, None), (2, 0, "assistant", []), (2, 1, "assistant", [text(None)]), (2, 3, "<|end|>", [text("odd role")]),
    (3, 0, "assistant", [text("same")]), (3, 0, "assistant", [text("same")]), (4, 0, "assistant", [text("word " * 30_000)]),
    (5, 0, "system", [("image", None, None, None, None, None, None)]),
] + [(10 + i, t, ("user", "assistant")[t % 2], [text(NASTY[(i + t) % len(NASTY)])]) for i in range(len(NASTY)) for t in range(6)]


def test_equals_a_plain_loop(spark):
    assert got(chat.format_conversations(table(spark, ROWS).repartition(4))) == brute(ROWS)


def test_round_trip(spark):
    """Roles, texts, placeholders and learned texts come back from the formatted text and the mask."""
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(table(spark, ROWS))).collect()}
    marks = {"image": r"<|image %d|>", "audio": "<|audio %d|>", "document": "<|document %d|>"}
    for conv in {r[0] for r in ROWS}:
        own = sorted((r for r in ROWS if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        number, row = 0, back[conv]
        assert len(row.turns) == len(own)
        for turn, (_, _, role, parts) in zip(row.turns, own):
            texts, found = [""], []
            for p in (p for p in parts or [] if p):
                if p[0] == "text":
                    texts[-1] += p[1] or ""
                else:
                    number += 1
                    found.append(marks[p[0]] % number)
                    texts.append("")
            assert (turn.role, turn.texts, turn.marks) == (role or "", texts, found)
        assert row.learned_texts == [p[1] or "" for r in own if r[2] == "assistant" for p in r[3] or [] if p and p[0] == "text"]
        spans = [chat_text(row.formatted[s.start: s.start + s.length]) for s in row.learned]
        assert spans == row.learned_texts


def chat_text(s):
    return re.sub(r"<\\(\\*)\|", r"<\1|", s)


def test_ties_repeats_and_null_id(spark):
    rows = [(None, 0, "user", [text("x")]), (None, 0, "user", [text("y")]), (7, 1, "b", [text("1")]), (7, 1, "a", [text("2")])]
    a = got(chat.format_conversations(table(spark, rows)))
    assert a == got(chat.format_conversations(table(spark, rows[::-1]).repartition(3)))
    assert a[7][0] == "<|turn|>a<|says|>2<|end|><|turn|>b<|says|>1<|end|>" and set(a) == {None, 7}


def test_no_rows_and_unknown_type(spark):
    none = chat.read_back(chat.format_conversations(spark.createDataFrame([], SCHEMA)))
    assert none.count() == 0 and {"formatted", "learned", "turns"} <= set(none.columns)
    with pytest.raises(Exception, match="unknown content part: video"):
        chat.format_conversations(table(spark, [(1, 0, "user", [("video", *[None] * 6)])])).collect()


def test_query_on_odd_texts(spark, tmp_path):
    rows = [(1, 0, "assistant", t) for t in NASTY[:1]] + [(2 + i, t, "assistant", x) for i, x in enumerate(NASTY) for t in range(2)] + [(99, None, None, None)]
    spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r.conv_id: r for r in chat.op13_chat_format(spark, str(tmp_path)).collect()}
    import hashlib
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, x in enumerate(NASTY):
        r = found[2 + i]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (2, sha(f"assistant\n{x}\n" * 2), 2 * len(x), sha(x * 2))
    assert (found[99].n_turns, found[99].turns_sha256, found[99].loss_chars) == (1, sha("\n\n"), 0)
    probe = "\\### Assistant: </turn> ok"
    assert (found[-7].turns_sha256, found[-7].loss_sha256) == (sha(f"user\n{probe}\nassistant\n{probe}\n"), sha(probe))


def test_native(spark):
    """No Python, pandas or Arrow stage in the plan."""
    plan = chat.read_back(chat.format_conversations(table(spark, ROWS).filter(F.col("conv_id") > 0)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
