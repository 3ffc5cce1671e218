import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from threadloom.llm import packing

TEXTS = [
    None, "", "A short text.", "two  blanks and  more   here", " leading blank", "trailing blank ", "tabs\tand\n lines \n\n x", "a<|endoftext|>b",
    "It's we'll they've 12 3456   wide　space été 日本語", "word " * 3000, "x" * 5000, "A short text.",
]


def reference_ids(text):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("text", TEXTS)
def test_encoder_equals_the_tokenizer(text):
    encoder = packing.Encoder(str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    assert np.frombuffer(encoder.encode(text or "") + b"\0\0", "<u2").tolist() == reference_ids(text)


def test_hilbert_key_visits_neighbours():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = packing.hilbert_key(cells, 3)
    assert sorted(key) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def check(rows, texts):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for doc, pieces in by_doc.items():
        ids, at = reference_ids(texts[doc]), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            assert zlib.crc32(np.array(ids[at: at + p.length], "<u4").tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 1024 or at & (at - 1) == 0


def test_pieces_cover_every_text(spark, tmp_path):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, key string, ids int").write.parquet(str(tmp_path / "documents.parquet"))
    check(packing.op1_packing(spark, str(tmp_path)).collect(), TEXTS)


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty).count() == 0
    twice = spark.createDataFrame([(1, "same"), (1, "same"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.doc_tokens) for r in packing.pack(twice).collect()) == [(-1, 1), (1, 2), (1, 2)]
