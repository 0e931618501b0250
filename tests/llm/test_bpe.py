"""Byte-level BPE against the tokenizers library."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import bpe
from strandlake.llm.queries import op12_bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = np.random.default_rng(6)
    letters = [*"abcdeéß ,.'0\t\n  \u0085\x1c中文🙂́٣²ⅷ​﻿", "'s", "'LL", "  ", "the ", " and", "<|endoftext|>", "<|endof", "\r\n"]
    out = ["", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", " <|endoftext|> ", "aaaaaaaaaaaaaaaaaaaaa", "x" * 3000, "ab" * 2000, "\x00\x01", "don't  stop\n\n now "]
    return out + ["".join(rng.choice(letters, int(rng.integers(1, 60)))) for _ in range(600)]


def test_every_code_point(vocabulary, library):
    """Cuts between letters, digits, spaces and others are those of the library."""
    encoder = bpe.Encoder(vocabulary)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    asked = ["".join(f"a{c} {c}1" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    wrong = [t for t, e in zip(asked, library.encode_batch(asked, add_special_tokens=False), strict=True) if encoder(t) != np.array(e.ids, "<u4").tobytes()]
    assert not wrong


def test_encode_and_decode_equal_the_library(spark, vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 500)
    monkeypatch.setattr(bpe, "CACHED", 50)
    rows = [*enumerate(texts()), (3, "repeated"), (3, "repeated"), (None, "no id"), (-1, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("IDS", F.lit(1))
    encoded = bpe.encode(frame, vocabulary)
    want = sorted(repr((i, library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert sorted(repr((r.doc_id, r.ids)) for r in encoded.collect()) == want
    decoded = bpe.decode(encoded.withColumn("Text", F.lit("clash")), vocabulary)
    assert decoded.columns == ["doc_id", "ids", "text"] and all(r.text == library.decode(r.ids, skip_special_tokens=False) for r in decoded.collect())
    assert bpe.decode(bpe.encode(frame.where("false"), vocabulary), vocabulary).count() == 0
    broken = spark.createDataFrame([([vocabulary.byte_ids[0xE4]],), (None,), ([],)], "ids array<int>")
    assert sorted(r.text for r in bpe.decode(broken, vocabulary).collect()) == ["", "", "�"]


def test_long_unbroken_text(spark, vocabulary, library):
    text = "".join(np.random.default_rng(1).choice([*"abcde"], 40_000))
    assert bpe.encode(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), vocabulary).first().ids == library.encode(text, add_special_tokens=False).ids


def test_query(spark, library, tmp_path):
    rows = [*enumerate(texts()), (-1, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in op12_bpe(spark, str(tmp_path)).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
