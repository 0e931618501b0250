"""Periodic runs against a search over all periods."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import runs
from strandlake.llm.queries import op11_periodic_runs


def brute(words, shortest=6, exponent=4):
    """All maximal stretches of each smallest period, by start, then period."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(shortest, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def random_words(rng, n):
    kind = rng.integers(4)
    if kind == 0:
        return [str(x) for x in rng.integers(0, 2, n)]
    out = [str(x) for x in rng.integers(0, 3 if kind == 1 else 200, n)]
    for _ in range(rng.integers(0, 4)):  # repeated passages, some inside others
        a, p, k = int(rng.integers(0, n)), int(rng.integers(1, 6)), int(rng.integers(2, 9))
        out[a:a] = (out[a : a + p] or ["x"]) * k
    return out


def test_array_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(400):
        words = random_words(rng, int(rng.integers(1, 90)))
        codes = np.append(np.unique(words, return_inverse=True)[1], 10**6)
        assert [tuple(r) for r in runs.runs_of(codes).tolist()] == brute(words)
        assert [tuple(r) for r in runs.runs_of(codes, 2, 2).tolist()] == brute(words, 2, 2)


@pytest.mark.parametrize("shortest, exponent", [(6, 4), (2, 2), (5, 3)])
def test_operator_equals_brute_force(spark, monkeypatch, shortest, exponent):
    """Many texts in one chunk, chunks and suffix arrays of a few texts; null, empty and repeated rows, clashing columns."""
    monkeypatch.setattr(runs, "CHUNK_BYTES", 900)
    monkeypatch.setattr(runs, "ARRAY_WORDS", 300)
    rng = np.random.default_rng(4)
    texts = ["\t ".join(random_words(rng, int(rng.integers(1, 80)))) + " \n" for _ in range(150)]
    rows = [*enumerate(texts), (7, texts[7]), (200, None), (201, ""), (202, " \t "), (None, "a a a a a a a"), (203, "É É É É É É b"), (204, "a A a A a A a A")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("Runs", F.lit(1)).withColumn("collapsed", F.lit("x"))
    got = runs.periodic_runs(frame, shortest, exponent).collect()
    want = []
    for doc, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        found = brute(words, shortest, exponent)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        want.append((doc, len(words), tuple(found), " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert sorted(map(repr, ((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in got))) == sorted(map(repr, want))
    assert runs.periodic_runs(frame.where("false")).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(frame, exponent=1)


def test_long_text(spark):
    """One text of 60 000 words that repeats a passage, one that is one word."""
    passage = [f"w{i}" for i in range(50)]
    words = ["start"] + passage * 1200
    rows = [(1, " ".join(words)), (2, "a " * 50_000)]
    got = {r.doc_id: r for r in runs.periodic_runs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [tuple(r) for r in got[1].runs] == [(1, 60_000, 50)] and got[1].collapsed == " ".join(words[:51])
    assert [tuple(r) for r in got[2].runs] == [(0, 50_000, 1)] and got[2].collapsed == "a"


def test_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(random_words(rng, int(rng.integers(1, 60))))) for i in range(300)] + [(300, None), (301, ""), (None, "b b b b b b")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op11_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for doc, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            g, planted = h // 10, planted + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = brute(words)
        gone = {i for s, k, q in found for i in range(s + q, s + k)}
        best = min(((-k, s, q) for s, k, q in found), default=None)
        r = got[doc]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *((best[1], -best[0], best[2]) if best else (None, None, None)))
        assert r.exponent_milli == (1000 * -best[0] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    assert planted > 10 and len(got) == len(rows)
