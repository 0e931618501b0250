"""Spelling variants against a comparison of all pairs."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandlake.llm import variants
from strandlake.llm.queries import op13_spelling_variants


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(words):
    """word, form, root, n, n_near, form_n of all words."""
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    form = {}
    for a, others in near.items():
        best = min(others, key=lambda b: (-words[b], b), default=None)
        if best is not None and words[best] >= 2 * words[a]:
            form[a] = best
    out = []
    for a in words:
        root = a
        while root in form:
            root = form[root]
        out.append((a, form.get(a), root, words[a], len(near[a]), words.get(form.get(a))))
    return sorted(out, key=repr)


def made(seed, n):
    """Words with many relatives: few letters, accents, one long word."""
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice([*"abceéÿ×à"], int(rng.integers(5, 9)))) for _ in range(n // 3)]
    words = Counter({w: int(rng.integers(3, 50)) for w in base})
    for w in base * 2:
        i = int(rng.integers(len(w)))
        v = [w[:i] + w[i + 1 :], w[:i] + "e" + w[i + 1 :], w[:i] + "zq"[i % 2] + w[i:]][int(rng.integers(3))]
        words[v] = int(rng.integers(3, 200))
    return dict(words) | {"o" * 300: 5, "o" * 301: 9, "o" * 150 + "i" + "o" * 149: 20}


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


@pytest.mark.parametrize("members, levels, leaf", [(20_000, (3, 8), 12), (40, (3, 5), 2), (7, (1, 2), 1)])
def test_groups_equal_brute_force(spark, monkeypatch, members, levels, leaf):
    """One part a cell, deeper cuts, and cells whose members are dealt to several parts."""
    for name, value in (("MEMBERS", members), ("LEVELS", levels), ("LEAF", leaf), ("BATCH", 100)):
        monkeypatch.setattr(variants, name, value)
    words = made(8, 700)
    frame = spark.createDataFrame([*words.items(), (None, 4)], "word string, n bigint").repartition(3)
    assert rows_of(variants.variant_groups(frame)) == brute(words)


def test_no_pair_is_missed_without_lookups_of_all(spark):
    """Pairs that are verified are far fewer than all pairs."""
    words = [w.encode("latin-1") for w in made(9, 3000)]
    size = np.array([len(w) for w in words])
    short = [w for w, n in zip(words, size, strict=True) if n == 7]
    counts = variants.vectors(short)
    led = sum(len(a) for a, _ in variants._search(counts, counts, np.zeros(len(short), np.int64)))
    assert len(short) > 300 and led < 0.05 * len(short) ** 2
    found = {(short[a], short[b]) for x, y in variants._pairs(short, short, True) for a, b in zip(x, y, strict=True)}
    assert found == {(a, b) for i, a in enumerate(short) for b in short[i + 1 :] if one_edit(a.decode("latin-1"), b.decode("latin-1"))}


def test_empty_table_and_chains(spark):
    assert variants.variant_groups(spark.createDataFrame([], "word string, n bigint")).count() == 0
    chain = {"abcde" + "f" * i: 3 * 2**i for i in range(12)}
    assert rows_of(variants.variant_groups(spark.createDataFrame(list(chain.items()), "word string, n bigint"))) == brute(chain)


def test_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(10)
    vocabulary = [*made(11, 150), "Straße", "NAÏVE", "naÏve", "I'm"]
    rows = [(i, " ".join(rng.choice(vocabulary, 40)) + "-Über,ÜBER") for i in range(300)] + [(4, "again again again"), (4, "again again again"), (None, "Nobody nobody nobody"), (301, None), (302, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts, deleted = Counter(), 0
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{doc}:{w}".encode()) if doc is not None else 1
            if h % 97 == 0:
                k, deleted = h % len(w), deleted + 1
                w = w[:k] + w[k + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert deleted > 20 and rows_of(op13_spelling_variants(spark, str(tmp_path))) == brute(words)
