"""Planted look-alikes of personal data: the method adds the true ones and refuses decoys; base spans equal plain patterns."""

import re

import numpy as np
from pyspark.sql import functions as F

from strandlake.llm import pii


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute(text):
    """kind, start, stop of the base spans by the plain patterns, one match after another."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m[0])]


def test_base_spans_equal_plain_patterns(spark):
    rng = np.random.default_rng(3)
    parts = ["a.b@c.de", "x@y", "1.2.3.4", "300.1.1.1.9", "1.2.3.4.5", "4532015112830366", "4532 0151-1283 0366", "4532015112830367", "+1 (555) 555-0199", "+12", "12-", "é", "@", "a@b.c.", "0.0.0.0x", " ", "  ", "\n", "-", "+", "a@b.c@d.e", "1 2 3"]
    texts = ["".join(parts[int(i)] + (" " if rng.random() < 0.5 else "") for i in rng.integers(0, len(parts), int(rng.integers(0, 25)))) for _ in range(400)] + [None, "", "1.2.3.4.5.6.7.8" * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("__base", F.lit(1)).withColumn("Row", F.lit(2))
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.detect(docs, {}).collect()}
    assert got == {i: brute(t or "") for i, t in enumerate(texts)}


def test_planted_look_alikes(spark):
    rng = np.random.default_rng(4)
    code = lambda n: "".join("0123456789abcdef"[int(i)] for i in rng.integers(0, 16, n))
    true, rows = {}, []
    for i in range(60):
        kind = i % 3
        if kind == 0:
            secret = code(40)
            rows.append((i, f'the lines are token = "{secret}" and more'))
            true[i] = ("secret", 23, 63)
        elif kind == 1:
            rows.append((i, f"please see order no. 123-45-{1000 + i} of the item version_{i}_of_the_catalogue_page"))
        else:
            rows.append((i, f"call my phone 030 1234 {5000 + 7 * i} tonight"))
            true[i] = ("phone", 14, 27)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.detect(docs).collect()}
    assert got == {i: [true[i]] if i in true else [] for i, _ in rows}
    clean = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert clean[0] == 'the lines are token = "[SECRET]" and more' and clean[2] == "call my phone [PHONE] tonight" and clean[1] == rows[1][1]


def test_redacted_overlaps_and_nothing(spark):
    docs = spark.createDataFrame([(1, "x +12345678901234567 y", "s"), (2, None, "s"), (3, "", None)], "doc_id bigint, text string, spans string")
    spans = F.expr("filter(base, b -> true)")
    assert pii.detect(docs, {}).select(spans.alias("s")).count() == 3
    assert [tuple(r) for r in pii.redacted(docs.where("doc_id > 1"), {}).orderBy("doc_id").collect()] == [(2, None, "s"), (3, "", None)]
    assert pii.redacted(docs.where("false")).count() == 0
