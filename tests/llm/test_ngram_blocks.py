"""Blocks of pairs when one document is in most of them."""

import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandlake.llm import ngram_join
from strandlake.llm.shared import table


def test_no_block_exceeds_the_bound(spark):
    hot = spark.range(1, 40_001).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b"))
    rest = spark.range(50_000, 60_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    pairs = table(hot.unionByName(rest), "pairs")
    blocked = ngram_join._blocked(pairs)
    assert blocked.groupBy("block").count().agg(F.max("count")).first()[0] <= ngram_join._PAIRS_A_BLOCK
    assert blocked.select("a", "b").exceptAll(pairs).isEmpty() and blocked.count() == 50_000


def test_verified_with_a_split_document(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_PAIRS_A_BLOCK", 32)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), *(" ".join([*base[: 60 - i % 20], f"x{i}"]) for i in range(400))]
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t in texts]
    numbers = {s: i for i, s in enumerate(set().union(*sets))}
    frame = spark.createDataFrame([(i, np.array(sorted(numbers[s] for s in x), np.uint64).tobytes()) for i, x in enumerate(sets)], "digest bigint, shingles binary")
    pairs = table(spark.createDataFrame([(0, i) for i in range(1, len(texts))], "a bigint, b bigint"), "pairs")
    got = {(r.a, r.b) for r in ngram_join._verified(pairs, frame, Fraction(3, 4)).collect()}
    assert got == {(0, i) for i in range(1, len(texts)) if 4 * len(sets[0] & sets[i]) >= 3 * len(sets[0] | sets[i])}
    assert 0 < len(got) < 400


def _brute(rows):
    """component_id and set size of every row, from all pairs of rows."""
    words = [re.findall("[^\x20\x09-\x0d]+", (t or "").lower()) for _, t in rows]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in words]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows)), len({find(i) for i in range(len(rows)) if sets[i]})


def test_repeated_ids_of_different_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, one), (1, two), (2, one + " more"), (3, two + " more"), (4, "alone"), (4, "alone"), (5, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("digest", F.lit("x")).withColumn("Component", F.lit(0))
    want, groups = _brute(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()) == want
    kept = sorted((r.doc_id, r.text or "") for r in ngram_join.near_duplicates_removed(docs).collect())
    assert kept == [(1, one), (1, two), (4, "alone"), (5, ""), (5, "")] and groups == 3


def test_long_lists_and_shared_passages(spark, monkeypatch):
    """Copies around the threshold, a passage that a third of all rows share, slices of a few rows, more than one bucket."""
    monkeypatch.setattr(ngram_join, "SLICE_ROWS", 7)
    monkeypatch.setattr(ngram_join, "BUCKET_SHINGLES", 50)
    rng = np.random.default_rng(5)
    base, passage = [f"w{i}" for i in range(80)], " ".join(f"p{i}" for i in range(30))
    rows = []
    for i in range(120):
        if i % 3 == 0:
            rows.append((i, passage + " " + " ".join(f"u{i}x{j}" for j in range(int(rng.integers(1, 60))))))
        else:
            words = list(base)
            for j in rng.integers(0, 80, int(rng.integers(0, 5))):
                words[j] = f"z{rng.integers(9)}"
            rows.append((i, " ".join(words)))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == _brute(rows)[0]


def test_many_texts_of_one_id_are_stored_once_each(spark, monkeypatch):
    """300 rows of one doc_id, each with a text of its own, some near others."""
    counts, keep = {}, ngram_join.table

    def counted(df, name):
        out = keep(df, name)
        counts.setdefault(name, out.count())
        return out

    monkeypatch.setattr(ngram_join, "table", counted)
    base = [[f"b{j}w{i}" for i in range(40)] for j in range(60)]
    rows = [(7, " ".join([*base[i % 60][: 40 - i // 60], f"x{i}"])) for i in range(300)] + [(8, " ".join(base[0]))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == _brute(rows)[0] and counts["texts"] == 301


def _brute_links(rows):
    """Per row, how many different sets its own set links with."""
    words = [re.findall("[^\x20\x09-\x0d]+", (t or "").lower()) for _, t in rows]
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for w in words]
    return sorted((doc, sum(4 * len(s & o) >= 3 * len(s | o) for o in set(sets) if o and o != s)) for (doc, _), s in zip(rows, sets, strict=True))


def test_every_link_counts(spark, monkeypatch):
    """Near copies that link with each other, not only with the head of their component; cells of a few classes."""
    monkeypatch.setattr(ngram_join, "CELL_CLASSES", 7)
    rng = np.random.default_rng(11)
    rows = []
    for i in range(150):
        words = [f"w{i % 2}x{j}" for j in range(90 - i % 5)]
        for j in rng.integers(0, 80, int(rng.integers(0, 4))):
            words[j] = f"z{rng.integers(6)}"
        rows.append((i, " ".join(words)))
    rows += [(200, rows[3][1]), (201, "short text"), (202, "short  text"), (203, None), (204, "other short text")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    want = _brute_links(rows)
    assert sorted((r.doc_id, r.n_links) for r in got) == want and max(n for _, n in want) > 40
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == _brute(rows)[0]


def test_pairs_of_a_large_group_are_no_rows(spark, monkeypatch):
    """600 near copies: what is stored and verified stays in proportion to them, though they have 180 000 pairs."""
    counts, keep = {}, ngram_join.table

    def counted(df, name):
        out = keep(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "table", counted)
    rows = [(i, " ".join([*(f"w{j}" for j in range(60)), f"x{i}"])) for i in range(600)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.component_id, r.n_links) for r in got} == {(0, 599)}
    assert counts["pairs"] < 100 and counts["links"] < 3000


def test_overlaps_and_forests():
    rng = np.random.default_rng(3)
    for most in (30, 3000):
        sets = [np.unique(rng.integers(0, most, int(rng.integers(1, 60)))).astype(np.uint64) for _ in range(40)]
        cell = lambda part: ngram_join._cell(pa.table({"digest": np.arange(len(part)), "shingles": [s.tobytes() for s in part]}))
        for x, y in ((sets[:25], sets[25:]), (sets, sets), (sets[:1], sets[1:2])):
            assert ngram_join._shared(cell(x), cell(y)).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]
    for n in (0, 1, 50, 400):
        u, v = rng.integers(0, 200, n), rng.integers(0, 200, n)
        few = ngram_join._forest(u, v, 200)
        groups = lambda at: [min(find(at, i)) for i in range(200)]

        def find(at, i):
            seen, todo = {i}, [i]
            while todo:
                k = todo.pop()
                new = {int(v[e]) for e in at if u[e] == k} | {int(u[e]) for e in at if v[e] == k}
                todo += new - seen
                seen |= new
            return seen

        assert groups(range(n)) == groups(few) and len(few) == 200 - len(set(groups(few)))
