"""Shares of postings and rows that the vector searches read, on the given table and on clustered vectors; edge cases."""

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from strandlake.llm import hashing, topk

VECTORS = "/root/testdata/sf0.01/embeddings.parquet"


def clustered(n=2000, d=32, groups=20):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(groups, d))
    return centres[rng.integers(0, groups, n)] + 0.1 * rng.normal(size=(n, d))


def test_postings_stop_on_proof():
    x = np.floor(256 * clustered())
    index = topk.Index(x)
    for i in range(0, 400, 20):
        score = x @ x[i]
        found = index.members(x[i], 6)
        assert set(np.flatnonzero(score >= np.sort(score)[-6])) <= set(found)
    assert index.read < 0.8 * index.whole


def test_probing_prunes_and_finds():
    x = clustered()
    coder = hashing.learn(x, float(np.linalg.norm(x, axis=1).max()), 10)
    tables, asked = hashing.Tables(coder.codes(x, False)), coder.codes(x[::50], True)
    for code in asked:
        found = tables.within(code, coder.radius)
        every = np.flatnonzero(np.bitwise_count(tables.codes ^ code).sum(1) <= coder.radius)
        assert np.array_equal(found, every)  # the pigeonhole loses no code within the radius
    assert tables.probed < 0.5 * len(asked) * len(x) and tables.reranked < 0.2 * len(asked) * len(x)


def test_recall_on_the_given_table(spark):
    rows = pq.read_table(VECTORS).to_pylist()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.stack([np.array(r["embedding"], float) for r in rows])
    got = {}
    for r in hashing.neighbours(spark.read.parquet(VECTORS), F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        hit, total = hit + len(got[int(ids[q])] & set(ids[np.argsort(-score)[:20]].tolist())), total + 20
    assert hit >= 0.9 * total


def test_vectors_at_the_edges(spark):
    rows = [(0, []), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (50, [2.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("x"))
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.exact_top(vectors, F.col("vec_id") % 50 == 0, 5).collect()}
    assert got == {(0, 1, 1, 0), (0, 2, 1, 0), (0, 3, 50, 0), (50, 1, 1, 512 * 256), (50, 2, 1, 512 * 256), (50, 3, 0, 0)}
    assert topk.exact_top(vectors.where("false"), F.lit(True), 5).count() == 0
    assert hashing.neighbours(vectors.where("vec_id in (1, 50)"), F.col("vec_id") == 50, 5).count() == 2
    assert hashing.neighbours(vectors.where("false"), F.lit(True), 5).count() == 0
