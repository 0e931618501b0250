"""Approximate nearest neighbours by multi-index hashing.

Codes of BITS bits are the signs of vectors after a learned rotation (principal axes, turned again where there are fewer of them than
bits, then alternating sign assignment and orthogonal Procrustes). A code is split into substrings of PART bits, each with its own
table of the keys that occur and their rows. If two codes differ in at most r bits, some substring differs in at most r // m bits (m
substrings): probing all keys within that distance in every table retrieves every code within the radius. Those within r by the
whole code, a small share where neighbours stand out, are reranked by their floats.

Inner products become angles by one more component, sqrt(M^2 - |x|^2) for rows and 0 for queries (M: the largest norm).
The rotation and the radius are learned on at most SAMPLE rows, chosen by a hash of vec_id; every row is indexed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.blocks import leading, search, usable
from strandlake.llm.shared import table

SAMPLE, SAMPLE_QUERIES = 8192, 256
#: Share of a sample's true neighbours that the learned radius holds.
HELD = 0.97
#: Bits of a code, and of a substring.
BITS, PART = 256, 64


@dataclass
class Coder:
    mean: np.ndarray
    rotation: np.ndarray
    largest: float
    radius: int

    def _lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        x = x / self.largest
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))
        return np.concatenate([x, more[:, None]], 1)

    def codes(self, x: np.ndarray, query: bool) -> np.ndarray:
        """One number of PART bits per substring."""
        x = x if x.shape[1] + 1 == len(self.rotation) else np.pad(x, ((0, 0), (0, max(0, len(self.rotation) - 1 - x.shape[1]))))[:, : len(self.rotation) - 1]
        return np.packbits(self._lifted(x, query) @ self.rotation > 0, axis=1).view(np.uint64)


def learn(x: np.ndarray, largest: float, k: int, rounds: int = 40) -> Coder:
    """Rotation by principal axes and iterative quantisation; radius so that HELD of the sample's true neighbours are within."""
    rng = np.random.default_rng(3)
    largest = largest or 1.0
    coder = Coder(np.zeros(0), np.zeros(0), largest, 0)
    lifted = coder._lifted(x, False)
    axes = [np.linalg.eigh(lifted.T @ lifted)[1][:, ::-1]]
    while sum(a.shape[1] for a in axes) < BITS:
        axes.append(axes[0] @ np.linalg.qr(rng.normal(size=(axes[0].shape[1],) * 2))[0])
    axes = np.concatenate(axes, 1)[:, :BITS]
    projected = lifted @ axes
    turn = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(rounds):
        signs = np.where(projected @ turn > 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(signs.T @ projected)
        turn = (u @ v).T
    coder.rotation = axes @ turn
    n = min(SAMPLE_QUERIES, len(x))
    product = x[:n] @ x.T
    product[np.arange(n), np.arange(n)] = -np.inf
    near = np.argsort(-product, axis=1)[:, : min(k, max(1, len(x) - 1))]
    a, b = coder.codes(x[:n], True), coder.codes(x, False)
    far = np.bitwise_count(a[:, None, :] ^ b[near]).sum(2)
    coder.radius = int(np.quantile(far, HELD)) if far.size else BITS
    return coder


class Tables:
    """The substring tables of a block of codes: keys in order, and the rows of each."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.m = codes, codes.shape[1]
        self.orders = [np.argsort(codes[:, s], kind="stable").astype(np.int32) for s in range(self.m)]
        self.keys, self.counts = zip(*[np.unique(codes[:, s], return_counts=True) for s in range(self.m)], strict=True)
        self.probed = self.reranked = 0

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose codes differ from code in at most radius bits."""
        got = np.zeros(len(self.codes), bool)
        for s in range(self.m):
            near = np.bitwise_count(self.keys[s] ^ code[s]) <= radius // self.m
            got[self.orders[s][np.repeat(near, self.counts[s])]] = True
        rows = np.flatnonzero(got)
        found = rows[np.bitwise_count(self.codes[rows] ^ code).sum(1) <= radius]
        self.probed, self.reranked = self.probed + len(rows), self.reranked + len(found)
        return found


def kernel(coder: Coder, k: int):
    def run(qi, q, ci, c):
        tables, asked = Tables(coder.codes(c, False)), coder.codes(q, True)
        step = tables.m  # one bit more in every substring
        at, ids, scores = [], [], []
        own = np.searchsorted(ci, qi, "right") - np.searchsorted(ci, qi)
        for i in range(len(qi)):
            radius = coder.radius
            while True:  # a block with too few codes in the radius is probed further
                found = tables.within(asked[i], radius)
                if len(found) >= min(k + own[i], len(ci)):
                    break
                radius += step
            found = found[ci[found] != qi[i]]
            score = c[found] @ q[i]
            best = leading(np.zeros(len(found), np.int64), ci[found], score, k)
            at.append(np.full(len(best), i)), ids.append(ci[found][best]), scores.append(score[best])
        return np.concatenate(at), np.concatenate(ids), np.concatenate(scores)

    return run


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """The k largest inner products found for each query: query_id, rank, vec_id, score (of the original vectors, in double precision).

    vectors: vec_id, embedding. Null, empty, zero and non-finite vectors take no part; shorter vectors are filled with zeros; rows of a repeated
    vec_id are one candidate each and one query each. Fewer than k candidates: all. Ties go to the smaller vec_id. An empty table gives an
    empty result; other columns are ignored.
    """
    good = table(usable(vectors, allow_zero=False), "usable")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    largest = good.agg(F.max(norm).alias("m")).first().m or 1.0
    sample = [r.embedding for r in good.orderBy(F.xxhash64(F.lit(11), "vec_id"), "vec_id").limit(SAMPLE).select("embedding").toLocalIterator()]
    if not sample:
        return good.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    width = max(map(len, sample))
    x = np.zeros((len(sample), width))
    for i, v in enumerate(sample):
        x[i, : len(v)] = v
    return search(good, is_query, k, kernel(learn(x, float(largest), k), k), "double")
