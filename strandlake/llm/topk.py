"""Exact top-k search over integer vectors by an impact-ordered index, score at a time.

Within a block of candidates each dimension has postings for positive and for negative query weights: the rows on that side of the
dimension's median, ordered by quantised impact (their distance from the median, rounded up), in segments of equal impact. Rows on the other
side can only lose by that dimension. A query reads segments of all dimensions in descending impact times weight and adds them to the
accumulators of their rows, which so bound every score from above, up to the next unread segment of each dimension. The bar is the
k-th best of exact scores of a few rows that lead so far. Processing stops when it is proved that all but a few rows lie below the bar,
few enough that scoring them costs less than reading on, or when no segment is left. All possible members, however many, are scored exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.blocks import leading, search, usable

#: Levels of quantised impact of a dimension's side; parts of the postings after which bounds are looked at.
LEVELS, LOOKS = 8, 3
#: Components beyond this are no exact doubles' products any more; such vectors are refused.
LARGEST = 1 << 24


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """Each component x as floor(scale * x), x as double; a component beyond LARGEST is an error."""
    def component(x):
        scaled = x * F.lit(float(scale))
        return F.when(F.abs(scaled) > LARGEST, F.raise_error("a component is too large for exact integer scores").cast("double")).otherwise(F.floor(scaled).cast("double"))

    return vectors.withColumn("embedding", F.transform("embedding", component))


class Index:
    """Postings of a block of candidates: matrix of integers, one row each."""

    def __init__(self, c: np.ndarray):
        self.c = c
        self.n, self.d = c.shape
        self.centre = np.floor(np.median(c, 0)) if self.n else np.zeros(self.d)
        #: By sign of the weight and dimension: the worth of a level, rows by descending level, and where each level's segment begins among them.
        self.step, self.rows, self.begin = np.ones((2, self.d)), [], np.zeros((2, self.d, LEVELS + 1), np.int64)
        for side, impact in enumerate((c - self.centre, self.centre - c)):
            self.step[side] = np.maximum(1.0, np.ceil(impact.max(0, initial=0) / LEVELS))
            level = np.ceil(np.maximum(impact, 0) / self.step[side]).astype(np.int8)
            for k in range(self.d):
                size = np.bincount(level[:, k], minlength=LEVELS + 1)
                self.rows.append(np.argsort(-level[:, k], kind="stable")[: self.n - size[0]])
                # begin[v]: rows above level v.
                self.begin[side, k] = self.n - np.cumsum(size)
        self.read = self.whole = self.scored = 0

    def members(self, q: np.ndarray, k: int) -> np.ndarray:
        """Indices of all candidates that can have one of the k best scores of the query q, ties included."""
        if self.n <= k:
            return np.arange(self.n)
        side = (q < 0).astype(np.int64)
        dims = np.arange(self.d)
        worth, begin = np.abs(q) * self.step[side, dims], self.begin[side, dims]
        # Segments of levels LEVELS .. 1 of each dimension, by descending worth.
        size = (begin[:, :-1] - begin[:, 1:]).ravel()
        value = (worth[:, None] * np.arange(1, LEVELS + 1)).ravel()
        held = np.flatnonzero((size > 0) & (value > 0))
        held = held[np.argsort(-value[held], kind="stable")]
        dim, level, size, value = held // LEVELS, held % LEVELS + 1, size[held], value[held]
        upto = np.cumsum(size)
        every = int(upto[-1]) if len(upto) else 0
        self.whole += every
        base, total, bar = float(q @ self.centre), np.zeros(self.n), -np.inf
        at = 0
        while True:
            to = min(len(size), int(np.searchsorted(upto, (upto[at - 1] if at else 0) + -(-every // LOOKS))) + 1) if at < len(size) else at
            if to > at:
                rows = np.concatenate([self.rows[side[j] * self.d + j][begin[j, v] : begin[j, v - 1]] for j, v in zip(dim[at:to], level[at:to], strict=True)])
                total += np.bincount(rows, np.repeat(value[at:to], size[at:to]), self.n)
            self.read += int(size[at:to].sum())
            at = to
            ahead = np.zeros(self.d)  # the next unread segment of each dimension: values fall, so the first one left
            left, first = np.unique(dim[at:], return_index=True)
            ahead[left] = value[at:][first]
            # Exact scores of rows that lead now: at least k rows score as much as the k-th of them.
            lead = np.argpartition(total, self.n - 2 * k)[self.n - 2 * k :] if self.n > 2 * k else np.arange(self.n)
            scores = self.c[lead] @ q
            bar = max(bar, float(np.partition(scores, len(scores) - k)[len(scores) - k]))
            possible = np.flatnonzero(total + ahead.sum() + base >= bar)
            if at >= len(size) or len(possible) * self.d <= every - upto[at - 1]:
                self.scored += len(possible)
                return possible


def kernel(k: int):
    def run(qi, q, ci, c):
        index = Index(c)
        # Sums of whole doubles are exact below 2**53.
        small = c.shape[1] * np.abs(c).max(initial=0) * np.abs(q).max(initial=0) < 1 << 53
        own = int((np.searchsorted(ci, qi, "right") - np.searchsorted(ci, qi)).max())
        at, ids, scores = [], [], []
        for i in range(len(qi)):
            found = index.members(q[i], k + own)
            found = found[ci[found] != qi[i]]
            score = (c[found] @ q[i]).astype(np.int64) if small else (c[found].astype(np.int64) * q[i].astype(np.int64)).sum(1)
            best = leading(np.zeros(len(found), np.int64), ci[found], score, k)
            at.append(np.full(len(best), i)), ids.append(ci[found][best]), scores.append(score[best])
        return np.concatenate(at), np.concatenate(ids), np.concatenate(scores)

    return run


def exact_top(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """The k highest integer inner products of each query: query_id, rank, vec_id, score (bigint); ties to the smaller vec_id.

    vectors: vec_id, embedding. Null vectors and those with null or non-finite components take no part; shorter vectors (empty ones too) are
    filled with zeros; rows of a repeated vec_id are one candidate each and one query each; an empty table gives an empty result. Scaled
    components beyond LARGEST are refused. Other columns are ignored.
    """
    return search(quantised(usable(vectors, allow_empty=True), scale), is_query, k, kernel(k), "bigint")
