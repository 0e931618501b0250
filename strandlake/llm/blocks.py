"""Vectors in blocks: a stated set of queries against all rows, a block of queries and a block of candidates at a time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.shared import table

BLOCK_ROWS = 16_384


def usable(vectors: DataFrame, allow_zero: bool = True, allow_empty: bool = False) -> DataFrame:
    """vec_id, embedding (array<double>) of rows whose id and components are present and finite.

    Rows of null vec_id, of null vectors and of vectors with null, NaN or infinite components are left out, empty ones too unless
    allow_empty (with allow_zero=False, zero vectors too).
    """
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    v = v if allow_empty else v.where(F.size("embedding") > 0)
    return v if allow_zero else v.where(F.exists("embedding", lambda x: x != 0))


def search(vectors: DataFrame, is_query, k: int, kernel, score_type: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """The k best candidates of each query by kernel: query_id, rank, vec_id, score.

    Candidates are dealt to blocks of about `rows` by a hash of their id, queries likewise; every pair of blocks is one group. kernel
    gets (query ids, query matrix, candidate ids, candidate matrix) and returns arrays query index, vec_id, score with at least the k
    best of each query in that block; only these leave the task. A query is never its own candidate.
    """
    spark = vectors.sparkSession
    stored = table(vectors, "vectors")
    n = stored.count()
    n_query = stored.where(is_query).count()
    n_c, n_q = max(1, -(-n // rows)), max(1, -(-n_query // rows))
    deal = lambda parts, seed: F.pmod(F.xxhash64(F.lit(seed), F.col("vec_id")), F.lit(parts)).cast("int")
    cands = stored.select("vec_id", "embedding", deal(n_c, 1).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"))
    asks = stored.where(is_query).select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb"), deal(n_q, 2).alias("qb"))

    def block(key, queries, candidates):
        import pyarrow as pa

        kinds = {"bigint": pa.int64(), "double": pa.float64()}
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", kinds[score_type])])
        if not queries.num_rows or not candidates.num_rows:
            return schema.empty_table()
        (qi, q), (ci, c) = _matrix(queries), _matrix(candidates)
        width = max(q.shape[1], c.shape[1])
        q, c = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, c))
        order = np.argsort(ci, kind="stable")
        ci, c = ci[order], c[order]
        at, ids, scores = kernel(qi, q, ci, c)
        return pa.table([pa.array(qi[at]), pa.array(ids), pa.array(scores, kinds[score_type])], schema)

    found = asks.groupBy("cb", "qb").cogroup(cands.groupBy("cb", "qb")).applyInArrow(block, f"query_id bigint, vec_id bigint, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _matrix(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and vectors as rows; shorter ones are filled with zeros."""
    lists = vectors.column("embedding").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if (lengths == lengths[0]).all():
        return vectors.column("vec_id").to_numpy(), values.reshape(len(lengths), lengths[0])
    out = np.zeros((len(lengths), lengths.max()))
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return vectors.column("vec_id").to_numpy(), out


def leading(at: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest scores of each at, ties to the smaller id."""
    order = np.lexsort((ids, -scores, at))
    at = at[order]
    begin = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
    place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    return order[place < k]
