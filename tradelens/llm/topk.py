"""Exact top-k inner products by no-random-access aggregation, in blocks.

Each block of candidates keeps one sorted list of its vectors' components per dimension.  For a
query, a list is read from the top where the query's component is positive and from the bottom where
it is negative.  After a number of entries of every list, a candidate's score lies between a lower
bound (unread components count as the list's last value) and an upper bound (unread components count
as the value just read).  Reading goes on until few candidates reach the k-th best lower bound; all
others cannot qualify, whatever their unread components are.  The scores of those left are then
resolved exactly.  All queries of a block read the same lists, so their bounds are matrix products.

How it runs: candidates and queries are hashed into blocks of bounded size; every block of queries
meets every block of candidates in one task, which returns at most k rows for each query, and a
ranked window (limited before its shuffle) merges the blocks.

Cases: vectors that are null or hold null or non-finite components take no part; only vectors of
equal length are compared; ties go to the smaller id; a query with fewer than k candidates returns
all; null ids take no part; repeated ids are separate candidates, and a query skips the candidates with its
own id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Shares of a list after which the bounds are compared.
DEPTHS = (0.05, 0.15, 0.3, 0.5, 0.75, 1.0)
_RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("read", pa.float64())])


def scaled_vectors(df: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id long, v array<long>``: floor(scale * x) of every usable vector."""
    vec = df[vec_col].cast("array<double>")
    usable = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (df.where(vec.isNotNull() & usable & df[id_col].isNotNull())
            .select(df[id_col].cast("long").alias("id"),
                    F.transform(vec, lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v")))


def block_topk(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
               k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The k best candidates of every query: arrays of query id, candidate id, score, share of the lists read.

    ``queries`` (q x d) and ``vectors`` (n x d) are whole numbers as int64.
    """
    n = len(ids)
    if not n or not len(query_ids):
        return []
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    if bound >= 2.0 ** 62:
        raise OverflowError("inner products do not fit 64-bit whole numbers; use a smaller scale")
    kind = np.float32 if bound < 2 ** 24 else np.float64 if bound < 2 ** 53 else np.int64  # exact in each
    x, q = vectors.astype(kind), queries.astype(kind)
    lists = np.sort(x, axis=0)
    low, high = lists[0], lists[-1]
    up, down = np.maximum(q, 0), np.minimum(q, 0)  # lists read from the top, from the bottom
    active = np.arange(len(query_ids))
    out = []
    for share in DEPTHS:
        depth = max(1, int(np.ceil(share * n)))
        top, bottom = lists[n - depth], lists[depth - 1]  # the values read last
        best = np.maximum(x, top) @ up[active].T + np.minimum(x, bottom) @ down[active].T
        least = np.where(x >= top, x, low) @ up[active].T + np.where(x <= bottom, x, high) @ down[active].T
        own = ids[:, None] == query_ids[active][None, :]
        if own.any():
            floor = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
            least[own] = floor
            best[own] = floor
        if n > k:
            kth = np.partition(least, n - k, axis=0)[n - k]
            qualified = (best >= kth) & ~own
        else:
            qualified = ~own
        done = (qualified.sum(axis=0) <= max(8 * k, n // 64)) | (depth == n)
        if done.any():
            row, col = np.nonzero(qualified[:, done])
            which = active[done][col]
            score = np.einsum("ij,ij->i", vectors[row], queries[which])
            order = np.lexsort((ids[row], -score, which))
            row, which, score = row[order], which[order], score[order]
            starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else np.zeros(0, int)
            rank = np.arange(len(which)) - np.repeat(starts, np.diff(np.r_[starts, len(which)]))
            keep = rank < k
            out.append((query_ids[which[keep]], ids[row[keep]], score[keep], np.full(keep.sum(), share)))
            active = active[~done]
        if not len(active):
            break
    return out


def _matrix(table: pa.Table, side: str) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column(f"{side}_id").to_numpy()
    flat = table.column(f"{side}_v").combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.Array) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return ids, flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(ids), -1)


def _block(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _RESULT.empty_table()
        ids, x = _matrix(left, "cb")
        query_ids, q = _matrix(right, "qb")
        found = block_topk(query_ids, q, ids, x, k)
        if not found:
            return _RESULT.empty_table()
        return pa.table([np.concatenate(c) for c in zip(*found)], schema=_RESULT)
    return run


def nra_topk(queries: DataFrame, candidates: DataFrame, k: int = 5, block_rows: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score, read`` of the k best candidates of every query.

    Both inputs are ``id long, v array<long>``.  ``read`` is the share of the sorted lists that was read
    in the block that the candidate came from.
    """
    n_c = max(1, -(-candidates.select("id").count() // block_rows))
    n_q = max(1, -(-queries.select("id").count() // block_rows))

    def placed(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        # every block of the one side is sent to each block of the other; both sides may come from one
        # frame, so their columns are named anew
        return df.select(F.col("id").alias(f"{own}_id"), F.col("v").alias(f"{own}_v"), F.size("v").alias("dim"),
                         F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int").alias(own),
                         F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

    left = placed(candidates, "cb", n_c, "qb", n_q).groupBy("cb", "qb", "dim")
    right = placed(queries, "qb", n_q, "cb", n_c).groupBy("cb", "qb", "dim")
    found = left.cogroup(right).applyInArrow(_block(k), "query_id long, vec_id long, score long, read double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score", "read"))


def op2(embeddings: DataFrame) -> DataFrame:
    vectors = scaled_vectors(embeddings)
    return nra_topk(vectors.where(F.col("id") % 50 == 0), vectors).drop("read")


ORACLE_SQL = """
with usable as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
  from usable q join usable c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(c.v) = len(q.v)
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 5
"""
