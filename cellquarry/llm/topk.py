"""Exact top-k search by Fagin's threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellquarry.llm.vectors import common_size, distinct, nearest, queries_of, search_blocks, usable


class SortedLists:
    """Integer vectors of one partition with a list of their rows for each dimension, by falling component."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, k: int):
        rows, self.ids = distinct(ids, vecs, k + 1)
        top = np.abs(rows).max(initial=0.0)
        self.exact = top * top * rows.shape[1] < 2.0**52  # then sums of products are exact in doubles
        self.rows = rows if self.exact else rows.astype(np.int64)
        self.lists = np.argsort(-rows, axis=0, kind="stable").T.astype(np.int32)
        self.steps = np.take_along_axis(self.rows, self.lists.T.astype(np.int64), axis=0).T

    def search(self, query_id: int, query: np.ndarray, k: int, first: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows other than the query's own; all that tie with the kth are seen before the walk stops."""
        q = query if self.exact else query.astype(np.int64)
        n = len(self.rows)
        dims = np.flatnonzero(q)
        down = q[dims] > 0
        seen = np.zeros(n, bool)
        score = np.zeros(n, self.rows.dtype)
        depth, step = 0, first
        while depth < n:
            end = min(n, depth + step)
            at = np.where(down[:, None], np.arange(depth, end), n - 1 - np.arange(depth, end))
            reached = np.zeros(n, bool)
            if len(dims):
                reached[self.lists[dims[:, None], at].ravel()] = True
            else:
                reached[:] = True
            new = np.flatnonzero(reached & ~seen)
            score[new] = self.rows[new] @ q
            seen[new] = True
            depth, step = end, step * 2
            done = np.flatnonzero(seen)
            if len(done) == n:
                break
            if len(done) > k + 1:
                bound = (self.steps[dims, at[:, -1]] * q[dims]).sum()
                if bound < np.partition(score[done], len(done) - k - 1)[len(done) - k - 1]:
                    break
        done = np.flatnonzero(seen)
        if len(done) > k + 1:
            done = done[score[done] >= np.partition(score[done], len(done) - k - 1)[len(done) - k - 1]]
        ids = [self.ids[r] for r in done]
        points = np.repeat(score[done], [len(i) for i in ids]).astype(np.int64)
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        own = ids != query_id
        ids, points = ids[own], points[own]
        best = np.lexsort((ids, -points))[:k]
        return ids[best], points[best]


def exact_top_k(vectors: DataFrame, k: int = 10, modulo: int = 100, scale: int = 1024, block_bytes: int = 32 << 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products, over floor(scale * component), for each row whose id ``modulo`` divides.

    Rows are dealt out by the hash of id and vector in blocks of about ``block_bytes``, each with its sorted lists; every query
    travels to every block. Vectors that are null, of another size than most, or hold null or non-finite components
    take no part, nor do null ids; zero vectors do. Rows that repeat id and vector count once; ties go to the
    smaller id. Scores are exact while they fit in a long.
    """
    spark = vectors.sparkSession
    v = usable(vectors, id_col, vec_col, zero=True)
    dims, n = common_size(v)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    v = v.where(F.size("vec") == dims).select("vec_id", F.transform("vec", lambda x: F.floor(x * scale).cast("double")).alias("vec"))
    blocks = max(spark.sparkContext.defaultParallelism, -(-n * dims * 8 // block_bytes))
    entries = v.withColumn("block", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks)).cast("int"))
    queries = queries_of(v, modulo).withColumn("taken", F.lit(None).cast("binary")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(own: SortedLists, ids: np.ndarray, vecs: np.ndarray, _: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for i, q in zip(ids.tolist(), vecs, strict=True):
            yield i, *own.search(i, q, k)

    return nearest(search_blocks(entries, queries, dims, lambda ids, vecs: SortedLists(ids, vecs, k), search, "long"), k)
