"""Reading vectors for the search operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable(vectors: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """(vec_id long, vec array<double>): rows with an id and a vector without null or non-finite components; ``zero``: zero vectors too."""
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("vec")).where("vec_id is not null and vec is not null and size(vec) > 0")
    v = v.where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return v if zero else v.where(F.exists("vec", lambda x: x != 0))


def common_size(vectors: DataFrame) -> tuple[int, int]:
    """The most frequent number of components (ties: the smaller) and how many vectors have it; vectors of others take no part."""
    found = vectors.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return (found["n"], found["count"]) if found else (0, 0)


def columns(batch: pa.RecordBatch, dims: int, vec: str = "vec") -> np.ndarray:
    """A batch's vectors as rows of doubles."""
    return np.asarray(batch.column(vec).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def once(ids: np.ndarray, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by id, those that repeat id and vector once."""
    rows = np.ascontiguousarray(vecs + 0.0).view(np.dtype((np.void, vecs.shape[1] * 8))).ravel()
    order = np.lexsort((np.unique(rows, return_inverse=True)[1], ids))
    ids, vecs, rows = ids[order], vecs[order], rows[order]
    keep = np.concatenate([[True], (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])])[: len(ids)]
    return ids[keep], vecs[keep]


def distinct(ids: np.ndarray, vecs: np.ndarray, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct vectors and, for each, the ``most`` smallest of its ids (ids come sorted): no more can be among the nearest."""
    if not len(ids):
        return vecs, []
    rows = np.ascontiguousarray(vecs + 0.0).view(np.dtype((np.void, vecs.shape[1] * 8))).ravel()
    _, one, which = np.unique(rows, return_index=True, return_inverse=True)
    order = np.argsort(which, kind="stable")
    cut = np.searchsorted(which[order], np.arange(len(one) + 1))
    return vecs[one], [ids[order[a : min(b, a + most)]] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def queries_of(vectors: DataFrame, modulo: int) -> DataFrame:
    """(vec_id, vec) of the ids divisible by ``modulo``; a repeated id counts once, with its least vector."""
    return vectors.where(F.col("vec_id") % modulo == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def search_blocks(entries: DataFrame, queries: DataFrame, dims: int, build: Callable[[np.ndarray, np.ndarray], Any], search: Callable[[Any, np.ndarray, np.ndarray, list], Iterator[tuple[int, np.ndarray, np.ndarray]]], score: str) -> DataFrame:
    """(query_id, vec_id, score): each block of ``entries`` (block, vec_id, vec) searched for its ``queries`` (block, vec_id, vec, taken binary).

    Both travel to the block's task, which builds its lists from the entries (they come first, and a block is of
    bounded size) and streams the queries past them; nothing goes through the driver.
    """
    both = entries.select("block", F.lit(False).alias("asks"), "vec_id", "vec", F.lit(None).cast("binary").alias("taken")).unionByName(queries.select("block", F.lit(True).alias("asks"), "vec_id", "vec", "taken"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vecs, own, held, full = None, [], [], None, 0, 1 << 16
        for batch in batches:
            block, asks, vec_id = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "asks", "vec_id"))
            vec = columns(batch, dims)
            cut = np.flatnonzero((block[1:] != block[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(block)], strict=True):
                if a == b:
                    continue
                if block[a] != now:
                    now, ids, vecs, own, held, full = block[a], [], [], None, 0, 1 << 16
                if not asks[a]:
                    ids.append(vec_id[a:b])
                    vecs.append(vec[a:b].copy())
                    held += b - a
                    if held >= full:  # rows that repeat don't pile up
                        x, y = once(np.concatenate(ids), np.concatenate(vecs))
                        ids, vecs, held, full = [x], [y], len(x), max(full, 2 * len(x))
                    continue
                if own is None and ids:
                    own = build(*once(np.concatenate(ids), np.concatenate(vecs)))
                    ids, vecs = [], []
                if own is None:  # a block without entries
                    continue
                found = list(search(own, vec_id[a:b], vec[a:b], batch.column("taken").slice(a, b - a).to_pylist()))
                if found:
                    of = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
                    yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(np.concatenate([f[1] for f in found]), pa.int64()), pa.array(np.concatenate([f[2] for f in found]))], ["query_id", "vec_id", "score"])

    return both.repartition("block").sortWithinPartitions("block", "asks").mapInArrow(run, f"query_id long, vec_id long, score {score}")


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ties to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
