"""Approximate nearest neighbours: an inverted multi-index.

Both halves of a vector are quantised by centroids of their own. A query walks the pairs of centroids
in order of their summed distance with a heap, takes whole cells until it has enough entries, and
scores the entries on the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellquarry.llm.common import hash_sample
from cellquarry.llm.vectors import columns, common_size, distinct, nearest, queries_of, search_blocks, usable


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centre = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        cell = closest(x, centre)
        total = np.zeros_like(centre)
        np.add.at(total, cell, x)
        n = np.bincount(cell, minlength=len(centre))
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
    return centre


def closest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    norm = (centre**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 8192] @ centre.T - norm, axis=1) for i in range(0, len(x), 8192)] or [np.zeros(0, np.int64)])


def walk(left: np.ndarray, right: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells by rising summed distance until they hold ``enough`` entries; a heap holds the front of the walk."""
    by_left, by_right = np.argsort(left, kind="stable").tolist(), np.argsort(right, kind="stable").tolist()
    x, y = left[by_left].tolist(), right[by_right].tolist()
    heap, out, got, width = [(x[0] + y[0], 0, 0)], [], 0, len(y)
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        cell = by_left[i] * width + by_right[j]
        if counts[cell]:
            out.append(cell)
            got += counts[cell]
        if j + 1 < width:
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return out


class MultiIndex:
    def __init__(self, sample: np.ndarray, centroids: int):
        self.half = (sample.shape[1] + 1) // 2
        self.left, self.right = kmeans(sample[:, : self.half], centroids), kmeans(sample[:, self.half :] if sample.shape[1] > 1 else np.zeros((1, 1)), centroids)

    @property
    def cells(self) -> int:
        return len(self.left) * len(self.right)

    def assign(self, x: np.ndarray) -> np.ndarray:
        b = x[:, self.half :] if x.shape[1] > 1 else np.zeros((len(x), 1))
        return closest(x[:, : self.half], self.left) * len(self.right) + closest(b, self.right)

    def probes(self, query: np.ndarray, counts: list[int], enough: int) -> np.ndarray:
        b = query[self.half :] if len(query) > 1 else np.zeros(1)
        return np.array(walk(-(self.left @ query[: self.half]), -(self.right @ b), counts, enough), np.int64)

    def share(self, sample: np.ndarray, recall: float, k: int, queries: int = 200) -> float:
        """The share of the entries that a query's cells must hold so that ``recall`` of the k nearest, by brute force over the sample, lie in them."""
        cell = self.assign(sample)
        counts, need = np.bincount(cell, minlength=self.cells), []
        for i in range(min(queries, len(sample))):
            score = sample @ sample[i]
            score[i] = -np.inf
            best = np.argsort(-score, kind="stable")[: min(k, len(sample) - 1)]
            order = self.probes(sample[i], counts.tolist(), len(sample))
            before = np.zeros(self.cells)
            before[order] = np.cumsum(counts[order]) - counts[order]
            need += before[cell[best]].tolist()
        return (float(np.quantile(need, recall, method="higher")) + 1) / len(sample) if need else 1.0


class Block:
    """Distinct vectors of one partition, in lists by cell."""

    def __init__(self, index: MultiIndex, ids: np.ndarray, vecs: np.ndarray, k: int):
        vecs, own = distinct(ids, vecs, k + 1)
        cell = index.assign(vecs)
        order = np.argsort(cell, kind="stable")
        self.vecs, self.ids = vecs[order], [own[i] for i in order.tolist()]
        self.longest = float(np.sqrt((vecs**2).sum(axis=1).max(initial=0.0)))
        self.cells, first = np.unique(cell[order], return_index=True)
        self.cut = [*first.tolist(), len(order)]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, taken: np.ndarray, k: int, step: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, scores) from the cells that each query takes (``taken``: a bool for each query and cell)."""
        for s in range(0, len(queries), step):
            some = queries[s : s + step]
            score = np.full((len(some), len(self.vecs)), -np.inf)
            for c, a, b in zip(self.cells.tolist(), self.cut, self.cut[1:], strict=False):
                who = np.flatnonzero(taken[s : s + step, c])
                if len(who):
                    score[who, a:b] = some[who] @ self.vecs[a:b].T
            for i in range(len(some)):
                yield int(query_ids[s + i]), *self.best(int(query_ids[s + i]), some[i], score[i], k)

    def best(self, query_id: int, query: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        least = np.partition(score, len(score) - k - 1)[len(score) - k - 1] if len(score) > k + 1 else -np.inf
        margin = 4 * len(query) * np.finfo(float).eps * self.longest * np.sqrt((query**2).sum())  # how far two orders of summation can differ
        rows = np.flatnonzero((score >= least - margin) & (score > -np.inf))
        ids = [self.ids[r] for r in rows.tolist()]
        exact = np.array([(self.vecs[r] * query).sum() for r in rows.tolist()])
        exact = np.repeat(exact, [len(i) for i in ids])
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        own = ids != query_id
        ids, exact = ids[own], exact[own]
        top = np.lexsort((ids, -exact))[:k]
        return ids[top], exact[top]


def deal(counts: np.ndarray, most: int, least_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """First block of each cell and how many blocks it is split into; cells follow each other until a block holds about ``most`` entries."""
    most = max(1, min(most, -(-int(counts.sum()) // least_blocks)))
    parts = np.maximum(-(-counts // most), 1)
    first, block, held = np.zeros(len(counts), np.int64), 0, 0
    for c, (n, p) in enumerate(zip(counts.tolist(), parts.tolist(), strict=True)):
        if held and (held + n > most):
            block, held = block + 1, 0
        first[c] = block
        if p > 1:
            block, held = block + p, 0
        else:
            held += n
    return first, parts


def nearest_neighbours(vectors: DataFrame, k: int = 20, modulo: int = 20, centroids: int | None = None, sample_rows: int = 20_000, recall: float = 0.97, block_bytes: int = 32 << 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each row whose id ``modulo`` divides.

    The centroids, 4 n**(1/4) of each half unless given (1024 at most), are fitted on about ``sample_rows`` vectors (the bound of the
    index's sample, chosen by the hash of id and vector); every row is indexed. A query takes cells, nearest first, until
    they hold a share of the entries: the least that finds ``recall`` of the nearest within the sample, against brute
    force. Cells lie in blocks of about ``block_bytes``, a fuller cell in several; a query travels to the blocks that hold its
    cells. Vectors that are null, zero, of another size than most, or hold null or non-finite components
    take no part, nor do null ids. Rows that repeat id and vector count once; equal vectors of other
    ids all count, ties to the smaller id. Without candidates a query has no rows.
    """
    spark = vectors.sparkSession
    v = usable(vectors, id_col, vec_col, zero=False)
    dims, n = common_size(v)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = v.where(F.size("vec") == dims)
    some = hash_sample(v, ["vec_id", "vec"], sample_rows, n).distinct().limit(2 * sample_rows).toArrow()
    if not len(some):  # all rows are copies of few
        some = v.limit(sample_rows).toArrow()
    sample = columns(some.combine_chunks().to_batches()[0], dims)
    index = MultiIndex(sample, centroids or min(max(round(4 * n**0.25), 4), 1024))
    share = index.share(sample, recall, k)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vec"), pa.array(shared.value.assign(columns(b, dims)), pa.int64())], ["vec_id", "vec", "cell"])

    celled = v.mapInArrow(assign, "vec_id long, vec array<double>, cell long")
    counts = np.zeros(index.cells, np.int64)
    for r in celled.groupBy("cell").agg(F.count("*").alias("n")).collect():  # a row for each cell, centroids**2 at most
        counts[r.cell] = r.n
    first, parts = deal(counts, block_bytes // (dims * 8), spark.sparkContext.defaultParallelism)
    enough = max(int(np.ceil(share * n)), k + 1)
    plan = spark.sparkContext.broadcast((counts.tolist(), enough, first, parts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts = plan.value[2:]
        for b in batches:
            cell = b.column("cell").to_numpy()
            split = b.column("part").to_numpy() % parts[cell]
            yield pa.RecordBatch.from_arrays([pa.array(first[cell] + split, pa.int32()), b.column("vec_id"), b.column("vec")], ["block", "vec_id", "vec"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, enough, first, parts = plan.value
        index = shared.value
        for b in batches:
            out, of, masks = [], [], []
            for i, q in enumerate(columns(b, dims)):
                cells = index.probes(q, counts, enough)
                bits = np.zeros(index.cells, np.uint8)
                bits[cells] = 1
                one, many = np.unique(first[cells[parts[cells] == 1]]), cells[parts[cells] > 1]
                blocks = np.unique(np.concatenate([one, *(np.arange(first[c], first[c] + parts[c]) for c in many.tolist())]))
                out.append(blocks)
                of += [i] * len(blocks)
                masks += [np.packbits(bits).tobytes()] * len(blocks)
            own = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out) if out else [], pa.int32()), b.column("vec_id").take(own), b.column("vec").take(own), pa.array(masks, pa.binary())], ["block", "vec_id", "vec", "taken"])

    salted = celled.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 31)))
    entries = salted.mapInArrow(place, "block int, vec_id long, vec array<double>")
    queries = queries_of(v, modulo).repartition(spark.sparkContext.defaultParallelism).mapInArrow(route, "block int, vec_id long, vec array<double>, taken binary")

    def search(own: Block, ids: np.ndarray, vecs: np.ndarray, taken: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for s in range(0, len(ids), 256):
            bits = np.unpackbits(np.frombuffer(b"".join(taken[s : s + 256]), np.uint8).reshape(len(taken[s : s + 256]), -1), axis=1)
            yield from own.search(ids[s : s + 256], vecs[s : s + 256], bits, k)

    return nearest(search_blocks(entries, queries, dims, lambda ids, vecs: Block(shared.value, ids, vecs, k), search, "double"), k)
