"""SimHash near-duplicates: fingerprints, a self-join of binary tries and connected groups."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellquarry.llm.common import forget, fresh, id_text, pieces_of, texts_of, written

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
U64 = np.uint64


def fingerprint(text: str, k: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the XXH64 of the k-word shingles (lower-cased A-Z, repeats included)."""
    words = WORD.findall(text.encode().lower())
    if not words:
        return 0
    data, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - k + 1
    if n <= 1:
        return digest(data, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = np.array([digest(data[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)], ">u8")
    total = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        total += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fp long: the fingerprint's 64 bits, signed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch):
                fp = np.array([fingerprint(t, k) for t in texts_of(part)], U64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def least_label(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the groups at both ends of each edge; a group's label is its smallest member."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        new = label.copy()
        np.minimum.at(new, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = new[new]
            if (up == new).all():
                break
            new = up
        label = new[label]


def trie_links(fp: np.ndarray, root: np.ndarray, depth: int, budget: int, most: int = 1 << 20) -> np.ndarray:
    """Group labels of fingerprints linked, within one root, at ``budget`` differing bits or fewer.

    ``fp`` (uint64) is sorted within each root (int64, sorted); the first ``depth`` bits are the same
    under a root. A node of a root's binary trie is a range of the array; pairs of nodes go down the
    bits together and differing bits add up. A pair is dropped beyond the budget, or when both its
    nodes lie in one group already; lower budgets run first, so dense groups close early.
    """
    n = len(fp)
    label = np.arange(n)
    edge = np.flatnonzero(np.diff(root)) + 1
    lo, hi = np.concatenate([[0], edge]), np.concatenate([edge, [n]])
    big = hi - lo > 1
    lo, hi = lo[big], hi[big]
    if not len(lo):
        return label
    ones: dict[int, np.ndarray] = {}

    def split(level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the ones begin in the ranges a..b at a bit."""
        if level not in ones:
            ones[level] = np.concatenate([[0], np.cumsum(((fp >> U64(63 - level)) & U64(1)).astype(np.int32))])
        c = ones[level]
        return b - (c[b] - c[a])

    for limit in range(1, budget + 1):
        turns = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        todo, found = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int8))], []
        while todo:
            level, a, b, c, d, cost = todo.pop()
            if len(a) > most:
                half = len(a) // 2
                todo += [(level, *(x[s] for x in (a, b, c, d, cost))) for s in (slice(half), slice(half, None))]
                continue
            one_group = (turns[a] == turns[b - 1]) & (turns[c] == turns[d - 1]) & (label[a] == label[c])
            single = (b - a == 1) & (d - c == 1)
            leaf = single & ~one_group
            if leaf.any():
                x, y = a[leaf], c[leaf]
                near = np.bitwise_count(fp[x] ^ fp[y]) <= limit
                found.append((x[near], y[near]))
            go = ~(one_group | single)
            if level >= 64 or not go.any():
                continue
            a, b, c, d, cost = a[go], b[go], c[go], d[go], cost[go]
            m, k = split(level, a, b), split(level, c, d)
            same = a == c
            parts = [(a, m, c, k, cost), (m, b, k, d, cost), (a, m, k, d, cost + 1), (m[~same], b[~same], c[~same], k[~same], cost[~same] + 1)]
            nxt = [np.concatenate(x) for x in zip(*parts, strict=True)]
            ok = (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & (nxt[4] <= limit) & ~((nxt[0] == nxt[2]) & (nxt[1] - nxt[0] == 1))
            if ok.any():
                todo.append((level + 1, *(x[ok] for x in nxt)))
        if found:
            label = least_label(label, np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
    return label


def bit_tables(budget: int, blocks: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each way to choose blocks - budget of the blocks of 64 bits: their bits and all blocks (start, width), the chosen first."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    spans = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [(sum(s[1] for s in own), [*own, *(s for s in spans if s not in own)]) for own in combinations(spans, blocks - budget)]


def blocks_for(rows: int, budget: int, bucket: int = 4096) -> int:
    """The fewest blocks whose tables have about ``bucket`` evenly spread fingerprints under a root."""
    return next(b for b in range(budget + 1, 64) if rows / 2.0 ** (64 * (b - budget) / b) <= bucket)


def reordered(fp: Column, spans: list[tuple[int, int]]) -> Column:
    """The 64 bits of fp with its blocks in another order."""
    out, at = None, 0
    for start, width in spans:
        part = F.shiftleft(F.shiftrightunsigned(F.shiftleft(fp, start), 64 - width), 64 - at - width)
        out, at = part if out is None else out.bitwiseOR(part), at + width
    return out


def near_edges(nodes: DataFrame, budget: int = 4, rows: int | None = None, blocks: int | None = None) -> DataFrame:
    """Spanning edges (child, parent) of ``nodes`` (node long, fp long; distinct fp) that link at ``budget`` bits or fewer.

    Of ``blocks`` blocks of bits, blocks - budget at least are equal between linked fingerprints. Each
    fingerprint enters a table for every choice of so many blocks, its bits reordered until those
    lead; equal leading bits share a root, from which trie_links() goes on. A link is found in some
    table for certain. More fingerprints (``rows``) take more blocks, so that roots stay small. Only
    enough edges to connect a group leave a task, not its pairs.
    """
    tables = bit_tables(budget, blocks or blocks_for(rows or 0, budget))
    widths = [w for w, _ in tables]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), reordered(F.col("fp"), spans).alias("r")) for i, (_, spans) in enumerate(tables))))
    keyed = nodes.select("node", each.alias("x")).select("node", "x.t", "x.r")
    keyed = keyed.withColumn("key", F.coalesce(*(F.when(F.col("t") == i, F.shiftrightunsigned("r", 64 - w)) for i, w in enumerate(widths))))
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), (rows or 0) * len(tables) // 500_000 + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("node").to_numpy(), b.column("t").to_numpy(), b.column("r").to_numpy().view(U64), b.column("key").to_numpy()) for b in batches]
        if not got:
            return
        node, t, r, k = (np.concatenate(x) for x in zip(*got, strict=True))
        for i, w in enumerate(widths):
            mine = t == i
            if not mine.any():
                continue
            n, f, q = node[mine], r[mine], k[mine]
            order = np.lexsort((f, q))
            n, f, q = n[order], f[order], q[order]
            label = trie_links(f, q, w, budget)
            least = np.full(len(n), np.iinfo(np.int64).max)
            np.minimum.at(least, label, n)
            parent = least[label]
            child = parent != n
            yield pa.RecordBatch.from_arrays([pa.array(n[child]), pa.array(parent[child])], ["child", "parent"])

    return keyed.repartition(parts, "t", "key").mapInArrow(run, "child long, parent long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (child, parent; child > parent), for nodes with an edge.

    Alternates large-star and small-star steps until the stars stand still; each step is written to
    the shared folder, nothing is collected but two numbers.
    """
    now = written(edges.select("child", "parent"))

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))).first())

    seen = mark(now)
    while seen[0]:
        both = now.select(F.col("child").alias("u"), F.col("parent").alias("v")).unionByName(now.select(F.col("parent").alias("u"), F.col("child").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("child"), F.col("m").alias("parent")).distinct()
        top = large.groupBy("child").agg(F.min("parent").alias("m"))
        small = large.join(top, "child").select(F.explode(F.array(F.struct("child", F.col("m").alias("parent")), F.struct(F.col("parent").alias("child"), F.col("m").alias("parent")))).alias("e")).select("e.*").where("child != parent").distinct()
        new = written(small)
        forget(now)
        got, now = mark(new), new
        if got == seen:
            break
        seen = got
    return now.select(F.col("child").alias("node"), F.col("parent").alias("component"))


def near_duplicates(docs: DataFrame, budget: int = 4, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row.

    Rows whose fingerprints differ in ``budget`` bits or fewer are linked; component_id is the smallest doc_id
    reachable. A null or empty text, or one of white space, has fingerprint zero, linked like any
    other. Rows that repeat an id are rows of their own, linked by their texts alone, so that an id may stand in several groups.
    A row with a null id links like any other, but names a group only if the group has no id (then component_id is null).
    """
    marked = written(fingerprints(docs, k, id_col, text_col))
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(near_edges(nodes.select(F.col("fp").alias("node"), "fp"), budget, nodes.count()))
    groups = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    named = groups.groupBy("group").agg(F.min("least").alias("component_id"))
    return marked.join(groups.join(named, "group").select("fp", "component_id"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, budget: int = 4, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each near-duplicate group; all columns stay.

    Of rows that repeat an id the one with the least text stays, if any does; rows without an id stay as they are.
    """
    marked = written(near_duplicates(docs, budget, k, id_col, text_col))
    key = fresh("kept_id", docs.columns)
    keep = marked.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    own = docs.join(keep, docs[id_col].cast("long") == keep[key], "left").where(keep[key].isNotNull() | docs[id_col].isNull()).drop(key)
    if marked.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        row = F.struct(*(own[c] for c in own.columns))
        least = own.where(own[id_col].isNotNull()).groupBy(own[id_col].alias(key)).agg(F.min_by(row, F.struct(own[text_col].cast("string").alias("t"), F.to_json(row).alias("r"))).alias("row"))
        return least.select("row.*").unionByName(own.where(own[id_col].isNull()))
    return own
