import ast
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellquarry.llm import ann, topk

ROOT = Path(__file__).parents[2]
V = "vec_id long, embedding array<float>, vec string"


def vectors(spark, n=400, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[n // 2 :] = x[7]  # a common vector
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)]
    odd = [(n, None, "x"), (n + 1, [], "x"), (n + 2, [0.0] * dims, "x"), (n + 3, [float("nan")] * dims, "x"), (n + 4, [float("inf")] * dims, "x"), (n + 5, [None, *[1.0] * (dims - 1)], "x"), (None, rows[0][1], "x"), (n + 6, [1.0], "x"), rows[3], rows[3]]
    return spark.createDataFrame(rows + odd, V), x.astype(float)


def brute(x, ids, modulo, k):
    out = {}
    for q in range(0, len(ids), modulo):
        s = (x * x[q]).sum(axis=1)
        own = np.arange(len(ids)) != q
        best = np.lexsort((ids[own], -s[own]))[:k]
        out[int(ids[q])] = (ids[own][best].tolist(), s[own][best])
    return out


@pytest.mark.parametrize("block_bytes", [4096, 32 << 20])
def test_nearest(spark, block_bytes):
    df, x = vectors(spark)
    got = ann.nearest_neighbours(df, k=20, modulo=20, centroids=8, block_bytes=block_bytes).collect()
    want, by = brute(x, np.arange(400), 20, 20), {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == set(want)
    hits = 0
    for q, rows in by.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and q not in [r[1] for r in rows]
        assert all(abs(s - (x[q] * x[v]).sum()) < 1e-12 for _, v, s in rows)
        assert rows == [(i + 1, v, s) for i, (v, s) in enumerate(sorted(((r[1], r[2]) for r in rows), key=lambda p: (-p[1], p[0])))]
        hits += len({r[1] for r in rows} & set(want[q][0]))
    assert hits / (20 * len(want)) >= 0.9


def test_few_ids_with_many_vectors_are_searched(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(20 + i % 2, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(df, sample_rows=100).collect()
    query = np.array(min(r.tolist() for r in x[::2]))
    scores = sorted((float((query * r).sum()) for r in x[1::2]), reverse=True)
    assert {(r.query_id, r.vec_id) for r in got} == {(20, 21)} and [r.rank for r in got] == list(range(1, 21))
    assert all(any(abs(s - r.score) < 1e-9 for s in scores) for r in got) and abs(got[0].score - scores[0]) < 1e-9
    assert ann.nearest_neighbours(df.where("vec_id = 20"), sample_rows=1).count() == 0  # no candidates


def searched(x, k=20, queries=100):
    """Recall against brute force, and the share of the entries that a query scores."""
    n = len(x)
    index = ann.MultiIndex(x[: n // 2], round(4 * n**0.25))
    share = index.share(x[: n // 2], 0.97, k)
    block, counts = ann.Block(index, np.arange(n), x, k), np.bincount(index.assign(x), minlength=index.cells)
    who = np.arange(n - queries, n)
    taken = np.zeros((queries, index.cells), np.uint8)
    for i, q in enumerate(who):
        taken[i, index.probes(x[q], counts.tolist(), int(np.ceil(share * n)))] = 1
    hits = sum(len(set(ids.tolist()) & set(brute_one(x, q, k))) for q, ids, _ in block.search(who, x[who], taken, k))
    return hits / (k * queries), (taken * counts).sum() / (n * queries)


def test_recall_on_random_and_share_on_clustered_vectors():
    rng = np.random.default_rng(1)
    recall, share = searched(rng.normal(size=(5000, 32)))
    assert recall >= 0.95
    centre = rng.normal(size=(60, 32))
    near_recall, near_share = searched(centre[rng.integers(0, 60, 5000)] + 0.05 * rng.normal(size=(5000, 32)))
    assert near_recall >= 0.9 and near_share < 0.1 < share


def test_full_cells_are_split():
    counts = np.array([0, 5, 3, 40, 1, 1, 0, 10])
    first, parts = ann.deal(counts, 10, 1)
    assert parts.tolist() == [1, 1, 1, 4, 1, 1, 1, 1] and first.tolist() == [0, 0, 0, 1, 5, 5, 5, 6]


def brute_one(x, q, k):
    s = x @ x[q]
    s[q] = -np.inf
    return np.argsort(-s)[:k].tolist()


def test_walk_goes_by_rising_distance():
    rng = np.random.default_rng(2)
    left, right = rng.random(9), rng.random(7)
    order = ann.walk(left, right, [1] * 63, 63)
    sums = [left[c // 7] + right[c % 7] for c in order]
    assert len(set(order)) == 63 and sums == sorted(sums)
    assert ann.walk(left, right, [1] * 63, 5) == order[:5]


def test_search_of_few_or_none(spark):
    df, _ = vectors(spark)
    assert ann.nearest_neighbours(df.limit(0)).count() == 0 and topk.exact_top_k(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest_neighbours(few).collect()] == [(0, 1, 1, 0.5)]
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.exact_top_k(few).collect()] == [(0, 1, 1, 512 * 1024)]


def test_exact_top_k(spark):
    df, x = vectors(spark)
    x = np.vstack([x, np.zeros((3, 16))])[[*range(400), 402]]
    ids = np.array([*range(400), 402])
    want = brute(np.floor(x.astype(np.float32).astype(float) * 1024), ids, 100, 10)
    got = {}
    for r in topk.exact_top_k(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want.pop(402, None)
    assert {q: [v for v, _ in rows] for q, rows in got.items()} == {q: v for q, (v, _) in want.items()}
    assert all(s == int(t) for q in want for (_, s), t in zip(got[q], want[q][1], strict=True))


def test_vectors_with_clashing_columns(spark):
    df, _ = vectors(spark, n=60)
    more = df.withColumns({c: F.lit(1) for c in ("block", "cell", "asks", "taken", "part", "query_id", "rank", "score", "n")})
    for run in (lambda d: ann.nearest_neighbours(d, k=3), lambda d: topk.exact_top_k(d, k=3)):
        assert sorted(map(repr, run(more).collect())) == sorted(map(repr, run(df).collect()))


def test_threshold_walk_stops_early():
    """One strong dimension: the walk ends long before the lists do, with the right result."""
    rng = np.random.default_rng(3)
    x = np.floor(rng.random((5000, 4)) ** 40 * 1024)
    lists = topk.SortedLists(np.arange(5000), x, 10)
    q = np.array([1024.0, 0, 0, 0])
    ids, score = lists.search(-1, q, 10)
    s = (x @ q).astype(int)
    best = np.lexsort((np.arange(5000), -s))[:10]
    assert ids.tolist() == best.tolist() and score.tolist() == s[best].tolist()


def test_large_integers_stay_exact():
    x = np.array([[2.0**40, 1.0], [2.0**40, 2.0], [1.0, 1.0]])
    lists = topk.SortedLists(np.arange(3), x, 2)
    ids, score = lists.search(9, np.array([2.0**20, 1.0]), 2)
    assert not lists.exact and ids.tolist() == [1, 0] and score.tolist() == [2**60 + 2, 2**60 + 1]


# ---- pipeline and contract


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs, before = spark.read.parquet(f"{d}/documents.parquet"), None
    for name, stage in p.STAGES:
        out = stage(spark, docs, d)
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns
        rows = out.collect()
        assert rows and (before is None or len(rows) <= before)
        docs, before = spark.createDataFrame(rows, out.schema), len(rows)
    assert sorted(r.doc_id for r in p.run(spark, d).collect()) == sorted(r.doc_id for r in rows)


def test_stages_and_queries():
    import __spark_entry__ as e
    import corpus_pipeline as p

    assert 4 <= len(p.STAGES) <= 5 and p.ORACLE_SQL is None
    assert {n.split("_")[0] for n in e.queries() if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in e.queries()


def test_no_other_module_imports_this_one():
    for path in [*ROOT.glob("cellquarry/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or "corpus_pipeline" in n for n in names), path
