import numpy as np
import pytest
from pyspark.sql import functions as F

from cellquarry.functions import stats as S
from cellquarry.operators import analysis as A
from cellquarry.operators.graph import Graph
from cellquarry.operators.matrix import Matrix
from cellquarry.operators.table import Table, bind_rows
from cellquarry.plans import rules
from cellquarry.streaming import windows


@pytest.fixture
def tab(spark):
    return Table(spark.createDataFrame([(i, "abc"[i % 3], i * 1.5 if i % 4 else None) for i in range(1, 21)], "row_index long, k string, v double"))


def test_verbs(tab, spark):
    assert tab.columns() == ["k", "v"] and tab.nrow() == 20
    assert tab.subset("v > :x", x=10).collect()["v"].min() > 10
    assert tab.subset("v > 10", negate=True).nrow() + tab.subset("v > 10").nrow() == 15  # null conditions drop
    assert tab.head(3).subset("k = 'b'").nrow() == 1 and tab.subset("k = 'b'").head(3).nrow() == 3
    assert tab.tail(2).collect(omit_internals=False)["row_index"].tolist() == [19, 20]
    assert sorted(r.row_index for r in tab.row_sample(6).df().collect()) == [1, 5, 9, 13, 17]
    assert tab.row_sample(50).nrow() == 20 and tab.select("k").unique().nrow() == 3
    with pytest.raises(KeyError):
        tab.select("nope")
    assert tab.select(True, False).columns() == ["k"] and len(tab.select(0).values()) == 20
    y = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    left, inner = tab.join(y, "k"), tab.join(y, {"k": "k"}, inner=True)
    assert left.nrow() == 20 and inner.nrow() == 13 and "v_y" in left.columns()
    both = bind_rows([tab, Table(y)], ["x", "y"])
    assert both.nrow() == 22 and both.df().where("source_id = 'y' and row_index is null").count() == 2
    assert [x for x in tab.log] == [] and tab.head().log == ("head",)


def test_ids(tab):
    assert tab.keep("k", ["a"]).nrow() + tab.keep("k", ["a"], negate=True).nrow() == 20
    big = list(range(5, 5000))
    assert tab.keep("row_index", big).nrow() == 16 and tab.keep("row_index", big, negate=True).nrow() == 4
    assert tab.keep("v", [3.0], negate=True).nrow() == 19  # null rows stay


def test_axis_shapes(spark):
    d = spark.range(1, 101).withColumnRenamed("id", "x")
    for keep in ([], list(range(1, 101)), list(range(10, 20)), [i for i in range(10, 60) if i % 7], [3, 50, 99], [5, 5, 4]):
        p = rules.axis_predicate("x", keep, 100)
        got = d if p is None else d.where(p)
        assert sorted(r.x for r in got.collect()) == sorted(set(keep))


def test_pushed_to_the_scan(spark, tmp_path, capsys):
    spark.range(100).selectExpr("id as row_index", "id * 1.0D as x_index", "id * 1.0D as y_index", "id as other").write.parquet(str(tmp_path / "p"))
    Table.read(spark, str(tmp_path / "p")).crop((1, 5, 1, 5)).select("row_index").df().select("row_index").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(x_index,1.0)" in plan and "other" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.fixture(scope="module")
def dense():
    rng = np.random.default_rng(0)
    return np.where(rng.random((15, 40)) < 0.4, rng.poisson(6, (15, 40)) + 1, 0).astype(float)


@pytest.fixture(scope="module")
def mat(spark, dense):
    t = spark.createDataFrame([(int(j), int(i), float(dense[i, j])) for i, j in zip(*np.nonzero(dense), strict=True)], "row_id long, col_id long, value double")
    cells = spark.createDataFrame([(j, f"c{j:02d}") for j in range(40)], "row_id long, cell_id string")
    feats = spark.createDataFrame([(i, f"f{i:02d}") for i in range(15)], "col_id long, feat_id string")
    return Matrix.of(t, cells, feats)


@pytest.fixture(scope="module")
def groups(spark):
    return spark.createDataFrame([(f"c{j:02d}", "ABC"[j % 3] if j < 36 else None) for j in range(40)], "cell_id string, label string")


def pull(df, key, *cols):
    return np.array([[r[c] for c in cols] for r in df.orderBy(key).collect()], float)


def test_stats(mat, dense, groups):
    got = pull(mat.feat_stats(5), "feats", "nr_cells", "perc_cells", "total_expr", "mean_expr", "mean_expr_det")
    det = dense > 5
    with np.errstate(all="ignore"):
        want = np.column_stack([det.sum(1), det.mean(1) * 100, dense.sum(1), dense.mean(1), np.where(det, dense, 0).sum(1) / det.sum(1)])
    assert np.allclose(got, want, equal_nan=True)
    cells = pull(mat.cell_stats(), "cells", "nr_feats", "perc_feats", "total_expr")
    assert np.allclose(cells, np.column_stack([(dense > 0).sum(0), (dense > 0).mean(0) * 100, dense.sum(0)]))
    by = mat.grouped_feat_stats(groups)
    assert by.count() == 45
    for i, lab in enumerate("ABC"):
        own = dense[:, [j for j in range(36) if j % 3 == i]]
        g = pull(by.where(F.col("label") == lab), "feats", "n_cells", "mean_expr", "sd", "nr_cells")
        assert np.allclose(g, np.column_stack([np.full(15, 12), own.mean(1), own.std(1, ddof=1), (own > 0).sum(1)]))
    p = pull(mat.accumulate("feat", ["sumsq", "sum3", "sum4", "max"]), "feat_id", "sumsq", "sum3", "sum4", "max")
    assert np.allclose(p, np.column_stack([(dense**2).sum(1), (dense**3).sum(1), (dense**4).sum(1), dense.max(1)]))


def test_views_and_transforms(mat, dense):
    norm = mat.library_norm(6000).log_norm()
    s = dense.sum(0)
    want = np.log2(dense / np.where(s == 0, 1, s) * 6000 + 1)
    assert np.allclose(norm.dense()[0], want) and np.allclose(norm.t().dense()[0], want.T)
    sub = norm.subset(feats=["f01", "f03"], cells=[f"c{j:02d}" for j in range(9)])
    assert np.allclose(sub.dense()[0], want[[1, 3], :9]) and sub.dim() == (2, 9) and sub.t().dim() == (9, 2)
    assert np.allclose(norm.expm1().dense()[0], np.exp2(want) - 1)
    assert np.allclose(mat.compare(">=", 5).dense()[0], dense >= 5)
    for op, t in (("<", 1), (">=", 0), ("==", 0), ("!=", 2)):
        with pytest.raises(ValueError):
            mat.compare(op, t)
    with pytest.raises(KeyError):
        mat.subset(feats=["nope"])
    with pytest.raises(ValueError):
        mat.add(1)
    assert np.allclose(pull(mat.margins("row_sums"), "id", "value")[:, 0], dense.sum(1)) and np.allclose(pull(mat.t().margins("row_means"), "id", "value")[:, 0], dense.mean(0))
    assert np.allclose(mat.clamp(0, 7).dense()[0], np.minimum(dense, 7))
    assert mat.wide(["f02"]).count() == 40
    f, c = norm.filter_masks(3, 12, 5)  # raw values, whatever is queued
    kept = (dense >= 3).sum(1) >= 12
    assert [r[0] for r in f.orderBy("feat_id").collect()] == [f"f{i:02d}" for i in np.flatnonzero(kept)]
    assert c.count() == ((dense[kept] >= 3).sum(0) >= 5).sum()


def test_union(mat, dense):
    halves = [Matrix(h.triplets, h.cells, mat.feats, h.raw) for h in (mat.subset(cells=[f"c{j:02d}" for j in range(40) if j % 2 == i]) for i in (0, 1))]
    both = Matrix.bind_cells(halves)
    assert np.allclose(pull(both.feat_stats(), "feats", "total_expr", "mean_expr"), pull(mat.feat_stats(), "feats", "total_expr", "mean_expr"))
    with pytest.raises(ValueError):
        Matrix.bind_cells([halves[0], halves[0]])


def test_histogram_and_binarize(mat, dense):
    h = mat.histogram(8).toPandas()
    for i in range(15):
        own = dense[i][dense[i] > 0]
        want = np.bincount(np.minimum(np.ceil(own * 8 / own.max()) - 1, 7).astype(int), minlength=8)
        got = h[h.feat_id == f"f{i:02d}"].set_index("bin")["n"].reindex(range(8), fill_value=0)
        assert (got.to_numpy() == want).all()
    assert A.binarize(mat, "rank", 30).triplets.where("value != 1").count() == 0 and A.binarize(mat, "kmeans").triplets.count() > 0


def test_variable_features(mat, dense):
    b = pull(A.base_stats(mat), "feats", "mean_expr", "sd", "cov")
    assert np.allclose(b, np.column_stack([dense.mean(1), dense.std(1, ddof=1), dense.std(1, ddof=1) / dense.mean(1)]))
    assert A.variable_loess(mat).count() == 15
    got = pull(A.pearson_residual_variance(mat), "feats", "var")[:, 0]
    c = dense.sum(0)
    x = dense[:, c > 0]
    mu = np.outer(x.sum(1), x.sum(0)) / x.sum()
    z = np.clip((x - mu) / np.sqrt(mu + mu**2 / 100), -np.sqrt(x.shape[1]), np.sqrt(x.shape[1]))
    assert np.allclose(got, z.var(1, ddof=1), atol=1e-10)


def test_markers(mat, dense, groups):
    w = A.markers(mat, groups).where("host = 'A' and target = 'B'").orderBy("feat_id").collect()
    x, y = dense[:, 0:36:3], dense[:, 1:36:3]
    vx, vy = np.maximum(x.var(1, ddof=1), 1e-8) / 12, np.maximum(y.var(1, ddof=1), 1e-8) / 12
    t = (x.mean(1) - y.mean(1)) / np.sqrt(vx + vy)
    df = (vx + vy) ** 2 / (vx**2 / 11 + vy**2 / 11)
    assert np.allclose([r.t for r in w], t) and np.allclose([r.df for r in w], df)
    p = np.minimum(0, np.minimum(S.log_t_cdf(t, df), S.log_t_cdf(-t, df)) + np.log(2))
    assert np.allclose([r.log_p for r in w], p) and np.allclose([r.log_fdr for r in w], S.log_bh(p))
    rest = A.welch(mat, groups, "one_vs_rest").where("host = 'A'").orderBy("feat_id").collect()
    y = dense[:, [j for j in range(36) if j % 3]]
    assert np.allclose([r.lfc for r in rest], x.mean(1) - y.mean(1)) and rest[0].target == "B_C"
    for kind in ("any", "all", "some"):
        c = A.combine_markers(A.markers(mat, groups), kind)
        assert c.count() == 45 and c.where("log_p > 0 or log_fdr > 0 or top < 1").count() == 0


def test_page_and_products(mat, dense, spark):
    sign = spark.createDataFrame([(f"f{i:02d}", "t1" if i < 6 else "t2") for i in range(12)], "feat_id string, type string")
    z = A.page_enrichment(mat, sign, 3, reverse_log=False).where("type = 't1'").orderBy("cell_id").collect()
    x = dense - dense.mean(1, keepdims=True)
    want = (x[:6].mean(0) - x.mean(0)) * np.sqrt(6) / x.std(0, ddof=1)
    assert np.allclose([r.zscore for r in z], want)
    with pytest.raises(ValueError):
        A.page_enrichment(mat, sign, 10)
    r = {(r.feat1, r.feat2): r.r for r in A.correlation(mat).collect()}
    want = np.corrcoef(dense)
    assert all(abs(v - want[int(a[1:]), int(b[1:])]) < 1e-9 for (a, b), v in r.items()) and len(r) > 90
    w = spark.createDataFrame([(f"f{i:02d}", n, float(i * k)) for i in range(15) for k, n in ((1, "a"), (2, "b"))], "feat_id string, name string, w double")
    got = pull(A.crossprod(mat, w).where("name = 'b'"), "cell_id", "value")[:, 0]
    assert np.allclose(got, 2 * np.arange(15) @ dense)
    sig = spark.createDataFrame([(f"f{i:02d}", t, float(v)) for i in range(15) for t, v in (("u", i % 4), ("v", (15 - i) % 5))], "feat_id string, type string, value double")
    shares = A.deconvolve(mat, sig).groupBy("cell_id").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 or r.s == 0 for r in shares)


@pytest.mark.parametrize("method", ["gram", "random"])
def test_components(mat, dense, method):
    got = A.pca(mat, 4, method)
    x = (dense - dense.mean(1, keepdims=True)) / dense.std(1, ddof=1, keepdims=True)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(got["sdev"], s[:4] / np.sqrt(39), atol=1e-6)
    assert np.allclose(np.abs(np.sum(got["loadings"] * u[:, :4], axis=0)), 1, atol=1e-4)
    scores = np.array([r.scores for r in got["scores"].orderBy("cell_id").collect()])
    assert np.allclose(scores, x.T @ got["loadings"], atol=1e-6)
    with pytest.raises(ValueError):
        A.pca(mat, 4, "irlba")


def test_numbers():
    assert np.allclose(np.exp(S.log_t_cdf(np.array([-3.0, 0, 2]), np.array([1.0, 1, 1]))), 0.5 + np.arctan([-3.0, 0, 2]) / np.pi)
    t = np.array([-40.0, -1.0, 0.3])
    assert np.allclose(np.exp(S.log_t_cdf(t, np.full(3, 2.0))), 0.5 + t / (2 * np.sqrt(2 + t * t)))
    assert np.isfinite(S.log_t_cdf(np.array([-1e6]), np.array([50.0]))[0])
    p = np.log(np.array([0.01, 0.02, 0.03, 0.5]))
    assert np.allclose(np.exp(S.log_bh(p)), [0.04, 0.04, 0.04, 0.5]) and np.isclose(np.exp(S.log_simes(p)), 0.04)
    x = np.linspace(0, 5, 50)
    assert np.allclose(S.loess(x, 2 + 3 * x - x**2), 2 + 3 * x - x**2)
    x = np.random.default_rng(0).random(1500)
    assert np.allclose(S.loess(x, np.sin(3 * x))[::40], S.loess(x, np.sin(3 * x), at=x[::40])) and np.allclose(S.loess(x, np.sin(x)), np.sin(x), atol=0.01)
    assert np.allclose(S.nnls(np.eye(3), np.array([1.0, -1, 2])), [1, 0, 2])


def test_graph(spark, mat, dense):
    e = [("a", "b", 0.9), ("a", "c", 0.7), ("a", "d", 0.5), ("b", "c", 0.6), ("b", "d", 0.4), ("c", "d", 0.8), ("d", "e", 0.3)]
    g = Graph.of(spark.createDataFrame(e, "from_id string, to_id string, weight double"), spark.createDataFrame([(x,) for x in "abcdef"], "node_id string"))
    ends = lambda g: sorted((r.from_id, r.to_id) for r in g.edges.collect())
    assert ends(g.induced(["a", "b", "e"])) == [("a", "b")] and {r[0] for r in g.induced(["a", "b", "e"]).vertices().collect()} == {"a", "b", "e"}
    assert len(ends(g.induced(["a", "b"], negate=True))) == 6
    assert ends(g.slice(["d"], ["a", "e"])) == [("a", "d"), ("d", "e")] and ends(g.endpoint(["e"])) == [("d", "e")]
    directed = Graph(g.edges, g.nodes, True)
    assert ends(directed.slice(["d"], ["a", "e"])) == [("d", "e")]
    assert {r.node: r.degree for r in g.degree().collect()} == {"a": 3, "b": 3, "c": 3, "d": 4, "e": 1, "f": 0}
    labels = spark.createDataFrame([("a", "X"), ("b", "Y"), ("c", "X"), ("d", "Y")], "node_id string, label string")
    p = {(r.node, r.label): r.prop for r in g.label_proportions(labels, 0.0).collect()}
    assert p["a", "Y"] == pytest.approx(2 / 3) and p["d", None] == pytest.approx(1 / 4)
    assert {r.node for r in g.label_proportions(labels, 1.0, wide=["X", "Y"]).collect()} == set("abcdef")
    m = {(r.motif, r.labels): r.n for r in g.motifs(spark.createDataFrame([(x, "L") for x in "abcdef"], "node_id string, label string")).collect()}
    assert m == {("triangle", "L-L-L"): 4, ("wedge", "L-L-L"): 3}
    ring = Graph.of(spark.createDataFrame([(f"c{i:02d}", f"c{(i + 1) % 40:02d}", 1.0 + i % 3) for i in range(40)], "from_id string, to_id string, weight double"))
    w = np.array([1.0 + i % 3 for i in range(40)])
    want = (dense * np.roll(dense, -1, axis=1) * w).sum(1)
    assert np.allclose(pull(ring.edge_products(mat), "feat_id", "edge_prod")[:, 0], want)
    a = np.zeros((40, 40))
    a[np.arange(40), (np.arange(40) + 1) % 40] = w
    a = a + a.T + np.eye(40)
    assert np.allclose(ring.smooth(mat, hops=2).dense()[0], dense @ np.linalg.matrix_power((a / a.sum(1, keepdims=True)).T, 2))


def test_streams(spark, tmp_path):
    spark.createDataFrame([(i % 3, float(i)) for i in range(30)], "col_id int, value double").repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("col_id int, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    windows.accumulate_stream(s, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r.col_id: (r["sum"], r.nnz) for r in windows.partial_sums(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {k: (sum(i for i in range(30) if i % 3 == k), 10) for k in range(3)}


def test_queries_over_features_take_all_of_them(spark):
    from cellquarry import catalogue

    d = "/root/testdata/sf0.001"
    m = catalogue.matrix(spark, d)
    cells, feats = (sorted(r[0] for r in x.select(c).collect()) for x, c in ((m.cells, "row_id"), (m.feats, "col_id")))
    own = m.triplets.toPandas()
    x = np.zeros((len(cells), len(feats)))
    np.add.at(x, (np.searchsorted(cells, own.row_id), np.searchsorted(feats, own.col_id)), own.value)
    run = lambda name: catalogue.queries()[name](spark, d)
    got = {(r.f1, r.f2): r.g for r in run("gram_matrix").collect()}
    g = np.triu(x.T @ x)
    assert got == {(feats[i], feats[j]): g[i, j] for i, j in zip(*np.nonzero(g), strict=True)}
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    assert np.allclose([r.sdev for r in run("pca_gram_eigenvalues").orderBy("pc").collect()], np.linalg.svd(z, compute_uv=False)[:10] / np.sqrt(len(cells) - 1), atol=1e-5)
    assert {r.col_id for r in run("binarize_kmeans").select("col_id").distinct().collect()} == set(own.col_id)
    assert run("deconvolution_shares").select("cell_id").distinct().count() == len(cells)


def test_correlation_of_features_without_a_shared_cell(spark):
    x = np.array([[3.0, 0, 0, 1], [0, 2.0, 0, 0], [0, 0, 4.0, 2.0], [0, 0, 0, 0]])
    t = spark.createDataFrame([(c, f, float(x[f, c])) for f, c in zip(*map(lambda v: v.tolist(), np.nonzero(x)), strict=True)], "row_id long, col_id long, value double")
    cells = spark.createDataFrame([(c, f"c{c}") for c in range(4)], "row_id long, cell_id string")
    feats = spark.createDataFrame([(f, f"f{f}") for f in range(4)], "col_id long, feat_id string")
    got = {(r.feat1, r.feat2): r.r for r in A.correlation(Matrix.of(t, cells, feats)).collect()}
    want = np.corrcoef(x[:3])
    assert len(got) == 6 and all(v is None for (_, b), v in got.items() if b == "f3")
    assert all(abs(v - want[int(a[1]), int(b[1])]) < 1e-9 for (a, b), v in got.items() if b != "f3")
