import datetime
import subprocess
import sys
import threading
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellquarry.catalog.project import Project, resolve_target
from cellquarry.functions import geometry as G
from cellquarry.functions import stats
from cellquarry.operators import analysis as A
from cellquarry.operators import spatial as S
from cellquarry.operators.graph import Graph
from cellquarry.operators.matrix import Matrix
from cellquarry.operators.table import Table, bind_rows
from cellquarry.sources import readers, store, writers


@pytest.fixture
def line(spark):
    return Table(spark.createDataFrame([(i + 1, float(i), float(i), i % 2) for i in range(10)], "row_index long, x_index double, y_index double, odd int"))


def test_crops_come_before_verbs_wherever_they_stand(line):
    box = (5, 9, 5, 9)
    x = lambda t: sorted(r.x_index for r in t.df().collect())
    assert x(line.crop(box).head(3)) == x(line.head(3).crop(box)) == [5, 6, 7] and x(line.crop(box).tail(2)) == [8, 9]
    assert line.crop(box).select("odd").unique().df().count() == 2 and line.crop((5, 5, 5, 5)).select("odd").unique().df().count() == 1
    assert x(line.crop(box).row_sample(5)) == [5, 6, 7, 8, 9] and len(x(line.row_sample(5))) == 5
    other = line.df().select("row_index", F.col("odd").alias("twice"))
    assert x(line.crop(box).join(other, "row_index", inner=True)) == [5, 6, 7, 8, 9]
    seen = line.crop(box).window((0, 6, 0, 6))
    assert x(seen) == [5, 6] and x(seen.window(None)) == [5, 6, 7, 8, 9] and x(seen.crop((6, 9, 6, 9)).window(None)) == [6]
    assert bind_rows([line.crop(box), line.head(1)]).df().count() == 6


def test_values_are_bound_not_pasted(line):
    n = lambda where, **v: line.subset(where, **v).df().count()
    assert n("x_index < :q2 and x_index >= :q", q=1, q2=5) == 4 and n("x_index < :q", q=np.float64(3.0)) == 3
    assert line.subset("x_index < :q", negate=True, q=3).df().count() == 7
    assert n("odd = 1 and cast('2020-01-02' as date) = :d", d=datetime.date(2020, 1, 2)) == 5 and n("':q' = :q", q=":q") == 10 and n("'a' = :q", q="x' or 'a' = 'a") == 0


def test_clashing_names_are_numbered(line):
    other = line.df().select("row_index", F.lit(1).alias("odd"), F.lit(2).alias("odd_y"))
    once = line.join(other, "row_index")
    assert once.columns() == ["odd", "odd_y2", "odd_y"] and len(set(line.join(other, "row_index").join(other, "row_index").df().columns)) == len(once.df().columns) + 2


def test_market_entries_that_read_like_the_header(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n2 2 3\n2 2 3\n1 1 5\n1 2 4\n")
    (tmp_path / "b.tsv").write_text("A\nB\n")
    (tmp_path / "f.tsv").write_text("x\ny\n")
    m = readers.matrix_market(spark, *(str(tmp_path / n) for n in ("m.mtx", "b.tsv", "f.tsv")))
    assert sorted(map(tuple, m.named().collect())) == [("A", "x", 5.0), ("B", "x", 4.0), ("B", "y", 3.0)]


# ---- shapes


def square(x, y, w=4.0):
    return f"POLYGON(({x} {y}, {x + w} {y}, {x + w} {y + w}, {x} {y + w}, {x} {y}))"


def test_unions_of_shapes(spark):
    at = lambda x, y, shapes, r: G.relation((G.POINT, [[np.array([[x, y]], float)]]), (G.MULTIPOLYGON, [G.read_wkt(s)[1][0] for s in shapes]), r)
    over, beside = [square(0, 0), square(2, 2)], [square(0, 0), square(4, 0)]
    assert at(3, 3, over, "within") and at(2, 3, over, "within") and at(0, 1, over, "touches") and at(5, 1, over, "disjoint")
    assert at(4, 2, beside, "within") and at(4, 4, beside, "touches") and at(8, 2, beside, "touches")
    a, b = (lambda shapes: (G.MULTIPOLYGON, [G.read_wkt(s)[1][0] for s in shapes])), G.read_wkt(square(3, 1, 2))
    assert G.relation(b, a(beside), "within") and not G.relation(b, a(over), "within") and G.relation(b, a(over), "overlaps")
    hole = G.read_wkt("POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))")[1][0]
    plugged = (G.MULTIPOLYGON, [hole, G.read_wkt(square(4, 4, 2))[1][0]])
    assert G.relation((G.POINT, [[np.array([[5.0, 5.0]])]]), plugged, "within") and G.relation(G.read_wkt(square(3, 3, 4)), plugged, "within")
    assert not G.relation(G.read_wkt(square(3, 3, 4)), (G.POLYGON, [hole]), "within")
    p = S.points(spark.createDataFrame([(f"p{i}{j}", float(i), float(j)) for i in range(9) for j in range(9)], "feat_ID string, x double, y double"))
    got = {r.feat_ID for r in S.Spatial.of(p).relate(over).df().collect()}
    assert got == {f"p{i}{j}" for i in range(9) for j in range(9) if (i <= 4 and j <= 4) or (2 <= i <= 6 and 2 <= j <= 6)}
    corners = [(1, part, o, float(x), float(y)) for part, s in enumerate(over) for o, (x, y) in enumerate(G.read_wkt(s)[1][0][0])]
    poly = S.polygons(spark.createDataFrame(corners, "poly_ID int, part int, ord int, x double, y double"), part="part")
    assert {r.feat_ID for r in S.overlap(poly, p).collect()} == got
    split = S.polygons(spark.createDataFrame(corners, "poly_ID int, part int, ord int, x double, y double"), part="part", split=True)
    assert {r.poly_ID for r in split.collect()} == {"1-0", "1-1"}


def test_relations_between_tables(spark):
    rng = np.random.default_rng(0)
    boxes = lambda n, w: [(i, float(x), float(y), float(s)) for i, (x, y, s) in enumerate(zip(rng.random(n) * 20, rng.random(n) * 20, w * rng.random(n) + 0.1, strict=True))]
    a, b = boxes(40, 4), [*boxes(8, 2), (8, 3.0, 3.0, 14.0)]

    def shapes(rows):
        v = [(i, o, x + dx * s, y + dy * s) for i, x, y, s in rows for o, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]
        return S.polygons(spark.createDataFrame(v, "poly_ID int, ord int, x double, y double"))

    x, y = shapes(a), shapes(b)
    wkt = {i: G.read_wkt(square(px, py, s)) for i, px, py, s in a}
    other = [G.read_wkt(square(px, py, s)) for _, px, py, s in b]
    for name in ("intersects", "within", "overlaps", "disjoint"):
        got = {r.poly_ID for r in S.Spatial.of(x).relate(y, name).df().collect()}
        assert got == {i for i, s in wkt.items() if any(G.relation(s, o, name) for o in other)}, name
    turned = S.Spatial.of(x).spin(90, 0, 0)
    assert {r.poly_ID for r in turned.relate(["POLYGON((-30 0, 0 0, 0 30, -30 30))"], "within").df().collect()} == set(wkt)
    assert S.Spatial.of(x).relate(y.limit(0)).df().count() == 0
    with pytest.raises(ValueError):
        S.Spatial.of(x).relate(y, "near")


def test_rings_and_tables_of_vertices(spark):
    rows = [(1, 0, 0, o, float(x), float(y)) for o, (x, y) in enumerate(((0, 0), (9, 0), (9, 9), (0, 9), (0, 0)))] + [(1, 0, 1, o, float(x), float(y)) for o, (x, y) in enumerate(((2, 2), (4, 2), (4, 4), (2, 4)))]
    rows += [(2, 0, 0, o, float(o), float(o)) for o in range(2)] + [(3, 0, 0, 0, float("nan"), 1.0)]
    p = S.polygons(spark.createDataFrame(rows, "poly_ID int, part int, ring int, ord int, x double, y double"), part="part", ring="ring")
    assert [(r.poly_ID, r.area) for r in S.areas(p).collect()] == [(1, 77.0)]
    t = S.Spatial.of(p).to_pandas("XY")
    assert len(t) == 8 and t.groupby("ring").size().tolist() == [4, 4] and list(t.columns) == ["poly_ID", "part", "ring", "x", "y"]
    assert "geom" in S.Spatial.of(p).to_pandas("wkb") and list(S.Spatial.of(p).to_pandas().columns) == ["poly_ID"] and S.Spatial.of(p).centroids().columns == ["poly_ID", "x_index", "y_index"]
    with pytest.raises(ValueError):
        S.Spatial.of(p).to_pandas("terra")


def test_points_keep_their_own_keys(spark):
    poly = S.polygons(spark.createDataFrame([(7, o, float(x), float(y)) for o, (x, y) in enumerate(((0, 0), (4, 0), (4, 4), (0, 4)))], "poly_ID int, ord int, x double, y double"))
    pts = spark.createDataFrame([("g", 1.0, 1.0, 3, 0, 1), ("g", 1.0, 1.0, 5, 0, 2), ("h", 9.0, 9.0, 1, 1, 1)], "feat_ID string, x_index double, y_index double, count int, tile_index int, row_index long")
    found = S.overlap(poly, pts)
    assert found.columns == ["poly_ID", "feat_ID", "count", "pt_tile_index", "pt_row_index"] and sorted(r.pt_row_index for r in found.collect()) == [1, 2]
    cells, feats = poly.select(F.col("poly_ID").alias("cell_id")), pts.select(F.col("feat_ID").alias("feat_id")).distinct()
    total = lambda c: S.overlap_matrix(found, cells, feats, c).triplets.first().value
    assert total(None) == total("count") == 8 and total(False) == 2
    shares = S.label_proportions(poly, pts, "feat_ID").collect()
    assert [(r.poly_ID, r.label, r.prop) for r in shares] == [(7, "g", 1.0)]


# ---- tiles and stores


def test_tiles_of_crowded_places(spark):
    rng = np.random.default_rng(1)
    xy = np.vstack([rng.random((400, 2)), 0.3 + rng.random((600, 2)) * 1e-4, np.full((50, 2), 0.9)])
    df = spark.createDataFrame([(float(x), float(y)) for x, y in xy], "x_index double, y_index double")
    plan = S.quadtree(df, 60, (0.0, 1.0, 0.0, 1.0), seed=(2, 1))
    assert len(plan) > 64 and [t[0] for t in plan] == list(range(len(plan))) and abs(sum((t[2] - t[1]) * (t[4] - t[3]) for t in plan) - 1) < 1e-9
    got = S.tiled(df, plan)
    n = {r.tile_index: r["count"] for r in got.groupBy("tile_index").count().collect()}
    assert None not in n and max(n.values()) <= 60 and sum(n.values()) == 1050
    assert got.exceptAll(S.tiled(df, plan, few=10**6)).count() == 0
    same = spark.createDataFrame([(0.5, 0.5)] * 9 + [(0.0, 1.0)], "x_index double, y_index double")
    assert len(S.quadtree(same, 3, (0.0, 1.0, 0.0, 1.0), deepest=8)) < 40 and S.quadtree(same.limit(0), 3) == []
    assert S.seed_grid((0, 30, 0, 10)) == (6, 2) and S.seed_grid((0, 1, 0, 1)) == (2, 2)


def test_stored_geometry(spark, tmp_path, capsys):
    rng = np.random.default_rng(2)
    df = S.points(spark.createDataFrame([(f"f{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.random((600, 2)))], "feat_ID string, x double, y double"))
    uid, plan = store.write_geometry(df, str(tmp_path / "g"), crs="EPSG:3857", threshold=100)
    g = store.read_geometry(spark, str(tmp_path / "g"))
    assert g.extent(exact=False) == g.extent() and g.meta["crs"] == "EPSG:3857" and g.meta["geo"]["columns"]["geom"]["encoding"] == "WKB" and len(plan) == len(g.meta["tiles"]) > 4
    assert any("tile_index=000" in p for p in store.paths(spark, str(tmp_path / "g"))) and store.exists(spark, str(tmp_path / "g")) and not store.exists(spark, str(tmp_path / "no"))
    some = g.crop((0.1, 0.2, 0.1, 0.2))
    assert some.df().count() == df.where("x_index between 0.1 and 0.2 and y_index between 0.1 and 0.2").count() > 0
    some.df().explain("formatted")
    assert "PartitionFilters: [" in capsys.readouterr().out
    turned = g.spin(30, 0.5, 0.5)
    x0, x1, y0, y1 = turned.extent(exact=False)
    e = turned.extent()
    assert x0 <= e[0] and e[1] <= x1 and y0 <= e[2] and e[3] <= y1
    inside = turned.crop((0.2, 0.5, 0.2, 0.5)).df()
    assert inside.count() == turned.df().where("x_index between 0.2 and 0.5 and y_index between 0.2 and 0.5").count() > 0
    assert sum(g.tile(t[0]).df().count() for t in plan) == 600 and g.tile(0, 0.5).df().count() >= g.tile(0).df().count()
    store.write_geometry(df.limit(5), str(tmp_path / "g"), uid="second", tiled=False)
    assert store.read_geometry(spark, str(tmp_path / "g")).df().count() == 605 and store.read_geometry(spark, str(tmp_path / "g"), "second").meta["tiles"][0][0] == 0
    assert store.write_geometry(df, str(tmp_path / "h"), dry_run=True, threshold=100)[0] is None and not store.exists(spark, str(tmp_path / "h"))


def test_store_verbs(spark, tmp_path):
    m = Matrix.from_array(spark, np.array([[1.0, 0.0, 2.0], [0.0, 3.0, 0.0]]), ["a", "b"], ["x", "y", "z"])
    writers.write_matrix(m, str(tmp_path / "m"))
    back = store.open_store(spark, str(tmp_path / "m"), "parquetExpr")
    at, cols, data, cells, feats = back.csr()
    assert at.tolist() == [0, 1, 2, 3] and cols.tolist() == [0, 1, 0] and data.tolist() == [1, 3, 2] and cells == ["x", "y", "z"] and feats == ["a", "b"]
    with pytest.raises(ValueError):
        store.open_store(spark, str(tmp_path), "h5")
    (tmp_path / "t.csv").write_text("k,v\na,1\nb,2\n")
    store.file_to_file(spark, str(tmp_path / "t.csv"), str(tmp_path / "t.parquet"), "csv", via=lambda d: d.where("v > 1"), header="true")
    assert [r.k for r in spark.read.parquet(str(tmp_path / "t.parquet")).collect()] == ["b"]
    info = store.chunk_info(m, executor_mb=1e-4).collect()
    assert len(info) == 12 and all(1 <= r.rows <= 3 and r.chunks == -(-3 // r.rows) for r in info)
    assert store.view_name(m.cells, "seen") == "`seen`" and spark.sql("select * from seen").count() == 3
    assert store.dump_dir(spark).endswith("/dump") and store.dump_dir(spark, "/x/y") == "/x/y" == store.OPTIONS.dump_dir
    store.OPTIONS.dump_dir = None


def test_shared_folder_without_a_setting(tmp_path):
    """A session without spark.checkpoint.dir writes below its warehouse."""
    code = """
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", %r).getOrCreate()
from cellquarry.plans.indexing import with_row_index
from cellquarry.plans.store import forget, shared_dir, written
assert shared_dir(s) == shared_dir(s) and "/wh/" in shared_dir(s), shared_dir(s)
assert [r.row_index for r in with_row_index(s.range(3)).collect()] == [1, 2, 3]
w = written(s.range(5)); assert w.count() == 5; forget(w)
print("went well")
""" % f"file://{tmp_path}/wh"
    empty = tmp_path / "conf"
    empty.mkdir()
    import os

    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[1], env=os.environ | {"SPARK_CONF_DIR": str(empty)}, timeout=200)
    assert "went well" in done.stdout, done.stderr[-2000:]
    assert not list((tmp_path / "wh").rglob("*.parquet"))  # all written tables are gone with the session


def test_gef_ranges():
    genes = np.array([("A", 0, 2), ("B", 2, 0), ("A", 2, 3), ("C", 5, 1)], dtype=[("n", "U1"), ("offset", "i8"), ("count", "i8")])
    e = np.array([(i, 10 - i, i + 1) for i in range(6)], dtype=[("x", "i4"), ("y", "i4"), ("count", "i4")])
    assert readers.gene_ranges(genes["count"], 3) == [(0, 2), (2, 3), (3, 4)]
    got = readers.gef_range(genes, genes["n"], lambda a, b: e[a:b], 0, 3)
    assert got["gene"].tolist() == ["A", "A", "A", "A", "A"] and got["count"].tolist() == [1, 2, 3, 4, 5] and got["at"].tolist() == [0, 1, 2, 3, 4]
    cells = np.array([(90, 0, 1), (7, 1, 2)], dtype=[("id", "i4"), ("offset", "i8"), ("geneCount", "i4")])
    exp = np.array([(0, 5), (2, 6), (3, 7)], dtype=[("geneID", "i4"), ("count", "i4")])
    one = readers.cell_records(cells, genes["n"], lambda a, b: exp[a:b], 0, 2)
    assert one.values.tolist() == [[1, "A", 5.0], [2, "A", 6.0], [2, "C", 7.0]]
    by_gene = np.array([(90, 5), (7, 6), (55, 1), (7, 7)], dtype=[("cellID", "i4"), ("count", "i4")])
    g = np.array([1, 0, 2, 1])
    two = readers.gene_records({"cellCount": g}, genes["n"], cells["id"], lambda a, b: by_gene[a:b], 0, 4)
    assert two.values.tolist() == one.values.tolist()


def test_bins_in_the_order_they_come(spark):
    r = spark.createDataFrame([("g", 5, 1, 2.0, 0), ("g", 0, 0, 1.0, 1), ("h", 5, 1, 4.0, 2)], "gene string, x int, y int, count double, at long")
    assert [c.cell_id for c in readers.bin_records(r, "seen").cells.orderBy("row_id").collect()] == ["bin_5_1", "bin_0_0"]
    m = readers.bin_records(r)
    places = spark.createDataFrame([("bin_5_1", 5.0, 1.0), ("bin_0_0", 0.0, 0.0), ("other", 9.0, 9.0)], "cell_id string, x double, y double")
    assert sorted((p.feat_ID, p.x_index) for p in S.bin_points(m, places).collect()) == [(1, 0.0), (2, 5.0)]


# ---- matrices, graphs, projects


def test_names_of_a_matrix(spark):
    m = Matrix.from_array(spark, np.eye(3), ["a", "b", "c"], ["x", "y", "z"])
    for names in (["a", "zz"], ["a", *(f"q{i}" for i in range(1500))]):
        with pytest.raises(KeyError):
            m.subset(feats=names)
    with pytest.raises(ValueError):
        m.rename(cells=spark.createDataFrame([(1, "one")], "row_id long, cell_id string"))
    assert m.rename(cells=m.cells.withColumn("cell_id", F.upper("cell_id"))).named().where("cell_id = 'X'").count() == 1
    other = m.rename(cells=m.cells.withColumn("cell_id", F.concat(F.lit("n"), "cell_id")))
    both = Matrix.bind_cells([m, other])
    assert both.cells.select("row_id").distinct().count() == 6 and {(r.cell_id, r.feat_id) for r in both.named().collect()} == {("x", "a"), ("y", "b"), ("z", "c"), ("nx", "a"), ("ny", "b"), ("nz", "c")}


def test_views_by_id_prune_stored_triplets(spark, tmp_path, capsys):
    m = Matrix.from_array(spark, np.ones((3, 40)), ["a", "b", "c"], [f"x{i}" for i in range(40)])
    writers.write_matrix(m, str(tmp_path / "m"))
    back = readers.read_matrix(spark, str(tmp_path / "m"))
    part = back.at(rows=range(5, 12), cols=[2])
    assert part.dim() == (1, 7) and part.triplets.count() == 7
    part.triplets.explain("formatted")
    assert "GreaterThanOrEqual(row_id,5)" in capsys.readouterr().out
    assert back.at(rows=range(1, 41)).triplets is back.triplets and back.at(rows=[]).triplets.count() == 0 and back.at(rows=[1, 40]).dim() == (3, 2)
    assert back.at(rows=range(2, 10_000, 3)).dim()[1] == 13


def test_grouped_statistics_by_position(spark):
    m = Matrix.from_array(spark, np.array([[1.0, 3.0, 5.0], [0.0, 2.0, 0.0]]), ["a", "b"], ["x", "y", "z"])
    got = {(r.feats, r.label): r for r in m.grouped_feat_stats(["k", "k", None]).collect()}
    assert set(got) == {("a", "k"), ("b", "k")} and got["a", "k"].mean_expr == 2 and got["b", "k"].nr_cells == 1
    assert m.grouped_feat_stats(["k", "l", "l"], stats=("nnz",)).columns == ["feats", "label", "n_cells", "nr_cells", "perc_cells"]
    with pytest.raises(ValueError):
        m.grouped_feat_stats([None, None, None])
    with pytest.raises(ValueError):
        m.grouped_feat_stats(["k"])


def test_cells_without_values_have_no_shares(spark):
    m = Matrix.from_array(spark, np.array([[4.0, 0.0, 2.0], [0.0, 0.0, 6.0], [1.0, 9.0, 0.0]]), ["a", "b", "c"], ["x", "y", "z"])
    sign = spark.createDataFrame([("a", "s", 1.0), ("b", "t", 1.0)], "feat_id string, type string, value double")
    got = {(r.cell_id, r.type): round(r.share, 6) for r in A.deconvolve(m, sign).collect()}
    assert got == {("x", "s"): 1.0, ("x", "t"): 0.0, ("y", "s"): 0.0, ("y", "t"): 0.0, ("z", "s"): 0.25, ("z", "t"): 0.75}
    a = np.array([[1.0, 0.2], [0.1, 1.0], [0.5, 0.5]])
    assert np.allclose(stats.damped_shares(a, a @ [3.0, 1.0]), [0.75, 0.25], atol=1e-4)


def test_local_regression_is_fitted_everywhere(spark):
    rng = np.random.default_rng(3)
    x = np.sort(rng.random(1200))
    y = np.sin(5 * x) + 0.1 * rng.random(1200)
    every = stats.loess(x, y)
    for i in (0, 7, 600, 1199):  # a fit of its own by plain least squares
        far = np.sort(np.abs(x - x[i]))[int(1200 * 0.75) - 1]
        w = np.clip(1 - (np.abs(x - x[i]) / far) ** 3, 0, None) ** 3
        b = np.vander(x - x[i], 3, increasing=True)
        assert abs(np.linalg.lstsq(b * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0][0] - every[i]) < 1e-6
    m = Matrix.from_array(spark, rng.poisson(2.0, (40, 30)).astype(float) * (1 + np.arange(40))[:, None], [f"f{i}" for i in range(40)], [f"c{i}" for i in range(30)])
    got = A.variable_loess(m, chunk=7).toPandas()
    assert len(got) == 40 and np.allclose(got["cov"] - stats.loess(np.log(got["mean_expr"]), got["cov"]), got["cov_diff"], atol=1e-9)


def test_graphs_by_number_and_name(spark):
    g = Graph.of(spark.createDataFrame([("b", "a", 2.0), ("d", "b", 1.0)], "from_id string, to_id string, weight double"), spark.createDataFrame([(c,) for c in "abcd"], "node_id string"))
    nodes, edges = Graph(g.edges, g.nodes, picked=g.nodes).materialise()
    assert sorted(map(tuple, nodes.collect())) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")] and sorted(map(tuple, edges.collect())) == [(2, 1, 2.0), (4, 2, 1.0)]
    assert g.materialise()[0].count() == 3 and list(g.to_pandas()[1].columns) == ["from", "to", "weight"]
    names = spark.createDataFrame([(c, i) for i, c in enumerate("abcd")], "node_id string, name int")
    assert sorted((r.from_id, r.to_id) for r in g.relabel(names).edges.collect()) == [(1, 0), (3, 1)]
    with pytest.raises(ValueError):
        g.relabel(names.limit(2))


def test_motifs_against_permuted_labels(spark):
    """Two cliques, each of one label: their triangles are rare under permutation."""
    pairs = [(a + o, b + o) for o in (0, 10) for a in range(6) for b in range(a + 1, 6)]
    g = Graph.of(spark.createDataFrame(pairs, "from_id int, to_id int"))
    labels = spark.createDataFrame([(i + o, n) for o, n in ((0, "A"), (10, "B")) for i in range(6)], "node_id int, label string")
    got = {(r.motif, r.labels): r for r in g.motif_enrichment(labels, n_perm=19, seed=2).collect()}
    one = got["triangle", "A-A-A"]
    assert one.n == 20 and one.mean < 10 and one.z > 1 and one.p <= 0.15 and got["triangle", "A-A-B"].n == 0 and got["triangle", "A-A-B"].p == 1
    assert {(r.motif, r.labels): r.n for r in g.motifs(labels).collect()} == {k: r.n for k, r in got.items() if r.n}


def test_targets_of_a_view(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "cell_id string")
    m = Matrix.from_array(spark, np.eye(3), ["f", "g", "h"], ["a", "b", "c"])
    assert resolve_target("expression", m, ids).cells.count() == 2 and resolve_target("expression", m, None) is m
    meta = spark.createDataFrame([("a", 1), ("c", 2)], "cell_id string, q int")
    assert [r.q for r in resolve_target("cell_meta", meta, ids).collect()] == [1]
    poly = S.polygons(spark.createDataFrame([(c, o, float(x), float(y)) for c in "abc" for o, (x, y) in enumerate(((0, 0), (1, 0), (1, 1)))], "poly_ID string, ord int, x double, y double"))
    moved = resolve_target("polygons", poly, ids, space=lambda s: s.shift(10, 0))
    assert sorted((r.poly_ID, r.x_index, r.xmax) for r in moved.df().collect()) == [("a", 10.5, 11.0), ("b", 10.5, 11.0)]
    pts = S.points(spark.createDataFrame([("g", 0.0, 0.0), ("h", 5.0, 5.0)], "feat_ID string, x double, y double"))
    steps = [{"filter": "q > 1", "column": "q"}, {"crop": (0, 1, 0, 1)}, {"region": square(-1, -1)}]
    assert [r.feat_ID for r in resolve_target("points", pts, ids, steps).df().collect()] == ["g"] and resolve_target("bin_points", pts, ids, steps[1:2]).df().count() == 1
    with pytest.raises(ValueError):
        resolve_target("bin_points", pts, ids, steps, space=lambda s: s)
    with pytest.raises(KeyError):
        resolve_target("images", meta, ids)


def test_edits_of_many_threads_all_stay(tmp_path):
    p = Project(str(tmp_path / "p"))

    def edit(k):
        for i in range(8):
            q = Project(str(tmp_path / "p"))
            q.register(f"u{k}-{i}", type="x")
            q.consolidate()

    threads = [threading.Thread(target=edit, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(p) == 32
