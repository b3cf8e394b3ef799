import numpy as np
import pytest
from pyspark.sql import functions as F

from cellquarry import catalogue
from cellquarry.catalog.project import Project, apply_view, resolve_view
from cellquarry.functions import geometry as G
from cellquarry.functions import ids
from cellquarry.operators import spatial as S
from cellquarry.operators.graph import Graph
from cellquarry.operators.matrix import Matrix
from cellquarry.operators.table import Table
from cellquarry.plans.indexing import with_row_index
from cellquarry.sources import readers, writers


@pytest.fixture
def grid(spark):
    return S.points(spark.createDataFrame([(f"p{i}{j}", float(i), float(j)) for i in (1, 2, 3) for j in (1, 2, 3)], "feat_ID string, x double, y double"))


def xy(s):
    return sorted((round(r.x_index, 6), round(r.y_index, 6)) for r in s.df().collect())


def test_affine(grid):
    s = S.Spatial.of(grid)
    p = np.array([[i, j] for i in (1, 2, 3) for j in (1, 2, 3)], float)
    want = lambda q: sorted(map(tuple, np.round(q + 0.0, 6).tolist()))
    assert xy(s.spin(90, 0, 0)) == want(np.column_stack([-p[:, 1], p[:, 0]]))
    assert xy(s.rescale(2)) == want((p - 2) * 2 + 2) and xy(s.t()) == want(p[:, ::-1]) and xy(s.flip()) == want(p * [1, -1])
    assert xy(s.shear(0.5, 0, 0, 0)) == want(np.column_stack([p[:, 0] + 0.5 * p[:, 1], p[:, 1]]))
    turned = s.spin(45, 0, 0).shift(1, 0)
    q = G.apply(G.then(G.spin(45), G.affine(tx=1)), p)
    inside = q[(q[:, 0] >= 0) & (q[:, 0] <= 1.5) & (q[:, 1] >= 2) & (q[:, 1] <= 4)]
    assert xy(turned.crop((0, 1.5, 2, 4))) == want(inside)
    moved = turned.df(geometry=True).collect()
    assert all(np.allclose(G.read_wkb(r.geom)[1][0][0][0], [r.x_index, r.y_index]) for r in moved)
    assert np.allclose(G.then(G.spin(30, 1, 2), G.invert(G.spin(30, 1, 2))), np.eye(3))
    with pytest.raises(ValueError):
        s.crop((0, 1, 0, 1)).crop((2, 3, 2, 3))


BOXES = {"inside": "POLYGON((1 1, 2 1, 2 2, 1 2, 1 1))", "over": "POLYGON((3 3, 6 3, 6 6, 3 6, 3 3))", "beside": "POLYGON((4 0, 5 0, 5 4, 4 4, 4 0))", "away": "POLYGON((8 8, 9 8, 9 9, 8 9, 8 8))", "same": "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", "around": "POLYGON((-1 -1, 9 -1, 9 9, -1 9, -1 -1))", "corner": "POLYGON((4 4, 5 4, 5 5, 4 5, 4 4))"}


def test_relations():
    box = G.read_wkt("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))")
    holds = lambda r: {k for k, v in BOXES.items() if G.relation(G.read_wkt(v), box, r)}
    assert holds("intersects") == {*BOXES} - {"away"} and holds("disjoint") == {"away"}
    assert holds("within") == {"inside", "same"} and holds("contains") == {"around", "same"} and holds("overlaps") == {"over"}
    assert holds("touches") == {"beside", "corner"} and holds("covers") == {"around", "same"} and holds("covered_by") == {"inside", "same"}
    at = lambda x, y, r: G.relation((G.POINT, [[np.array([[x, y]])]]), box, r)
    assert at(1, 1, "within") and at(0, 2, "touches") and at(0, 2, "intersects") and not at(0, 2, "within") and at(5, 5, "disjoint")
    kind, multi = G.read_wkt("MULTIPOLYGON(((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5), (5.2 5.1, 5.3 5.1, 5.3 5.2, 5.2 5.1)))")
    assert kind == G.MULTIPOLYGON and [len(p) for p in multi] == [1, 2]


def test_relate(grid, spark):
    got = S.Spatial.of(grid).relate("POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))")
    assert xy(got) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert xy(S.Spatial.of(grid).relate("POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))", "within")) == [(1, 1)]
    assert len(xy(S.Spatial.of(grid).relate(["POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))", "POINT(3 3)"][:1], "disjoint"))) == 8
    with pytest.raises(ValueError):
        S.Spatial.of(grid).relate([])


def test_overlap_against_boxes(spark):
    verts, boxes = [], []
    for k, (cx, cy) in enumerate((x, y) for x in (10.3, 20.3, 30.3) for y in (10.3, 20.3, 30.3)):
        h = 4.0 if k else 14.0  # one box is far larger than the others
        boxes.append((cx - h, cx + h, cy - h, cy + h))
        verts += [(k, o, x, y) for o, (x, y) in enumerate(((cx - h, cy - h), (cx + h, cy - h), (cx + h, cy + h), (cx - h, cy + h), (cx - h, cy - h)))]
    polys = S.polygons(spark.createDataFrame(verts, "poly_ID int, ord int, x double, y double"))
    pts = [(i, 0.3 + 0.5 * (i % 70), 0.3 + 0.5 * (i // 70), i % 3) for i in range(4900)]
    pf = spark.createDataFrame(pts, "feat_ID int, x_index double, y_index double, count int")
    got = {(r.poly_ID, r.feat_ID) for r in S.overlap(polys, pf).collect()}
    assert got == {(k, i) for k, (a, b, c, d) in enumerate(boxes) for i, x, y, _ in pts if a <= x <= b and c <= y <= d}
    plan = S.overlap(polys, pf)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert {round(r.area) for r in S.areas(polys).collect()} == {64, 784}
    assert S.vertices(polys).count() == 36
    found = S.overlap(polys, pf, ["count"]).withColumn("feat_ID", F.concat(F.lit("g"), F.col("feat_ID") % 12))
    m = S.overlap_matrix(found, polys.select(F.col("poly_ID").alias("cell_id")), spark.createDataFrame([(f"g{i}",) for i in range(13)], "feat_id string"), "count")
    assert m.dim() == (13, 9) and [r.feat_id for r in m.feats.orderBy("col_id").collect()] == [f"g{i}" for i in range(13)]
    assert m.triplets.agg(F.sum("value")).first()[0] == sum(pts[i][3] for _, i in got)


def test_tiles(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in rng.random((2000, 2)) ** 2], "x_index double, y_index double")
    plan = S.quadtree(df, 300)
    got = S.tiled(df, plan)
    assert got.where("tile_index is null").count() == 0 and max(r["count"] for r in got.groupBy("tile_index").count().collect()) <= 300
    assert S.quadtree(df, float("inf"))[0][0] == 0 and len(S.quadtree(df, float("inf"))) == 1
    assert S.tile_threshold(5) == float("inf") and S.tile_threshold(10**9) == 1e6 and S.tile_threshold(10**6, "polygons") == 5e5


def test_tiled_files_prune(spark, tmp_path, capsys):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((500, 2)))], "id int, x_index double, y_index double")
    uid, plan = writers.write_tiled(df, str(tmp_path), threshold=100)
    own = readers.read_tiles(spark, f"{tmp_path}/source_id={uid}", [0, 1])
    own.explain("formatted")
    assert "PartitionFilters: [isnotnull(tile_index" in capsys.readouterr().out.replace("PartitionFilters: [tile_index", "PartitionFilters: [isnotnull(tile_index")
    back = readers.read_tiles(spark, f"{tmp_path}/source_id={uid}")
    assert back.count() == 500 and back.groupBy("tile_index").agg(F.min("row_index").alias("a"), F.max("row_index").alias("b"), F.count("*").alias("n")).where("a != 1 or b != n").count() == 0


def test_stored_handles(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("c", 3)], "k string, v int")
    uid = writers.write_table(df, str(tmp_path / "t"), order=["k"])
    got = Table.read(spark, str(tmp_path / "t"))
    assert got.collect()["k"].tolist() == ["a", "b", "c"] and got.df().select("source_id").first()[0] in (uid, int(uid) if uid.isdigit() else uid)
    with pytest.raises(ValueError):
        writers.write_table(df.limit(0), str(tmp_path / "t"))
    m = Matrix.of(spark.createDataFrame([(5, 7, 2.0), (5, 9, 1.0), (8, 7, 4.0), (8, 7, 1.0)], "row_id long, col_id long, value double"))
    writers.write_matrix(m, str(tmp_path / "m"))
    back = readers.read_matrix(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, back.triplets.collect())) == [(1, 1, 2.0), (1, 2, 1.0), (2, 1, 5.0)] and {r.nnz for r in back.cells.collect()} == {1, 2}
    writers.write_market(m, str(tmp_path / "mm"))
    assert spark.read.text(str(tmp_path / "mm/matrix")).count() == 3
    g = Graph.of(spark.createDataFrame([(2, 1, 0.5)], "from_id int, to_id int, weight double"))
    writers.write_graph(g, str(tmp_path / "g"))
    assert readers.read_graph(spark, str(tmp_path / "g")).counts() == (1, 2)
    assert [r.row_index for r in with_row_index(spark.range(100).repartition(7), ["id"], 10).orderBy("id").collect()] == list(range(11, 111))


def test_formats(spark, tmp_path):
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n3 2 3\n1 1 4\n3 1 1\n2 2 7\n")
    (tmp_path / "barcodes.tsv").write_text("AA\nBB\n")
    (tmp_path / "features.tsv").write_text("id1\tx\tt\nid2\tx\tt\nid3\tz\tt\n")
    m = readers.matrix_market(spark, str(tmp_path / "matrix.mtx"), str(tmp_path / "barcodes.tsv"), str(tmp_path / "features.tsv"))
    assert sorted(map(tuple, m.named().collect())) == [("AA", "x--1", 4.0), ("AA", "z", 1.0), ("BB", "x--2", 7.0)]
    (tmp_path / "w.csv").write_text("fov,cell_ID,A,B\n1,0,5,5\n1,1,0,3\n2,1,0,0\n")
    c = readers.cosmx_expression(spark, str(tmp_path / "w.csv"), 4)
    assert sorted(map(tuple, c.named().collect())) == [("c_4_1_1", "B", 3.0)] and c.cells.count() == 2
    assert readers.cosmx_expression(spark, str(tmp_path / "w.csv"), 4, [2]).cells.first().cell_id == "c_4_2_1"
    assert c.cells.select(readers.fov_of(F.col("cell_id"))).distinct().count() == 2 and readers.drop_empty_features(c).feats.count() == 1
    f = {r.feat_id: r.feat_type for r in readers.split_features(spark.createDataFrame([("NegPrb1",), ("ACTB",), ("SysNeg",)], "feat_id string"), {"neg": "^Neg", "sys": "Neg"}, "rna").collect()}
    assert f == {"NegPrb1": "neg", "ACTB": "rna", "SysNeg": "sys"}
    spark.createDataFrame([(1, "c", "g", 1.0, 2.0, 30.0), (2, "c", "g", 1.0, 2.0, 10.0)], "transcript_id long, cell_id string, feature_name string, x_location double, y_location double, qv double").write.parquet(str(tmp_path / "t.parquet"))
    t = readers.xenium_transcripts(spark, str(tmp_path / "t.parquet")).collect()
    assert [(r.feat_ID, r.y_index) for r in t] == [("g", -2.0)]
    spark.createDataFrame([("c1", p, float(x), float(y)) for p in (1, 2) for x, y in ((p, 0), (p + 0.5, 0), (p, 1))], "cell_id string, label_id int, vertex_x double, vertex_y double").coalesce(1).write.parquet(str(tmp_path / "b.parquet"))
    assert readers.boundaries(spark, str(tmp_path / "b.parquet")).count() == 1 and readers.boundaries(spark, str(tmp_path / "b.parquet"), split=True).count() == 2
    b = readers.bin_records(spark.createDataFrame([("g", 5, 1, 2.0), ("g", 5, 1, 1.0), ("h", 0, 3, 4.0)], "gene string, x int, y int, count double"))
    assert sorted(map(tuple, b.named().collect())) == [("bin_0_3", "h", 4.0), ("bin_5_1", "g", 3.0)]
    code = spark.range(3).select(ids.cell_code(F.col("id") + 10, F.lit(2)).alias("c")).collect()
    assert code[0].c == "aaaaaaak-2"


def test_project(spark, tmp_path):
    p = Project(str(tmp_path / "p"))
    m = Matrix.of(spark.createDataFrame([(1, 1, 2.0)], "row_id long, col_id long, value double"))
    base = p.write(m)
    top = p.write(spark.createDataFrame([("x", 1)], "k string, v int"), depends=[base], note="n")
    lost = p.write({"some": "object"})
    assert len(p) == 3 and p[top, "depends"] == [base] and p.read(spark, lost) == {"some": "object"} and p.frame(spark).count() == 3
    assert p.read(spark, base).triplets.count() == 1 and p.read(spark, top).nrow() == 1
    p.save("main", {"table": top}, [top])
    p.save("main", {"table": top, "v": 2}, [top])
    assert len(p.snapshots()) == 1 and p.load("main")["v"] == 2
    assert p.prune(dry_run=True) == [lost] and p.prune() == [lost] and lost not in p and base in p
    with pytest.raises(KeyError, match="did you mean main"):
        p.load("mian")
    p[base, "extra"] = 5
    assert Project(str(tmp_path / "p"))[base, "extra"] == 5
    p.delete("main")
    assert set(p.prune()) == {base, top} and len(p) == 0


def test_views(spark):
    cells = spark.createDataFrame([(c,) for c in "abcd"], "cell_id string")
    meta = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "cell_id string, q int")
    place = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 1.0), ("c", 5.0, 5.0)], "cell_id string, x_index double, y_index double")
    got = resolve_view(cells, [{"filter": "q >= 2", "column": "q"}, {"crop": (0, 2, 0, 2)}], [(meta, "cell_id")], place)
    assert [r.cell_id for r in got.collect()] == ["b"] and apply_view(got, place).count() == 1
    with pytest.raises(KeyError):
        resolve_view(cells, [{"filter": "z > 1", "column": "z"}], [(meta, "cell_id")])


def test_every_query_runs_on_the_smallest_tables(spark):
    for name in ("mat_norm_grouped_stats", "pip_rectangles", "overlap_to_matrix_count", "graph_label_props", "sample_systematic", "page_scores"):
        assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
