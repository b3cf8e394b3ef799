"""Sinks: tables, tiled geometry, matrices, graphs, text exports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellquarry.operators.graph import Graph
from cellquarry.operators.matrix import Matrix
from cellquarry.operators.spatial import morton, quadtree, tile_threshold, tiled
from cellquarry.plans.indexing import with_row_index
from cellquarry.plans.store import cleaned_up


def new_uid() -> str:
    return uuid.uuid4().hex[:8]


def write_table(df: DataFrame, root: str, uid: str | None = None, order: Sequence[str] = (), offset: int = 0, mode: str = "append", compression: str = "snappy", callback: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """Writes root/source_id=uid with a row index; an empty table is an error. Returns the uid."""
    if not df.limit(1).count():
        raise ValueError("no rows")
    uid = uid or new_uid()
    df = df.transform(callback) if callback else df
    df = df.drop("row_index", "source_id")
    with_row_index(df, order, offset).write.mode(mode).option("compression", compression).parquet(f"{root}/source_id={uid}")
    return uid


def write_batches(df: DataFrame, root: str, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, uid: str | None = None, order: Sequence[str] = ()) -> str:
    """write_table() of what ``fn`` makes of the rows' Arrow batches, which never meet in one place."""
    return write_table(df.mapInArrow(fn, schema), root, uid, order)


def rewrite_table(spark: SparkSession, source: str, target: str, uid: str | None = None) -> str:
    """A stored table written anew as one source: rows in the order of source, tile and index, which are then numbered again."""
    df = spark.read.parquet(source)
    order = [c for c in ("source_id", "tile_index", "row_index") if c in df.columns]
    if not df.limit(1).count():
        raise ValueError("no rows")
    uid = uid or new_uid()
    numbered = with_row_index(df.withColumnsRenamed({c: f"__{c}" for c in order}), [f"__{c}" for c in order]).drop(*(f"__{c}" for c in order))
    numbered.write.mode("append").parquet(f"{target}/source_id={uid}")
    return uid


def write_tiled(df: DataFrame, root: str, uid: str | None = None, threshold: float | None = None, plan: Sequence[tuple] | None = None, kind: str = "points", dry_run: bool = False, compression: str = "snappy") -> tuple[str | None, list[tuple]]:
    """Geometry by quadtree tile, in Morton order within a tile; the row index restarts in each. Returns (uid, plan)."""
    if plan is None:
        n = df.count()
        plan = quadtree(df, tile_threshold(n, kind) if threshold is None else threshold)
    if dry_run:
        return None, list(plan)
    box = (min(t[1] for t in plan), max(t[2] for t in plan), min(t[3] for t in plan), max(t[4] for t in plan))
    uid = uid or new_uid()
    out = tiled(df, plan).where("tile_index is not null").withColumn("__z", morton(F.col("x_index"), F.col("y_index"), box))
    out = with_row_index(out, ["__z"], within=["tile_index"])
    out = out.withColumn("tile_index", F.lpad(F.col("tile_index").cast("string"), max(3, len(str(max(t[0] for t in plan)))), "0"))  # folders in order; readers see numbers
    out.repartition("tile_index").sortWithinPartitions("tile_index", "__z").drop("__z").write.mode("append").partitionBy("tile_index").option("compression", compression).parquet(f"{root}/source_id={uid}")
    return uid, list(plan)


def renumbered(m: Matrix) -> Matrix:
    """Cells and features numbered 1 .. n in the order of their ids."""
    c = with_row_index(m.cells, ["row_id"], name="pos")
    f = with_row_index(m.feats, ["col_id"], name="pos")
    t = m.triplets.join(c.select("row_id", F.col("pos").alias("r")), "row_id").join(f.select("col_id", F.col("pos").alias("c")), "col_id").select(F.col("r").alias("row_id"), F.col("c").alias("col_id"), "value")
    cells, feats = c.select(F.col("pos").alias("row_id"), "cell_id"), f.select(F.col("pos").alias("col_id"), "feat_id")
    return Matrix(t, cells, feats, t)


def write_matrix(m: Matrix, root: str, renumber: bool = True, mode: str = "errorifexists", order: DataFrame | None = None, compression: str = "snappy", placed: bool = False) -> None:
    """Triplets sorted by cell, then feature, so that cell ranges prune; dimensions beside them with counts. ``order``: (cell_id, pos) for another order.

    ``placed``: the triplets' partitions are ranges of cells already.
    """
    if m.transposed:
        raise ValueError("write before transposing")
    if order is not None:
        new = m.cells.join(order, "cell_id").select("row_id", "cell_id", F.col("pos").cast("long").alias("r"))
        t = m.triplets.join(new.select("row_id", "r"), "row_id").select(F.col("r").alias("row_id"), "col_id", "value")
        m = Matrix(t, new.select(F.col("r").alias("row_id"), "cell_id"), m.feats, t)
    elif renumber:
        m = renumbered(m)
    spark = m.cells.sparkSession
    with cleaned_up(spark):
        t = m.triplets.where("value != 0")
        (t if placed else t.repartitionByRange("row_id")).sortWithinPartitions("row_id", "col_id").write.mode(mode).option("compression", compression).parquet(f"{root}/triplets")
    t = t if mode == "append" else spark.read.schema(t.schema).parquet(f"{root}/triplets")  # counted from what is written, not made again
    for dim, key, name in ((m.cells, "row_id", "cells"), (m.feats, "col_id", "feats")):
        dim.join(t.groupBy(key).agg(F.count("*").alias("nnz")), key, "left").na.fill(0, ["nnz"]).write.mode(mode).parquet(f"{root}/{name}")


def write_graph(g: Graph, root: str, mode: str = "errorifexists") -> None:
    g.edges.repartitionByRange("from_id").sortWithinPartitions("from_id", "to_id").write.mode(mode).parquet(f"{root}/edges")
    g.nodes.write.mode(mode).parquet(f"{root}/nodes")


def write_market(m: Matrix, root: str) -> None:
    """MatrixMarket lines (feature, cell, value) under matrix/, the header in header.txt/, names in barcodes/ and features/."""
    r = renumbered(m)
    spark, n = r.cells.sparkSession, r.triplets.count()
    r.triplets.orderBy("row_id", "col_id").select(F.concat_ws(" ", "col_id", "row_id", F.col("value").cast("string"))).write.text(f"{root}/matrix")
    head = f"%%MatrixMarket matrix coordinate real general\n{r.feats.count()} {r.cells.count()} {n}"
    spark.createDataFrame([(x,) for x in head.split("\n")], "value string").coalesce(1).write.text(f"{root}/header")
    r.cells.orderBy("row_id").select(F.col("cell_id").cast("string")).write.text(f"{root}/barcodes")
    r.feats.orderBy("col_id").select(F.col("feat_id").cast("string")).write.text(f"{root}/features")


def market_file(spark: SparkSession, root: str) -> str:
    """Joins header/ and matrix/ of write_market() into one file matrix.mtx, in order, by the file system; returns its path."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(f"{root}/{p}")
    fs = at("matrix").getFileSystem(conf)
    parts = [p for folder in ("header", "matrix") for p in sorted(str(f.getPath()) for f in fs.listStatus(at(folder))) if "/part-" in p]
    out = fs.create(at("matrix.mtx"), True)
    try:
        for p in parts:
            own = fs.open(jvm.org.apache.hadoop.fs.Path(p))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(own, out, conf, False)
            finally:
                own.close()
    finally:
        out.close()
    return f"{root}/matrix.mtx"
