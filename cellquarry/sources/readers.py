"""Sources: stored handles, matrix formats and instrument outputs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellquarry.functions.ids import distinct_names
from cellquarry.operators.graph import Graph
from cellquarry.operators.matrix import Matrix
from cellquarry.operators.spatial import points, polygons
from cellquarry.plans.indexing import with_row_index
from cellquarry.plans.rules import partitions, small


def read_matrix(spark: SparkSession, root: str) -> Matrix:
    t = spark.read.parquet(f"{root}/triplets")
    return Matrix(t, spark.read.parquet(f"{root}/cells"), spark.read.parquet(f"{root}/feats"), t, parts=partitions(t))


def read_graph(spark: SparkSession, root: str, directed: bool = False) -> Graph:
    return Graph(spark.read.parquet(f"{root}/edges"), spark.read.parquet(f"{root}/nodes"), directed)


def read_tiles(spark: SparkSession, root: str, tiles: Sequence[int] | None = None) -> DataFrame:
    """Tiled geometry; ``tiles`` prunes partitions."""
    df = spark.read.parquet(root)
    return df if tiles is None else df.where(F.col("tile_index").isin(list(tiles)))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file in order, numbered from 1 (the index of a single read)."""
    return with_row_index(spark.read.text(path), name="n")


def matrix_market(spark: SparkSession, mtx: str, barcodes: str, features: str, feature_id_col: int = 2) -> Matrix:
    """A MatrixMarket triple (gz or not): 1-based feature, cell, value. The first line that is no comment is the header, whose dimensions must agree; entries may read like it."""
    text = spark.read.text(mtx).select(F.trim("value").alias("value")).where("value not like '\\%%' and value != ''")
    part = F.split("value", r"\s+")
    cells = _lines(spark, barcodes).select(F.col("n").alias("row_id"), F.col("value").alias("cell_id"))
    feats = _lines(spark, features).select(F.col("n").alias("col_id"), F.element_at(F.split("value", "\t"), F.least(F.lit(feature_id_col), F.size(F.split("value", "\t")))).alias("feat_id"))
    feats = distinct_names(feats, "feat_id", "col_id")
    head = [int(x) for x in text.first()["value"].split()]
    if head[:2] != [feats.count(), cells.count()]:
        raise ValueError("header and names differ in size")
    line = text.first()["value"]
    same = text.where(F.col("value") == line)
    own = text.where(F.col("value") != line).union(spark.range(same.count() - 1).select(F.lit(line)))  # all but one of the lines that equal the header
    t = own.select(part[1].cast("long").alias("row_id"), part[0].cast("long").alias("col_id"), part[2].cast("double").alias("value"))
    return Matrix.of(t, cells, feats)


def wide_csv(spark: SparkSession, path: str, cell_id_col: str = "cell_ID", skip: Sequence[str] = (), rows: Column | None = None, cell_name: Column | None = None) -> Matrix:
    """One row for each cell, one column for each feature; cells of zeros keep their id. ``rows`` filters, ``cell_name`` renames."""
    df = spark.read.csv(path, header=True)
    df = df.where(rows) if rows is not None else df
    feats = [c for c in df.columns if c not in (cell_id_col, *skip)]
    df = df.withColumn("__cell", (cell_name if cell_name is not None else F.col(cell_id_col)).cast("string"))
    df = with_row_index(df, name="row_id")
    dims = spark.createDataFrame([(i + 1, f) for i, f in enumerate(feats)], "col_id long, feat_id string")  # as many as columns
    long = df.select("row_id", *(F.col(f"`{f}`").cast("double").alias(f) for f in feats)).unpivot(["row_id"], feats, "feat_id", "value").where("value != 0")
    t = long.join(small(dims, len(feats)), "feat_id").select("row_id", "col_id", "value")
    return Matrix(t, df.select("row_id", F.col("__cell").alias("cell_id")), dims, t)


def cosmx_expression(spark: SparkSession, path: str, slide: int = 1, fovs: Sequence[int] | None = None) -> Matrix:
    """Wide counts with fov and cell_ID; cell 0 is background. Ids: c_<slide>_<fov>_<cell>."""
    keep = F.col("cell_ID").cast("int") != 0
    if fovs is not None:
        keep = keep & F.col("fov").cast("int").isin(list(fovs))
    return wide_csv(spark, path, "cell_ID", ["fov"], keep, F.format_string(f"c_{slide}_%d_%d", F.col("fov").cast("int"), F.col("cell_ID").cast("int")))


def split_features(feats: DataFrame, keywords: Mapping[str, str], rest: str, name: str = "feat_id") -> DataFrame:
    """Adds feat_type: the first keyword (regular expression) that matches, else ``rest``."""
    out = None
    for kind, pattern in keywords.items():
        hit = F.col(name).rlike(pattern)
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return feats.withColumn("feat_type", out.otherwise(rest) if out is not None else F.lit(rest))


def fov_of(cell_id: Column) -> Column:
    return F.regexp_extract(cell_id, r"^c_\d+_(\d+)_", 1).cast("int")


def xenium_transcripts(spark: SparkSession, path: str, qv: float = 20.0, flip: bool = True, drop: Sequence[str] = ()) -> DataFrame:
    """Points of good quality with feat_ID; y is negated when flipped."""
    df = spark.read.parquet(path) if "parquet" in path else spark.read.csv(path, header=True, inferSchema=True)
    df = df.where(F.col("qv") >= qv).withColumn("feature_name", F.col("feature_name").cast("string")).withColumn("cell_id", F.col("cell_id").cast("string"))
    df = df.withColumn("y_location", -F.col("y_location") if flip else F.col("y_location")).withColumnRenamed("feature_name", "feat_ID").drop(*drop)
    return points(df, "x_location", "y_location")


#: Names of the part column of boundary files, by preference.
PART_COLUMNS = ("label_id", "part", "part_id", "polygon_id")


def boundaries(spark: SparkSession, path: str, split: bool = False, flip: bool = True) -> DataFrame:
    """Polygons from (cell_id, vertex_x, vertex_y[, part]) rows in file order."""
    df = spark.read.parquet(path) if "parquet" in path else spark.read.csv(path, header=True, inferSchema=True)
    part = next((c for c in PART_COLUMNS if c in df.columns), None)
    df = with_row_index(df, name="ord").withColumn("vertex_y", -F.col("vertex_y") if flip else F.col("vertex_y"))
    return polygons(df.withColumnRenamed("cell_id", "poly_ID"), "poly_ID", "vertex_x", "vertex_y", "ord", part, split)


def drop_empty_features(m: Matrix) -> Matrix:
    return m.subset(feats=m.feats.join(m.triplets.select("col_id").distinct(), "col_id", "left_semi").select("feat_id"))


def bin_mapping(spark: SparkSession, path: str, bin_col: str = "square_008um", cell_col: str = "cell_id") -> DataFrame:
    """(bin, cell) pairs where both are known."""
    return spark.read.parquet(path).select(F.col(bin_col).alias("bin"), F.col(cell_col).alias("cell")).where("bin is not null and cell is not null").distinct()


def parent_units(mapping: DataFrame, unit: str) -> DataFrame:
    """One row for each unit: first known ids, any of flags; other columns stay only where they are functions of the unit."""
    kinds = dict(mapping.dtypes)
    cols = [c for c in mapping.columns if c != unit]
    many = mapping.groupBy(unit).agg(*(F.count_distinct(c).alias(c) for c in cols if kinds[c] != "boolean")).agg(*(F.max(c).alias(c) for c in cols if kinds[c] != "boolean")).first() if any(kinds[c] != "boolean" for c in cols) else {}
    aggs = [F.max(c).alias(c) if kinds[c] == "boolean" else F.first(c, ignorenulls=True).alias(c) for c in cols if kinds[c] == "boolean" or (many[c] or 0) <= 1]
    return mapping.where(F.col(unit).isNotNull()).groupBy(unit).agg(*aggs)


def bin_records(records: DataFrame, order: str = "place") -> Matrix:
    """A matrix of bins from (gene, x, y, count[, at]) records; duplicate genes add up.

    Bins are numbered by y and x, or, ``order`` "seen", in the order in which they first come by ``at``.
    """
    if order == "seen":
        seen = records.groupBy("x", "y").agg(F.min("at").alias("at"))
        place = with_row_index(seen, ["at", "y", "x"], name="row_id")
    else:
        place = with_row_index(records.select("x", "y").distinct(), ["y", "x"], name="row_id")
    genes = records.select("gene").distinct()
    feats = with_row_index(genes, ["gene"], name="col_id").select("col_id", F.col("gene").alias("feat_id"))
    t = records.drop("at").join(place, ["x", "y"]).join(feats, records["gene"] == feats["feat_id"]).select("row_id", "col_id", F.col("count").cast("double").alias("value"))
    return Matrix.of(t, place.select("row_id", F.format_string("bin_%d_%d", F.col("x").cast("long"), F.col("y").cast("long")).alias("cell_id")), feats)


def tenx_h5(spark: SparkSession, path: str, feature_id_col: int = 2, batch_cells: int = 50_000) -> Matrix:
    """A 10x HDF5 matrix (CSC by cell), read in ranges of cells on the executors; needs h5py there."""
    import h5py

    with h5py.File(path, "r") as f:
        g = f[next(iter(f))]
        n, barcodes = int(g["shape"][1]), [b.decode() for b in g["barcodes"][:]]
        names = g["features/name" if feature_id_col == 2 else "features/id"] if "features" in g else g["gene_names"]
        genes = [b.decode() for b in names[:]]

    def run(batches):
        import h5py

        with h5py.File(path, "r") as f:
            g = f[next(iter(f))]
            for b in batches:
                for first, last in zip(b["first"], b["last"], strict=True):
                    at = g["indptr"][first : last + 1]
                    rows = pd.Series(range(first + 1, last + 1)).repeat(at[1:] - at[:-1]).reset_index(drop=True)
                    yield pd.DataFrame({"row_id": rows, "col_id": g["indices"][at[0] : at[-1]].astype("int64") + 1, "value": g["data"][at[0] : at[-1]].astype("float64")})

    ranges = [(i, min(i + batch_cells, n)) for i in range(0, n, batch_cells)]
    t = spark.createDataFrame(ranges, "first long, last long").repartition(len(ranges)).mapInPandas(run, "row_id long, col_id long, value double")
    cells = spark.createDataFrame([(i + 1, b) for i, b in enumerate(barcodes)], "row_id long, cell_id string")
    feats = distinct_names(spark.createDataFrame([(i + 1, g) for i, g in enumerate(genes)], "col_id long, feat_id string"), "feat_id", "col_id")
    return Matrix.of(t, cells, feats)


def gene_ranges(counts: np.ndarray, most: int = 2_000_000) -> list[tuple[int, int]]:
    """(first, end) of runs of genes with about ``most`` records each."""
    upto, out, first = np.cumsum(counts), [], 0
    while first < len(counts):
        before = int(upto[first - 1]) if first else 0
        end = max(first + 1, int(np.searchsorted(upto, before + most, side="right")))
        out.append((first, end))
        first = end
    return out


def gef_range(genes: np.ndarray, names: np.ndarray, read: Callable[[int, int], np.ndarray], first: int, end: int) -> pd.DataFrame:
    """Records of a run of genes: one read of the expression table, names repeated; ``at`` is the record's place."""
    lo = int(genes["offset"][first])
    n = genes["count"][first:end].astype(np.int64)
    e = read(lo, lo + int(n.sum()))
    return pd.DataFrame({"gene": np.repeat(names[first:end], n), "x": e["x"].astype("int64"), "y": e["y"].astype("int64"), "count": e["count"].astype("float64"), "at": lo + np.arange(len(e))})


def gef_records(spark: SparkSession, path: str, bin_size: int = 100, gene_column: str = "geneName") -> DataFrame:
    """(gene, x, y, count, at) records of a binned gene expression file, read in runs of genes; needs h5py."""
    import h5py

    def run(batches):
        import h5py

        with h5py.File(path, "r") as f:
            g = f[f"geneExp/bin{bin_size}"]
            genes = g["gene"][:]
            names = np.array([x.decode() for x in genes[gene_column]])
            for b in batches:
                for first, end in zip(b["first"], b["last"], strict=True):
                    yield gef_range(genes, names, lambda lo, hi: g["expression"][lo:hi], first, end)

    with h5py.File(path, "r") as f:
        ranges = gene_ranges(f[f"geneExp/bin{bin_size}/gene"][:]["count"])
    return spark.createDataFrame(ranges, "first long, last long").repartition(max(1, len(ranges))).mapInPandas(run, "gene string, x long, y long, count double, at long")


def cell_records(cells: np.ndarray, names: np.ndarray, read: Callable[[int, int], np.ndarray], first: int, end: int) -> pd.DataFrame:
    """(row_id, gene, value) of a run of cells from the cell-major table."""
    lo = int(cells["offset"][first])
    n = cells["geneCount"][first:end].astype(np.int64)
    e = read(lo, lo + int(n.sum()))
    return pd.DataFrame({"row_id": np.repeat(np.arange(first + 1, end + 1), n), "gene": names[e["geneID"].astype(np.int64)], "value": e["count"].astype("float64")})


def gene_records(genes: np.ndarray, names: np.ndarray, ids: np.ndarray, read: Callable[[int, int], np.ndarray], first: int, end: int) -> pd.DataFrame:
    """(row_id, gene, value) of a run of genes from the gene-major table; records of unknown cells drop."""
    start = np.concatenate([[0], np.cumsum(genes["cellCount"].astype(np.int64))])
    e = read(int(start[first]), int(start[end]))
    order = np.argsort(ids, kind="stable")
    at = np.minimum(np.searchsorted(ids[order], e["cellID"]), len(ids) - 1)
    known = ids[order][at] == e["cellID"]
    gene = np.repeat(names[first:end], genes["cellCount"][first:end].astype(np.int64))
    return pd.DataFrame({"row_id": (order[at] + 1)[known], "gene": gene[known], "value": e["count"].astype("float64")[known]})


def cellbin_gef(spark: SparkSession, path: str, gene_column: str = "geneName") -> Matrix:
    """The cells of a segmented gene expression file: names cell_<id>, features sorted, duplicate gene names added up; needs h5py.

    The cell-major table is read where the file has it, else the gene-major one; either in runs on the executors.
    """
    import h5py

    def opened(f) -> tuple:
        g = f["cellBin"]
        cells, genes = g["cell"][:], g["gene"][:]
        return g, cells, genes, np.array([x.decode() for x in genes[gene_column]]), "cellExp" in g and {"offset", "geneCount"} <= set(cells.dtype.names)

    def run(batches):
        import h5py

        with h5py.File(path, "r") as f:
            g, cells, genes, names, by_cell = opened(f)
            for b in batches:
                for first, end in zip(b["first"], b["last"], strict=True):
                    yield cell_records(cells, names, lambda lo, hi: g["cellExp"][lo:hi], first, end) if by_cell else gene_records(genes, names, cells["id"], lambda lo, hi: g["geneExp"][lo:hi], first, end)

    with h5py.File(path, "r") as f:
        _, cells, genes, names, by_cell = opened(f)
    ranges = gene_ranges(cells["geneCount"] if by_cell else genes["cellCount"])
    records = spark.createDataFrame(ranges, "first long, last long").repartition(max(1, len(ranges))).mapInPandas(run, "row_id long, gene string, value double")
    feats = spark.createDataFrame([(i + 1, g) for i, g in enumerate(sorted(set(names[genes["cellCount"] > 0].tolist())))], "col_id long, feat_id string")
    dims = spark.createDataFrame([(i + 1, f"cell_{c}") for i, c in enumerate(cells["id"].tolist())], "row_id long, cell_id string")
    return Matrix.of(records.join(feats, records["gene"] == feats["feat_id"]).select("row_id", "col_id", "value"), dims, feats)
