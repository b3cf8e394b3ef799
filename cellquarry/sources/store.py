"""Stores on disk: geometry with recorded extent and tiles, handles by kind, options, reports."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellquarry.operators.matrix import Matrix
from cellquarry.operators.spatial import Spatial, quadtree, seed_grid, tile_threshold
from cellquarry.operators.table import Table
from cellquarry.plans.store import shared_dir
from cellquarry.sources import readers, writers


@dataclass
class Options:
    """Defaults of the sinks and reads, to be changed in place."""

    parquet_compression: str = "snappy"
    plot_sample_max: int = 100_000
    inline_ids: int = 1_000
    dump_dir: str | None = None  # where unnamed artifacts go; None: the shared folder
    uid_bytes: int = 8


OPTIONS = Options()


def dump_dir(spark: SparkSession, path: str | None = None) -> str:
    """The folder of unnamed artifacts; a path sets it for the rest of the program."""
    if path:
        OPTIONS.dump_dir = path
    return (OPTIONS.dump_dir or f"{shared_dir(spark)}/dump").rstrip("/")


# ---- files


def _fs(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark._jvm, at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, root: str) -> bool:
    _, at, fs = _fs(spark, root)
    return bool(fs.exists(at))


def paths(spark: SparkSession, root: str) -> list[str]:
    """The data files of a store, in order."""
    _, at, fs = _fs(spark, root)
    if not fs.exists(at):
        return []
    out, files = [], fs.listFiles(at, True)
    while files.hasNext():
        name = str(files.next().getPath())
        if not any(p.startswith(("_", ".")) for p in name.split(str(at), 1)[-1].split("/") if p):
            out.append(name)
    return sorted(out)


def _put_json(spark: SparkSession, path: str, data: dict) -> None:
    _, at, fs = _fs(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(json.dumps(data).encode()))
    finally:
        out.close()


def _get_json(spark: SparkSession, path: str) -> dict | None:
    if not exists(spark, path):
        return None
    return json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one small file


# ---- geometry


def geoparquet_meta(kind: str, extent: tuple | None, crs: str) -> dict:
    """The column description that GeoParquet puts into a footer; Spark writes no footer keys, so it stands in the side file."""
    box = [extent[0], extent[2], extent[1], extent[3]] if extent else None
    return {"version": "1.1.0", "primary_column": "geom", "columns": {"geom": {"encoding": "WKB", "geometry_types": [kind], "crs": crs or None} | ({"bbox": box} if box else {})}}


def write_geometry(df: DataFrame, root: str, kind: str = "points", uid: str | None = None, crs: str = "", tiled: bool = True, threshold: float | None = None, plan: list | None = None, dry_run: bool = False) -> tuple[str | None, list[tuple]]:
    """Points or polygons under root/source_id=uid, in tiles or as one, in Morton order; extent, crs, largest half side and tiles stand in root/_meta/uid.json.

    Returns (uid, plan). The first tiles make a grid that suits the sides of the extent; each splits until it holds ``threshold`` rows at most.
    """
    r = df.agg(F.min("x_index"), F.max("x_index"), F.min("y_index"), F.max("y_index"), F.count("*")).first()
    if not r[4]:
        raise ValueError("no rows")
    box = tuple(map(float, r[:4]))
    limit = threshold if threshold is not None else tile_threshold(r[4], kind)
    plan = plan or (quadtree(df, limit, box, seed=seed_grid(box)) if tiled and limit < float("inf") else [(0, *box)])
    if dry_run:
        return None, plan
    uid, _ = writers.write_tiled(df, root, uid, plan=plan, compression=OPTIONS.parquet_compression)
    radius = df.agg(F.max(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))) / 2).first()[0] if "xmin" in df.columns else 0.0
    meta = {"extent": box, "crs": crs, "kind": kind, "max_radius": float(radius or 0.0), "tiles": [list(t) for t in plan], "geo": geoparquet_meta("Point" if kind == "points" else "MultiPolygon", box, crs)}
    _put_json(spark := df.sparkSession, f"{root}/_meta/{uid}.json", meta)
    _put_json(spark, f"{root}/source_id={uid}/_meta.json", meta)
    return uid, plan


def read_geometry(spark: SparkSession, root: str, uid: str | None = None) -> Spatial:
    """A stored geometry; with one source (``uid`` or the only one) its recorded extent and tiles serve crops and extents."""
    sources = [uid] if uid else sorted({p.split("source_id=")[1].split("/")[0] for p in paths(spark, root) if "source_id=" in p})
    meta = _get_json(spark, f"{root}/_meta/{sources[0]}.json") if len(sources) == 1 else None
    df = spark.read.option("basePath", root).parquet(*(f"{root}/source_id={s}" for s in sources))
    return Spatial.of(df.withColumn("source_id", F.col("source_id").cast("string")), meta)


# ---- handles by kind

KINDS: dict[str, Callable[[SparkSession, str], object]] = {
    "table": Table.read,
    "geometry": read_geometry,
    "matrix": readers.read_matrix,
    "graph": readers.read_graph,
}
#: Other names of the kinds.
ALIASES = {"parquet": "table", "parquetgeom": "geometry", "parquetgeomtile": "geometry", "parquetexpr": "matrix", "parquetedge": "graph"}


def open_store(spark: SparkSession, path: str, kind: str = "table"):
    """The handle of a stored thing by kind."""
    kind = ALIASES.get(kind.lower(), kind.lower())
    if kind not in KINDS:
        raise ValueError(f"no such kind: {kind}")
    return KINDS[kind](spark, path)


def file_to_file(spark: SparkSession, source: str, target: str, from_format: str, to_format: str = "parquet", via: Callable[[DataFrame], DataFrame] | None = None, **options: str) -> None:
    """One format rewritten as another, nothing in between but a projection."""
    df = spark.read.format(from_format).options(**options).load(source)
    (df.transform(via) if via else df).write.format(to_format).mode("errorifexists").save(target)


def chunk_info(m: Matrix, executor_mb: float = 1024.0, fractions: tuple[float, ...] = (0.10, 0.15, 0.20, 0.25, 0.35, 0.50)) -> DataFrame:
    """(pass, fraction, rows, chunks, peak_mb): how many cells of a matrix fit a share of a task's memory, as sparse rows (12 bytes an entry) or triplets (48)."""
    spark, n, nnz = m.cells.sparkSession, m.cells.count(), m.triplets.count()
    if not n or not nnz:
        raise ValueError("an empty matrix")
    out = []
    for name, size in (("sparse rows", 12.0), ("triplets", 48.0)):
        per = nnz / n * size
        for f in fractions:
            rows = int(max(1, min(n, executor_mb * 1e6 * f / per)))
            out.append((name, f, rows, -(-n // rows), rows * per / 1e6))
    return spark.createDataFrame(out, "pass string, fraction double, rows long, chunks long, peak_mb double")


def view_name(df: DataFrame, name: str) -> str:
    """The quoted name under which SQL sees a frame."""
    df.createOrReplaceTempView(name)
    return f"`{name}`"
