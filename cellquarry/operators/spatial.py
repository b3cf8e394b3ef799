"""Points and polygons: crops, affine verbs, relations, spatial joins, rasters and tiles."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellquarry.functions import geometry as G
from cellquarry.operators.matrix import Matrix
from cellquarry.operators.table import Table
from cellquarry.plans.indexing import with_row_index
from cellquarry.plans.rules import half_planes, inside_box, intersect_boxes, small, tiles_meeting
from cellquarry.plans.store import forget, written

#: Relations for which boxes can be tested first.
MONOTONE = ("intersects", "touches", "crosses", "overlaps", "within", "contains", "covers", "covered_by")
RELATIONS = (*MONOTONE, "disjoint")


def morton(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Interleaved 16-bit places within a box, x in the even bits."""

    def spread(v: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    place = lambda c, lo, hi: ((c - lo) / (hi - lo if hi > lo else 1.0) * 65535).cast("long")
    return spread(place(x, box[0], box[1])).bitwiseOR(F.shiftleft(spread(place(y, box[2], box[3])), 1))


@F.pandas_udf(T.BinaryType())
def wkb_points(x: pd.Series, y: pd.Series) -> pd.Series:
    data = np.zeros(len(x), dtype=[("o", "u1"), ("t", "<u4"), ("x", "<f8"), ("y", "<f8")])
    data["o"], data["t"], data["x"], data["y"] = 1, G.POINT, x, y
    return pd.Series([r.tobytes() for r in data])


def points(df: DataFrame, x: str = "x", y: str = "y", id_col: str = "feat_ID") -> DataFrame:
    """A point geometry: x_index, y_index and WKB beside the other columns."""
    out = df.withColumns({"x_index": F.col(x).cast("double"), "y_index": F.col(y).cast("double")}).withColumn("geom", wkb_points("x_index", "y_index"))
    return out.drop(*{x, y} - {"x_index", "y_index"}) if id_col in df.columns else out


def polygons(vertices: DataFrame, id_col: str = "poly_ID", x: str = "x", y: str = "y", order: str = "ord", part: str | None = None, split: bool = False, ring: str | None = None) -> DataFrame:
    """(poly_ID, geom, x_index, y_index, xmin, xmax, ymin, ymax) from vertices; parts make one multipolygon or, ``split``, geometries of their own.

    ``ring`` numbers the rings of a part; all but the first are holes. Rings of fewer than three different places are left out, and shapes without any other.
    """
    if ring:
        vertices, part = vertices.withColumn("__part", F.struct(*(F.col(c) for c in ([part] if part else [])), F.col(ring))), "__part"
        name = vertices.schema["__part"].dataType.names
    keys = [id_col, part] if part else [id_col]
    rings = vertices.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("v"))
    if ring:
        ringed = rings.groupBy(F.col(id_col).alias("poly_ID"), *([F.col(f"__part.{name[0]}").alias("p")] if len(name) > 1 else [F.lit(0).alias("p")])).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(f"__part.{name[-1]}").alias("r"), "v"))), lambda s: s["v"]).alias("rings"))
        if split:
            rings = ringed.select(F.format_string("%s-%s", "poly_ID", "p").alias("poly_ID"), F.array("rings").alias("parts"))
        else:
            rings = ringed.groupBy("poly_ID").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "rings"))), lambda s: s["rings"]).alias("parts"))
    elif part and split:
        rings = rings.select(F.format_string("%s-%s", id_col, part).alias("poly_ID"), F.array(F.array("v")).alias("parts"))
    elif part:
        rings = rings.groupBy(F.col(id_col).alias("poly_ID")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(part).alias("p"), "v"))), lambda s: F.array(s["v"])).alias("parts"))
    else:
        rings = rings.select(F.col(id_col).alias("poly_ID"), F.array(F.array("v")).alias("parts"))
    kind = rings.schema["poly_ID"].dataType.simpleString()

    def build(batches):
        for b in batches:
            out, kept = [], []
            for i, parts in enumerate(b.column("parts").to_pylist()):
                polys = [[np.array([[p["x"], p["y"]] for p in v], float).reshape(-1, 2) for v in rings] for rings in parts]
                polys = [[ring_of(r) for r in p] for p in polys]
                polys = [[p[0], *(r for r in p[1:] if len(r) > 2)] for p in polys if len(p[0]) > 2]
                if polys:
                    kept.append(i)
                    out.append((G.wkb_multi(polys), *centre_and_box(polys)))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column("poly_ID").take(pa.array(kept, pa.int64())), pa.array(cols[0], pa.binary()), *(pa.array(c, pa.float64()) for c in cols[1:])], ["poly_ID", "geom", "x_index", "y_index", "xmin", "xmax", "ymin", "ymax"])

    return rings.mapInArrow(build, f"poly_ID {kind}, geom binary, x_index double, y_index double, xmin double, xmax double, ymin double, ymax double")


def ring_of(xy: np.ndarray) -> np.ndarray:
    """A ring without the closing place, places that follow themselves, and those that are not finite."""
    xy = xy[np.isfinite(xy).all(axis=1)]
    xy = xy[np.concatenate([[True], (xy[1:] != xy[:-1]).any(axis=1)])[: len(xy)]]
    return xy[:-1] if len(xy) > 1 and (xy[0] == xy[-1]).all() else xy


def centre_and_box(polys: list[G.Rings]) -> tuple[float, ...]:
    xy = np.vstack([r for p in polys for r in p])
    (x0, y0), (x1, y1) = xy.min(axis=0), xy.max(axis=0)
    return (x0 + x1) / 2, (y0 + y1) / 2, x0, x1, y0, y1


def vertices(df: DataFrame, id_col: str = "poly_ID") -> DataFrame:
    """(id, part, ring, ord, x, y): one row for each vertex, without the one that closes a ring."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [(i, p, k, o, float(x), float(y)) for i, g in zip(b.column(id_col).to_pylist(), b.column("geom").to_pylist(), strict=True) if g is not None for p, rings in enumerate(G.read_wkb(g)[1]) for k, r in enumerate(rings) for o, (x, y) in enumerate(r)]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(id_col).type), *(pa.array(c, pa.int32()) for c in cols[1:4]), *(pa.array(c, pa.float64()) for c in cols[4:])], [id_col, "part", "ring", "ord", "x", "y"])

    return df.select(id_col, "geom").mapInArrow(run, f"{id_col} {kind}, part int, ring int, ord int, x double, y double")


def areas(df: DataFrame, id_col: str = "poly_ID") -> DataFrame:
    """(id, area): planar, holes taken off; the shoelace sum of each row's rings in a batch function."""

    @F.pandas_udf("double")
    def area(g: pd.Series) -> pd.Series:
        return g.map(lambda b: sum(map(G.area, G.read_wkb(b)[1])))

    return df.select(id_col, area("geom").alias("area"))


@dataclass(frozen=True)
class Spatial:
    """A geometry table with a pending affine map; crops stay where they were made."""

    table: Table
    map: np.ndarray | None = None
    meta: dict | None = None  # of a stored geometry: extent, crs, tiles

    @classmethod
    def of(cls, df: DataFrame, meta: dict | None = None) -> Spatial:
        return cls(Table(df), meta=meta)

    # ---- extents

    def extent(self, exact: bool = True) -> tuple[float, float, float, float] | None:
        """xmin, xmax, ymin, ymax of the centroids as they are now.

        Not ``exact``: from the crop or the stored extent, within an open window, through the map; verbs on rows do not show, and without
        either the rows are scanned.
        """
        known = self.table.view or self.table.box or (tuple(self.meta["extent"]) if self.meta and self.meta.get("extent") else None)
        if not exact and known:
            if self.meta and self.meta.get("extent"):
                known = intersect_boxes(known, tuple(self.meta["extent"]))
            if self.map is None:
                return known
            q = G.apply(self.map, G.corners(known))
            return tuple(map(float, (q[:, 0].min(), q[:, 0].max(), q[:, 1].min(), q[:, 1].max())))
        d = self.df()
        r = d.agg(F.min("x_index"), F.max("x_index"), F.min("y_index"), F.max("y_index")).first()
        return None if r[0] is None else tuple(r)

    def envelopes(self, group: str) -> DataFrame:
        return self.df().groupBy(group).agg(F.min("x_index").alias("xmin"), F.max("x_index").alias("xmax"), F.min("y_index").alias("ymin"), F.max("y_index").alias("ymax"), ((F.min("x_index") + F.max("x_index")) / 2).alias("xmid"), ((F.min("y_index") + F.max("y_index")) / 2).alias("ymid"))

    def centre(self) -> tuple[float, float]:
        x0, x1, y0, y1 = self.extent()
        return (x0 + x1) / 2, (y0 + y1) / 2

    # ---- affine verbs: they compose on the driver into one map

    def affine(self, m: np.ndarray) -> Spatial:
        return replace(self, map=m if self.map is None else G.then(self.map, m))

    def spin(self, degrees: float, x0: float | None = None, y0: float | None = None) -> Spatial:
        c = (x0, y0) if x0 is not None and y0 is not None else self.centre()
        return self.affine(G.spin(degrees, *c))

    def rescale(self, fx: float, fy: float | None = None, x0: float | None = None, y0: float | None = None) -> Spatial:
        c = (x0, y0) if x0 is not None and y0 is not None else self.centre()
        return self.affine(G.about(G.affine(fx, 0, 0, fx if fy is None else fy), *c))

    def shear(self, fx: float = 0.0, fy: float = 0.0, x0: float | None = None, y0: float | None = None) -> Spatial:
        c = (x0, y0) if x0 is not None and y0 is not None else self.centre()
        return self.affine(G.about(G.affine(1, fx, fy, 1), *c))

    def shift(self, dx: float = 0.0, dy: float = 0.0) -> Spatial:
        return self.affine(G.affine(tx=dx, ty=dy))

    def flip(self, direction: str = "vertical", x0: float = 0.0, y0: float = 0.0) -> Spatial:
        return self.affine(G.about(G.affine(a22=-1) if direction == "vertical" else G.affine(a11=-1), x0, y0))

    def t(self) -> Spatial:
        return self.affine(G.affine(0, 1, 1, 0))

    def _xy(self) -> tuple[Column, Column]:
        x, y, m = F.col("x_index"), F.col("y_index"), self.map
        return (x, y) if m is None else (x * float(m[0, 0]) + y * float(m[1, 0]) + float(m[0, 2]), x * float(m[0, 1]) + y * float(m[1, 1]) + float(m[1, 2]))

    def df(self, geometry: bool = False) -> DataFrame:
        """Rows with mapped centroids; with ``geometry`` WKB vertices are mapped too."""
        d, m = self.table.df(), self.map
        if m is None:
            return d
        x, y = self._xy()
        if geometry and "geom" in d.columns:

            @F.pandas_udf("binary")
            def moved(g: pd.Series) -> pd.Series:
                def one(b: bytes) -> bytes:
                    kind, polys = G.read_wkb(b)
                    polys = [[G.apply(m, r) for r in p] for p in polys]
                    return G.wkb_point(*polys[0][0][0]) if kind == G.POINT else G.wkb_multi(polys)

                return g.map(one, na_action="ignore")

            d = d.withColumn("geom", moved("geom"))
        d = d.withColumns({"x_index": x, "y_index": y})
        if "xmin" not in d.columns:
            return d
        corner = lambda i, j: F.struct(*((F.col(a) * float(m[0, k]) + F.col(b) * float(m[1, k]) + float(m[k, 2])).alias(n) for k, n, a, b in ((0, "x", i, j), (1, "y", i, j))))
        d = d.withColumn("__c", F.array(*(corner(i, j) for i in ("xmin", "xmax") for j in ("ymin", "ymax"))))  # the box of the mapped box: it holds the mapped shape
        sides = {f"{a}{s}": f(F.col("__c").getField(a)) for a in "xy" for s, f in (("min", F.array_min), ("max", F.array_max))}
        return d.withColumns(sides).drop("__c")

    def centroids(self) -> DataFrame:
        """The rows as points: mapped places, without shapes."""
        return self.df().drop("geom", "xmin", "xmax", "ymin", "ymax")

    def to_pandas(self, geom: str = "", include_values: bool = True) -> pd.DataFrame:
        """Rows without geometry (""), with it as WKB ("wkb"), or a row for each vertex ("XY"), attributes beside it if asked for."""
        if geom not in ("", "wkb", "XY"):
            raise ValueError('geom is "", "wkb" or "XY"')
        d = self.df(geometry=bool(geom))
        names = [c for c in d.columns if c not in ("geom", "xmin", "xmax", "ymin", "ymax", "x_index", "y_index")]
        names = names if include_values else [c for c in names if c in ("poly_ID", "feat_ID")][:1]
        if geom != "XY":
            return d.select(*names, *(["geom"] if geom else [])).toPandas()
        d = written(d.withColumn("__key", F.monotonically_increasing_id()))
        v = vertices(d.select("__key", "geom"), "__key")
        out = v.join(d.select("__key", *names), "__key").orderBy("__key", "part", "ring", "ord").select(*names, "part", "ring", "x", "y").toPandas()
        forget(d)
        return out

    # ---- crops

    def crop(self, box: tuple[float, float, float, float]) -> Spatial:
        """Centroids in the box as mapped: the box goes back through the map, so plain comparisons reach the scan; half planes follow if it turned.

        Of a tiled geometry only the tiles that meet it are read.
        """
        if self.map is None:
            outer, back = tuple(map(float, box)), None
        else:
            back = G.apply(G.invert(self.map), G.corners(box))
            outer = tuple(map(float, (back[:, 0].min(), back[:, 0].max(), back[:, 1].min(), back[:, 1].max())))
        out = self.table.crop(outer)
        if self.meta and self.meta.get("tiles") and "tile_index" in out.frame.columns:
            tiles = tiles_meeting([tuple(t) for t in self.meta["tiles"]], outer)
            if back is not None:
                shape = (G.POLYGON, [[back]])
                tiles = [t[0] for t in self.meta["tiles"] if t[0] in set(tiles) and G.relation((G.POLYGON, [[G.corners(tuple(t[1:]))]]), shape, "intersects")]
            out = replace(out, frame=out.frame.where(F.col("tile_index").isin(tiles)))
        if back is not None and np.abs(self.map[[0, 1], [1, 0]]).max() > np.sqrt(np.finfo(float).eps):
            out = out.then("turned crop", lambda d: d.where(half_planes(F.col("x_index"), F.col("y_index"), [tuple(map(float, c)) for c in back])))
        return replace(self, table=out)

    def window(self, box: tuple[float, float, float, float] | None) -> Spatial:
        """A crop that can be taken off again; of an unmapped geometry."""
        if self.map is not None and box:
            raise ValueError("a window goes before maps")
        return replace(self, table=self.table.window(box))

    def tile(self, index: int, pad: float = 0.0) -> Spatial:
        """Rows of one tile of the plan, widened by ``pad`` on all sides."""
        if not self.meta or not self.meta.get("tiles"):
            raise ValueError("no tiles are known")
        plan = [tuple(t) for t in self.meta["tiles"]]
        one = next(t for t in plan if t[0] == index)
        if pad:
            return self.crop((one[1] - pad, one[2] + pad, one[3] - pad, one[4] + pad))
        whole = (min(t[1] for t in plan), max(t[2] for t in plan), min(t[3] for t in plan), max(t[4] for t in plan))
        return replace(self, table=replace(self.table, frame=self.table.frame.where(F.col("tile_index") == index)) if "tile_index" in self.table.frame.columns else self.table.then("tile", lambda d: d.where(in_tile(one, whole))))

    def subset(self, where: str, **kw) -> Spatial:
        return replace(self, table=self.table.subset(where, **kw))

    # ---- relations to other shapes

    def relate(self, shapes: str | Sequence[str] | DataFrame | Spatial, relation: str = "intersects") -> Spatial:
        """Rows that stand in the relation to the union of WKT shapes (1000 at most), or to any row of another geometry."""
        if relation not in RELATIONS:
            raise ValueError(f"no such relation: {relation}")
        d = self.df(geometry=True)
        if isinstance(shapes, Spatial | DataFrame):
            return Spatial.of(related(d, shapes.df(geometry=True) if isinstance(shapes, Spatial) else shapes, relation))
        shapes = [shapes] if isinstance(shapes, str) else list(shapes)
        if not 0 < len(shapes) <= 1000:
            raise ValueError("from 1 to 1000 shapes")
        kinds = [G.read_wkt(s) for s in shapes]
        spots = {tuple(p[0][0]) for k, ps in kinds if k == G.POINT for p in ps}
        areas_ = [p for k, ps in kinds if k != G.POINT for p in ps]
        if spots and (areas_ or len(spots) > 1):
            raise ValueError("polygons, or one point")
        target = kinds[0] if spots else (G.MULTIPOLYGON, areas_)
        if relation in MONOTONE:
            d = meeting(d, np.vstack([r for p in target[1] for r in p]))

        @F.pandas_udf("boolean")
        def holds(g: pd.Series) -> pd.Series:
            return g.map(lambda b: b is not None and G.relation(G.read_wkb(b), target, relation))

        return Spatial.of(d.where(holds("geom")))

    # ---- rasters

    def rasterize(self, box: tuple[float, float, float, float], ncols: int, nrows: int, field: str | None = None, fun: str = "count") -> DataFrame:
        """(row, col, value) of the filled cells of a grid; bins are open to the right, row 1 is the top."""
        xres, yres = (box[1] - box[0]) / ncols, (box[3] - box[2]) / nrows
        x, y = F.col("x_index"), F.col("y_index")
        agg = {"count": F.count("*").cast("double"), "sum": F.sum(field or "x_index"), "mean": F.avg(field or "x_index"), "min": F.min(field or "x_index"), "max": F.max(field or "x_index")}[fun]
        return self.df().where((x >= box[0]) & (x < box[1]) & (y >= box[2]) & (y < box[3])).groupBy((nrows - F.floor((y - box[2]) / yres)).cast("int").alias("row"), (F.floor((x - box[0]) / xres) + 1).cast("int").alias("col")).agg(agg.alias("value"))


# ---- tiles


def tile_threshold(n: int, kind: str = "points") -> float:
    """Rows a tile may hold before it splits."""
    if kind == "points":
        return float("inf") if n < 1e6 else 1e6 if n < 1e9 else min(max(n / 1000, 1e6), 1e8)
    return 5e5 if n <= 5e8 else min(max(n / 1000, 5e5), 5e6)


def quadtree(df: DataFrame, threshold: float, box: tuple[float, float, float, float] | None = None, step: int = 4, deepest: int = 40, seed: tuple[int, int] = (1, 1)) -> list[tuple[int, float, float, float, float]]:
    """(tile, xmin, xmax, ymin, ymax): parts of the extent that hold ``threshold`` rows at most, from a grid of ``seed`` columns and rows on by quarters.

    Each pass counts the parts, ``step`` levels down, of those that are too full; the driver sees counts of filled parts of these only. Parts
    that hold one place over and over stay as they are at the ``deepest`` level.
    """
    if box is None:
        r = df.agg(F.min("x_index"), F.max("x_index"), F.min("y_index"), F.max("y_index")).first()
        box = tuple(r)
        if box[0] is None:
            return []
    rows = df.where(inside_box(F.col("x_index"), F.col("y_index"), box)).select("x_index", "y_index")
    nx, ny = seed

    def place(c: str, lo: float, hi: float, n: int) -> Column:
        return F.least(F.floor((F.col(c) - lo) / (hi - lo if hi > lo else 1.0) * n), F.lit(n - 1)).cast("long")

    def counted(level: int, only: list[tuple[int, int]] | None) -> dict[tuple[int, int], int]:
        at = rows.select(place("x_index", box[0], box[1], nx << level).alias("i"), place("y_index", box[2], box[3], ny << level).alias("j"))
        if only is not None:
            own = df.sparkSession.createDataFrame(only, "pi long, pj long")
            at = at.withColumns({"pi": F.shiftright("i", step), "pj": F.shiftright("j", step)}).join(small(own, len(only)), ["pi", "pj"], "left_semi")
        return {(r.i, r.j): r["count"] for r in at.groupBy("i", "j").count().collect()}

    leaves, level = [], 0
    full = []
    counts = counted(0, None) if threshold < float("inf") else {}
    for i in range(nx):
        for j in range(ny):
            (full if counts.get((i, j), 0) > threshold else leaves).append((0, i, j))
    while full and level < deepest:
        below = counted(level + step, [(i, j) for _, i, j in full])
        sums = [below]
        for _ in range(step):
            up: dict[tuple[int, int], int] = {}
            for (i, j), c in sums[-1].items():
                up[i >> 1, j >> 1] = up.get((i >> 1, j >> 1), 0) + c
            sums.append(up)
        todo, full = full, []
        while todo:
            at, i, j = todo.pop()
            if sums[level + step - at].get((i, j), 0) <= threshold:
                leaves.append((at, i, j))
            elif at == level + step:
                full.append((at, i, j))
            else:
                todo += [(at + 1, 2 * i + a, 2 * j + b) for a in (0, 1) for b in (0, 1)]
        level += step
    leaves += full

    def turn(leaf: tuple[int, int, int]) -> tuple:
        at, i, j = leaf
        low = [(i >> (at - k) & 1, j >> (at - k) & 1) for k in range(1, at + 1)]
        return (i >> at, j >> at, low)

    out = []
    for n, (at, i, j) in enumerate(sorted(leaves, key=turn)):
        w, h = (box[1] - box[0]) / (nx << at), (box[3] - box[2]) / (ny << at)
        edge = lambda k, lo, hi, size, n: hi if k == n else lo + k * size
        out.append((n, edge(i, box[0], box[1], w, nx << at), edge(i + 1, box[0], box[1], w, nx << at), edge(j, box[2], box[3], h, ny << at), edge(j + 1, box[2], box[3], h, ny << at)))
    return out


def seed_grid(box: tuple[float, float, float, float]) -> tuple[int, int]:
    """Columns and rows of the first tiles: round(long side / short side) * 4 of them, four along the short side's direction shared out so that they are nearly square."""
    w, h = max(box[1] - box[0], 1e-300), max(box[3] - box[2], 1e-300)
    ratio = max(round(max(w, h) / min(w, h)), 1)
    return (2 * ratio, 2) if w >= h else (2, 2 * ratio)


def in_tile(tile: tuple[int, float, float, float, float], whole: tuple[float, float, float, float]) -> Column:
    """Left and top edges belong to the tile, right and bottom ones only on the border of the whole."""
    _, x0, x1, y0, y1 = tile
    return inside_box(F.col("x_index"), F.col("y_index"), (x0, x1, y0, y1), (y0 <= whole[2], True, True, x1 >= whole[1]))


def tiled(df: DataFrame, plan: Sequence[tuple[int, float, float, float, float]], few: int = 64) -> DataFrame:
    """Adds tile_index. Few tiles are tested in place; more meet the rows by an equi-join on cells of the tiles' sizes, the same test after it."""
    whole = (min(t[1] for t in plan), max(t[2] for t in plan), min(t[3] for t in plan), max(t[4] for t in plan))
    if len(plan) <= few:
        out = None
        for t in plan:
            hit = in_tile(t, whole)
            out = F.when(hit, F.lit(t[0])) if out is None else out.when(hit, F.lit(t[0]))
        return df.withColumn("tile_index", out.cast("int"))
    spark = df.sparkSession
    tiles = spark.createDataFrame([(t[0], *map(float, t[1:]), t[3] <= whole[2], t[2] >= whole[1]) for t in plan], "t int, xmin double, xmax double, ymin double, ymax double, bottom boolean, right boolean")
    cells, levels = levels_of(tiles)
    cells = in_cells(cells)
    width = F.pow(F.lit(2.0), F.col("level"))
    x, y = F.col("x_index"), F.col("y_index")
    key = "__row"
    own = written(df.drop("tile_index").withColumn(key, F.monotonically_increasing_id()))
    spread = own.select(key, "x_index", "y_index", F.explode(F.array(*map(F.lit, levels))).alias("level")).withColumns({"cx": F.floor(x / width), "cy": F.floor(y / width)})
    inside = (x >= F.col("xmin")) & ((x < F.col("xmax")) | (F.col("right") & (x == F.col("xmax")))) & ((y > F.col("ymin")) | (F.col("bottom") & (y == F.col("ymin")))) & (y <= F.col("ymax"))
    hit = spread.join(small(cells, 4 * len(plan)), ["level", "cx", "cy"]).where(inside).groupBy(key).agg(F.min("t").alias("tile_index"))
    return own.join(hit, key, "left").drop(key)


def tile_apply(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return df.groupBy("tile_index").applyInPandas(fn, schema)


# ---- spatial joins


def meeting(df: DataFrame, xy: np.ndarray) -> DataFrame:
    """Rows whose box (or place) meets the box around given places; rows of unmapped polygons only, as their boxes move with a map."""
    box = tuple(map(float, (xy[:, 0].min(), xy[:, 0].max(), xy[:, 1].min(), xy[:, 1].max())))
    if "xmin" not in df.columns:
        return df.where(inside_box(F.col("x_index"), F.col("y_index"), box)) if "poly_ID" not in df.columns else df
    return df.where((F.col("xmax") >= box[0]) & (F.col("xmin") <= box[1]) & (F.col("ymax") >= box[2]) & (F.col("ymin") <= box[3]))


def boxed(df: DataFrame) -> DataFrame:
    """With xmin, xmax, ymin, ymax, from the geometry where they are not there."""
    return df if "xmin" in df.columns else with_boxes(df)


def levels_of(df: DataFrame) -> tuple[DataFrame, list[int]]:
    """Adds the level of each box, the power of two that suits its size, and gives the levels that occur (few: powers between the smallest and the largest)."""
    size = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), F.lit(1e-9))
    df = df.withColumn("level", F.ceil(F.log2(size)).cast("int"))
    return df, sorted(r.level for r in df.select("level").distinct().collect())


def in_cells(df: DataFrame) -> DataFrame:
    """A row for each cell (cx, cy) of its level that a box touches: four at most where the level suits its size."""
    width = F.pow(F.lit(2.0), F.col("level"))
    cell = lambda c: F.floor(F.col(c) / width)
    out = df.withColumn("cx", F.explode(F.sequence(cell("xmin"), cell("xmax"))))
    return out.withColumn("cy", F.explode(F.sequence(cell("ymin"), cell("ymax"))))


def related(x: DataFrame, y: DataFrame, relation: str) -> DataFrame:
    """Rows of ``x`` that stand in the relation to any row of ``y``; both have geom.

    Boxes meet by an equi-join on cells of the larger one's level, then the exact test; each pair is tested in one cell.
    Disjoint from any: not meeting all of them.
    """
    x = written(x.withColumn("__key", F.monotonically_increasing_id()))
    shape = lambda d, s: boxed(d.where("geom is not null")).select(*(F.col(c).alias(s + c) for c in ("__key", "geom") if c in d.columns or c == "geom"), "xmin", "xmax", "ymin", "ymax")
    a, la = levels_of(shape(x, "a"))
    b, lb = levels_of(shape(y, "b"))
    every = sorted({*la, *lb})
    up = lambda d, s: in_cells(d.withColumnRenamed("level", s + "own").withColumn("level", F.explode(F.filter(F.array(*map(F.lit, every)), lambda v: v >= F.col(s + "own"))))).withColumnsRenamed({c: s + c for c in ("xmin", "xmax", "ymin", "ymax")})
    if not la or not lb:
        return x.drop("__key") if relation == "disjoint" and lb else x.drop("__key").limit(0)
    pairs = up(a, "a").join(up(b, "b"), ["level", "cx", "cy"]).where("level = greatest(aown, bown) and axmin <= bxmax and axmax >= bxmin and aymin <= bymax and aymax >= bymin")
    width = F.pow(F.lit(2.0), F.col("level"))
    pairs = pairs.where((F.col("cx") == F.floor(F.greatest("axmin", "bxmin") / width)) & (F.col("cy") == F.floor(F.greatest("aymin", "bymin") / width)))  # the first cell that both touch
    test = "intersects" if relation == "disjoint" else relation

    @F.pandas_udf("boolean")
    def holds(g: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([G.relation(G.read_wkb(p), G.read_wkb(q), test) for p, q in zip(g, h, strict=True)], dtype=bool)

    found = pairs.where(holds("ageom", "bgeom")).select(F.col("a__key").alias("__key"))
    if relation == "disjoint":
        n = y.where("geom is not null").count()
        full = found.groupBy("__key").count().where(F.col("count") == n).select("__key")
        return x.where("geom is not null").join(full, "__key", "left_anti").drop("__key")
    return x.join(found.distinct(), "__key", "left_semi").drop("__key")


def overlap(polys: DataFrame, pts: DataFrame, keep: Sequence[str] = (), poly_id: str = "poly_ID", feat_id: str = "feat_ID") -> DataFrame:
    """(poly_ID, feat_ID, *keep[, count][, pt_tile_index][, pt_row_index]): points in or on polygons.

    ``count`` rides along where the points carry it, and so do their own keys tile_index and row_index (int). Both sides go into square cells
    and meet by an equi-join on the cell, then by box, then exactly. A polygon takes the level of the cell sizes
    (powers of two) that suits its own size, so it lies in four cells at most; a point stands in one cell of each level that occurs.
    """
    boxes, levels = levels_of(boxed(polys))
    keep = [*keep, *(c for c in ("count",) if c in pts.columns and c not in (*keep, feat_id))]
    keys = [F.col(c).cast("int").alias(f"pt_{c}") for c in ("tile_index", "row_index") if c in pts.columns]
    names = ["poly_ID", "feat_ID", *keep, *(f"pt_{c}" for c in ("tile_index", "row_index") if c in pts.columns)]
    own = pts.select(F.col(feat_id).alias("feat_ID"), "x_index", "y_index", *keep, *keys)
    if not levels:
        return own.withColumn("poly_ID", F.lit(None).cast(polys.schema[poly_id].dataType)).select(*names).limit(0)
    left = in_cells(edges_of(boxes).select(F.col(poly_id).alias("poly_ID"), "xmin", "xmax", "ymin", "ymax", "edges", "level"))
    width = F.pow(F.lit(2.0), F.col("level"))
    right = own.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumns({"cx": F.floor(F.col("x_index") / width), "cy": F.floor(F.col("y_index") / width)})
    x, y = F.col("x_index"), F.col("y_index")
    near = left.join(right, ["level", "cx", "cy"]).where((x >= F.col("xmin")) & (x <= F.col("xmax")) & (y >= F.col("ymin")) & (y <= F.col("ymax")))
    cross = lambda e: (e["x1"] - e["x0"]) * (y - e["y0"]) - (e["y1"] - e["y0"]) * (x - e["x0"])
    on = F.exists("edges", lambda e: (cross(e) == 0) & x.between(F.least(e["x0"], e["x1"]), F.greatest(e["x0"], e["x1"])) & y.between(F.least(e["y0"], e["y1"]), F.greatest(e["y0"], e["y1"])))
    odd = F.size(F.filter("edges", lambda e: ((e["y0"] > y) != (e["y1"] > y)) & ((cross(e) > 0) == (e["y1"] > e["y0"])))) % 2 == 1
    return near.where(odd | on).select(*names)


def with_boxes(polys: DataFrame) -> DataFrame:
    @F.pandas_udf("struct<xmin double, xmax double, ymin double, ymax double>")
    def box(g: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([centre_and_box(G.read_wkb(b)[1])[2:] for b in g], columns=["xmin", "xmax", "ymin", "ymax"])

    return polys.withColumn("__b", box("geom")).select(*polys.columns, "__b.*")


def edges_of(polys: DataFrame) -> DataFrame:
    """Adds ``edges``: the edges around the union of its parts as structs, once for each polygon."""
    kind = "array<struct<x0 double, y0 double, x1 double, y1 double>>"

    @F.pandas_udf(kind)
    def edges(g: pd.Series) -> pd.Series:
        return g.map(lambda b: [dict(zip(("x0", "y0", "x1", "y1"), map(float, s), strict=True)) for s in G.border(G.read_wkb(b)[1])])

    return polys.withColumn("edges", edges("geom"))


def overlap_matrix(found: DataFrame, cells: DataFrame, feats: DataFrame, count_col: str | bool | None = None) -> Matrix:
    """Counts by polygon and feature as a matrix over the given ids (cell_id), (feat_id); ids outside drop, ids without rows stay.

    Sums of ``count_col`` where it is given, or of a column ``count`` where there is one, unless False is passed. Row and
    column ids are the ranks of the names in natural order of digits.
    """
    if count_col is None and "count" in found.columns:
        count_col = "count"

    def ranked(d: DataFrame, name: str, key: str) -> DataFrame:
        natural = F.regexp_replace(F.col(name).cast("string"), r"(\d+)", r"0000000000000000000$1")
        natural = F.regexp_replace(natural, r"0*(\d{19})(?!\d)", "$1")
        own = d.select(name).distinct().withColumn("__n", natural)
        return with_row_index(own, ["__n", name], name=key).select(name, key)

    c, f = ranked(cells, "cell_id", "row_id"), ranked(feats, "feat_id", "col_id")
    t = found.join(c, found["poly_ID"] == c["cell_id"]).join(f, found["feat_ID"] == f["feat_id"])
    t = t.groupBy("row_id", "col_id").agg((F.sum(count_col) if count_col else F.count("*")).cast("double").alias("value"))
    return Matrix(t, c, f, t)


def bin_overlap(found: DataFrame, bins: Matrix) -> DataFrame:
    """(poly_ID, feat_id, value): bins found in polygons (feat_ID is the bin) replaced by what they hold."""
    inside = found.select("poly_ID", F.col("feat_ID").alias("bin_id"))  # feat_ID and feat_id are one name to Spark
    return inside.join(bins.named().withColumnRenamed("cell_id", "bin_id"), "bin_id").groupBy("poly_ID", "feat_id").agg(F.sum("value").alias("value"))


def label_proportions(polys: DataFrame, pts: DataFrame, label_col: str, poly_id: str = "poly_ID", feat_id: str = "feat_ID") -> DataFrame:
    """(poly_ID, label, prop): shares of the labels among the points in or on each polygon (extension); polygons without points have no rows."""
    found = overlap(polys, pts.withColumn("__label", F.col(label_col).cast("string")).drop("count", "tile_index", "row_index"), ["__label"], poly_id, feat_id)
    n = found.groupBy("poly_ID", F.col("__label").alias("label")).agg(F.count("*").alias("n"))
    total = n.groupBy("poly_ID").agg(F.sum("n").alias("all"))
    return n.join(total, "poly_ID").select("poly_ID", "label", (F.col("n") / F.col("all")).alias("prop"))


def bin_points(m: Matrix, places: DataFrame) -> DataFrame:
    """Point geometry of the cells of a matrix that hold counts: (feat_ID: the cell's row id, x_index, y_index, geom) from (cell_id or row_id, x, y)."""
    at = places if "row_id" in places.columns else places.join(m.cells.select("cell_id", "row_id"), "cell_id")
    at = at.where("row_id is not null").join(m.triplets.select("row_id").distinct(), "row_id", "left_semi")
    return points(at.select(F.col("row_id").alias("feat_ID"), "x", "y"))


def parent_bins(df: DataFrame, size: int, x: str = "x", y: str = "y") -> DataFrame:
    """Adds the corner of the larger bin that a place lies in."""
    floor = lambda c: (F.floor(F.col(c) / size) * size).cast("long")
    return df.withColumns({"parent_x": floor(x), "parent_y": floor(y)})

