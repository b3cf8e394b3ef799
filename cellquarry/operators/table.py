"""Tables: lazy, immutable handles whose verbs become one DataFrame plan."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellquarry.plans.rules import inside_box, intersect_boxes, keep_ids

#: Columns that identify rows and stay out of what a user collects.
SPECIAL = ("row_index", "source_id", "tile_index")
SPATIAL = ("x_index", "y_index", "geom")


@dataclass(frozen=True)
class Table:
    """Rows with an intrinsic order (``index`` column, if there is one) and a queue of verbs.

    A crop and a window belong to the scan: they apply to the rows of ``frame`` before any verb, wherever in the chain they were made.
    """

    frame: DataFrame
    index: str = "row_index"
    log: tuple[str, ...] = field(default=())
    box: tuple | None = None  # a crop: stays
    view: tuple | None = None  # a window within the crop: can be taken off
    ops: tuple[Callable[[DataFrame], DataFrame], ...] = field(default=())

    @classmethod
    def read(cls, spark: SparkSession, path: str, fmt: str = "parquet", index: str = "row_index", schema: str | None = None, reader: Callable[[SparkSession, str], DataFrame] | None = None, types: Mapping[str, str] | None = None, **options: str) -> Table:
        """A file or folder in any format Spark reads, or through ``reader``; ``types`` casts columns on opening."""
        if reader:
            df = reader(spark, path)
        else:
            r = spark.read.format(fmt).options(**options)
            df = (r.schema(schema) if schema else r).load(path)
        return cls(reduce(lambda d, c: d.withColumn(c, F.col(c).cast(types[c])), types or {}, df), index)

    def then(self, verb: str, op: Callable[[DataFrame], DataFrame]) -> Table:
        return replace(self, ops=(*self.ops, op), log=(*self.log, verb))

    # ---- shape

    @cached_property
    def _plan(self) -> DataFrame:
        own = self.view or self.box
        base = self.frame.where(inside_box(F.col("x_index"), F.col("y_index"), own)) if own else self.frame
        return reduce(lambda d, op: op(d), self.ops, base)

    def df(self) -> DataFrame:
        """The whole plan, special columns included."""
        return self._plan

    def columns(self) -> list[str]:
        return visible(self.df())

    def collect(self, omit_internals: bool = True) -> pd.DataFrame:
        """Rows in order of source, tile and index."""
        df = self.df()
        order = [c for c in ("source_id", "tile_index", self.index) if c in df.columns]
        df = df.orderBy(*order) if order else df
        return (df.drop(*SPECIAL) if omit_internals else df).toPandas()

    def values(self) -> list:
        """The only visible column."""
        if len(self.columns()) != 1:
            raise ValueError("values() needs exactly one column")
        return self.collect()[self.columns()[0]].tolist()

    def nrow(self) -> float:
        return float(self.df().count())

    def arrow(self):
        return self.df().toArrow()

    # ---- verbs

    def subset(self, where: str | Column | None = None, select: Sequence[str] | None = None, negate: bool = False, **values) -> Table:
        """Rows for which ``where`` holds (with ``negate``: does not); null conditions drop rows either way. ``:name`` in SQL stands for a keyword value."""
        out = self
        if where is not None:
            out = out.then("subset", lambda d: _where(d, where, negate, values))
        return out.select(*select) if select is not None else out

    def select(self, *cols: str | int | bool) -> Table:
        """Columns by name, position or flags; special ones stay along."""
        own, all_ = self.columns(), self.df().columns
        if cols and all(isinstance(c, bool) for c in cols):
            names = [c for c, f in zip(own, cols, strict=True) if f]
        else:
            names = [own[c] if isinstance(c, int) else c for c in cols]
        if missing := [c for c in names if c not in all_]:
            raise KeyError(f"no such columns: {missing}")
        hidden = [c for c in (*SPECIAL, *SPATIAL) if c in all_ and c not in names]
        if self.index in all_ and self.index not in (*names, *hidden):
            hidden.append(self.index)
        return self.then("select", lambda d: d.select(*names, *hidden))

    def unique(self) -> Table:
        """Distinct visible columns; rows lose their index."""
        return self.then("unique", lambda d: d.select(*(c for c in visible(d) if c != self.index)).distinct())

    def _first(self, d: DataFrame, n: int, falling: bool) -> DataFrame:
        order = [c for c in ("source_id", "tile_index", self.index) if c in d.columns]
        return (d.orderBy(*(F.col(c).desc() if falling else F.col(c) for c in order)) if order else d).limit(n)

    def head(self, n: int = 6) -> Table:
        return self.then("head", lambda d: self._first(d, n, False))

    def tail(self, n: int = 6) -> Table:
        return self.then("tail", lambda d: self._first(d, n, True))

    def row_sample(self, size: int) -> Table:
        """Every k-th row by index, k = ceil(n / size): systematic, so about ``size`` rows; all if there are no more."""

        def sample(d: DataFrame) -> DataFrame:
            n = d.count()
            return d if n <= size else d.where((F.col(self.index) - 1) % -(-n // size) == 0)

        return self.then("row_sample", sample)

    def join(self, other: Table | DataFrame, on: str | Sequence[str] | Mapping[str, str], inner: bool = False) -> Table:
        """Left (or inner) equi-join; ``on`` names columns of both or maps own names to the other's. The other's special columns stay out; a name that clashes gets _y (_y2, _y3 ..)."""
        y = other.df() if isinstance(other, Table) else other
        keys = {on: on} if isinstance(on, str) else dict(on) if isinstance(on, Mapping) else {k: k for k in on}

        def joined(d: DataFrame) -> DataFrame:
            z = y.drop(*(c for c in (*SPECIAL, *SPATIAL) if c not in keys.values()))
            rest = [c for c in z.columns if c not in keys.values()]
            names, taken = {}, {c.lower() for c in (*d.columns, *rest)}
            for c in rest:
                if c.lower() in {x.lower() for x in d.columns}:
                    names[c] = next(n for n in (f"{c}_y", *(f"{c}_y{i}" for i in range(2, len(taken) + 3))) if n.lower() not in taken)
                    taken.add(names[c].lower())
            z = z.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(keys.values())), *(F.col(c).alias(names.get(c, c)) for c in rest))
            return d.join(z, [d[k] == z[f"__{i}"] for i, k in enumerate(keys)], "inner" if inner else "left").drop(*(f"__{i}" for i in range(len(keys))))

        return self.then("join", joined)

    def keep(self, col: str, ids: Sequence | DataFrame, negate: bool = False) -> Table:
        return self.then("keep", lambda d: keep_ids(d, col, ids, negate))

    def ids(self, col: str) -> DataFrame:
        return self.df().select(col).distinct()

    def crop(self, box: tuple[float, float, float, float]) -> Table:
        """Rows whose centroid lies in the box, borders included; crops narrow each other, and an open window them."""
        return replace(self, box=intersect_boxes(self.view or self.box, box), log=(*self.log, "crop"))

    def window(self, box: tuple[float, float, float, float] | None) -> Table:
        """A crop within the crop that can be taken off again (None)."""
        return replace(self, view=intersect_boxes(self.box, box) if box else None)

    def bounded(self, box: tuple[float, float, float, float], inclusive: Sequence[bool] = (True, True, True, True), x: str = "x_index", y: str = "y_index", group: str | None = None) -> Table:
        """Rows inside a box, each edge inclusive or not; with ``group`` whole groups by the middle of their envelope."""
        if group is None:
            return self.then("bounded", lambda d: d.where(inside_box(F.col(x), F.col(y), box, inclusive)))

        def whole(d: DataFrame) -> DataFrame:
            mid = d.groupBy(group).agg(((F.min(x) + F.max(x)) / 2).alias("__x"), ((F.min(y) + F.max(y)) / 2).alias("__y"))
            return keep_ids(d, group, mid.where(inside_box(F.col("__x"), F.col("__y"), box, inclusive)).select(group))

        return self.then("bounded", whole)

    def callback(self, fn: Callable[[DataFrame], DataFrame]) -> Table:
        return self.then("callback", lambda d: d.transform(fn))


def visible(df: DataFrame) -> list[str]:
    """Columns without those that only identify or place rows."""
    return [c for c in df.columns if c not in (*SPECIAL, *SPATIAL)]


def _where(df: DataFrame, where: str | Column, negate: bool, values: Mapping) -> DataFrame:
    """Rows by a condition; values are bound as parameters, so their text never becomes SQL."""
    if not isinstance(where, str) or not values:
        cond = F.expr(where) if isinstance(where, str) else where
        return df.where(~cond if negate else cond)
    plain = {k: v.item() if hasattr(v, "item") else v for k, v in values.items()}
    name = f"rows_{uuid.uuid4().hex}"
    df.createTempView(name)
    try:
        return df.sparkSession.sql(f"SELECT * FROM {name} WHERE {'NOT ' if negate else ''}({where})", args=plain)
    finally:
        df.sparkSession.catalog.dropTempView(name)


def bind_rows(tables: Sequence[Table], names: Sequence[str] | None = None) -> Table:
    """All rows of all tables as their verbs leave them; crops applied; missing columns are null; ``source_id`` tells them apart."""
    names = names or [str(i + 1) for i in range(len(tables))]
    if len(set(names)) != len(names):
        raise ValueError("sources need names of their own")
    frames = [t.df() if "source_id" in t.df().columns else t.df().withColumn("source_id", F.lit(n)) for t, n in zip(tables, names, strict=True)]
    return Table(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), tables[0].index)
