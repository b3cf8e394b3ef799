"""Cell x feature matrices as triplets: lazy views, value transforms and one shared accumulator."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellquarry.plans.indexing import with_row_index
from cellquarry.plans.rules import INLINE_IDS, axis_predicate, counted, keep_ids
from cellquarry.plans.store import written


@dataclass(frozen=True)
class Matrix:
    """``triplets`` (row_id: cell, col_id: feature, value), ``cells`` (row_id, cell_id) and ``feats`` (col_id, feat_id).

    A missing triplet is 0. ``raw`` has the values before any transform. Cells of several sources are
    keyed by ids that do not clash.
    """

    triplets: DataFrame
    cells: DataFrame
    feats: DataFrame
    raw: DataFrame | None = None
    transposed: bool = False
    log_: tuple[str, ...] = ()
    parts: int | None = None  # of stored triplets: how many partitions give each a bounded number

    @classmethod
    def of(cls, triplets: DataFrame, cells: DataFrame | None = None, feats: DataFrame | None = None) -> Matrix:
        """Duplicate triplets are summed. Dimensions default to the ids that occur."""
        t = triplets.groupBy("row_id", "col_id").agg(F.sum("value").cast("double").alias("value"))
        cells = cells if cells is not None else t.select("row_id").distinct().withColumn("cell_id", F.col("row_id").cast("string"))
        feats = feats if feats is not None else t.select("col_id").distinct().withColumn("feat_id", F.col("col_id").cast("string"))
        return cls(t, cells, feats, t)

    def _by_cell(self, t: DataFrame) -> DataFrame:
        """Triplets dealt by cell to partitions of bounded size, where their number is known, so that a task does not grow with the table."""
        return t.repartition(self.parts, "row_id") if self.parts else t

    def _map(self, verb: str, df: DataFrame) -> Matrix:
        return replace(self, triplets=df, log_=(*self.log_, verb))

    # ---- views

    def t(self) -> Matrix:
        return replace(self, transposed=not self.transposed)

    def dim(self) -> tuple[int, int]:
        c, f = self.cells.count(), self.feats.count()
        return (c, f) if self.transposed else (f, c)

    def subset(self, cells: Sequence | DataFrame | None = None, feats: Sequence | DataFrame | None = None, negate: bool = False) -> Matrix:
        """A narrower view by cell and feature names; queued transforms keep what they froze."""
        out = self
        for names, dim, key, name in ((cells, "cells", "row_id", "cell_id"), (feats, "feats", "col_id", "feat_id")):
            if names is None:
                continue
            own = keep_ids(getattr(out, dim), name, names, negate)
            if not isinstance(names, DataFrame) and not negate and own.count() < len(set(names)):
                raise KeyError(f"unknown {name}")
            ids = own.select(key)
            out = replace(out, **{dim: own, "triplets": keep_ids(out.triplets, key, ids), "raw": keep_ids(out.raw, key, ids)})
        return out

    def at(self, rows: Sequence[int] | None = None, cols: Sequence[int] | None = None) -> Matrix:
        """A narrower view by ids. Ranges and short lists become predicates that prune the row groups of stored triplets (sorted by row); longer lists with gaps a join within their range."""
        out = self
        for ids, dim, key in ((rows, "cells", "row_id"), (cols, "feats", "col_id")):
            if ids is None:
                continue
            own = getattr(out, dim)
            short = axis_predicate(key, ids, own.count())
            if short is None:
                continue
            gaps = max(ids, default=0) - min(ids, default=0) + 1 - len(set(ids))
            if len(set(ids)) > INLINE_IDS and gaps > INLINE_IDS:
                cut = lambda d, key=key, ids=ids: keep_ids(d.where(F.col(key).between(min(ids), max(ids))), key, list(ids))
            else:
                cut = lambda d, short=short: d.where(short)
            out = replace(out, **{dim: cut(own), "triplets": cut(out.triplets), "raw": cut(out.raw)})
        return out

    def rename(self, cells: DataFrame | None = None, feats: DataFrame | None = None) -> Matrix:
        """Other names: (row_id, cell_id) or (col_id, feat_id), exactly one for each id."""
        out = self
        for names, dim, key, name in ((cells, "cells", "row_id", "cell_id"), (feats, "feats", "col_id", "feat_id")):
            if names is None:
                continue
            own = getattr(self, dim).select(key)
            n, new = own.count(), own.join(names.select(key, name), key)
            if new.count() != n or new.where(F.col(name).isNotNull()).select(key).distinct().count() != n:
                raise ValueError(f"every {key} needs one {name}")
            out = replace(out, **{dim: new})
        return out

    @staticmethod
    def bind_cells(parts: Sequence[Matrix]) -> Matrix:
        """Matrices with the same features and different cells, side by side; where their row ids clash, those of later parts are shifted beyond the ones before."""
        if any(p.log_ or p.transposed for p in parts):
            raise ValueError("bind before transforms and transposition")
        union = lambda what, own: reduce(lambda a, b: a.unionByName(b), (getattr(p, what) for p in own))
        repeats = lambda d, c: d.groupBy(c).agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
        cells = union("cells", parts)
        if repeats(cells, "cell_id"):
            raise ValueError("cells repeat")
        first = parts[0].feats
        for p in parts[1:]:
            if first.exceptAll(p.feats).limit(1).count() or p.feats.exceptAll(first).limit(1).count():
                raise ValueError("features differ")
        if repeats(cells, "row_id"):
            shifted, before = [], 0
            for p in parts:
                up = lambda d, n=before: d.withColumn("row_id", F.col("row_id") + n)
                shifted.append(Matrix(up(p.triplets), up(p.cells), p.feats, up(p.raw)))
                before += (p.cells.agg(F.max("row_id").alias("n")).first()["n"] or 0) + 1
            parts, cells = shifted, union("cells", shifted)
        return Matrix(union("triplets", parts), cells, first, union("raw", parts))

    def named(self) -> DataFrame:
        """(cell_id, feat_id, value) of the stored entries."""
        return self.triplets.join(self.cells, "row_id").join(self.feats, "col_id").select("cell_id", "feat_id", "value")

    def dense(self, most: int = 100) -> tuple[np.ndarray, list[str], list[str]]:
        """(features x cells array, feature names, cell names) on the driver; one side must be short."""
        nf, nc = self.feats.count(), self.cells.count()
        if min(nf, nc) > most:
            raise ValueError(f"one side must have {most} entries at most")
        f, c = (sorted(d.toPandas().values.tolist()) for d in (self.feats.select("col_id", "feat_id"), self.cells.select("row_id", "cell_id")))
        fi, ci = {x[0]: i for i, x in enumerate(f)}, {x[0]: i for i, x in enumerate(c)}
        out = np.zeros((len(f), len(c)))
        for r in self.triplets.toLocalIterator():
            out[fi[r.col_id], ci[r.row_id]] = r.value
        return (out.T if self.transposed else out), [x[1] for x in f], [x[1] for x in c]

    def csr(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], list[str]]:
        """(indptr, indices, data, cell names, feature names) on the driver, cells as rows, ids in order: for views that fit there."""
        c, f = (d.orderBy(k).toPandas() for d, k in ((self.cells.select("row_id", "cell_id"), "row_id"), (self.feats.select("col_id", "feat_id"), "col_id")))
        t = self.triplets.select("row_id", "col_id", "value").toPandas()
        rows, cols = np.searchsorted(c["row_id"], t["row_id"]), np.searchsorted(f["col_id"], t["col_id"])
        order = np.lexsort((cols, rows))
        at = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(c)))])
        return at, cols[order], t["value"].to_numpy(float)[order], c["cell_id"].tolist(), f["feat_id"].tolist()

    @classmethod
    def from_array(cls, spark: SparkSession, x: np.ndarray, feats: Sequence[str], cells: Sequence[str]) -> Matrix:
        """A features x cells array on the driver, with names."""
        if x.shape != (len(feats), len(cells)):
            raise ValueError("names and array differ in size")
        f, c = np.nonzero(x)
        t = spark.createDataFrame(pd.DataFrame({"row_id": c + 1, "col_id": f + 1, "value": x[f, c].astype(float)}), "row_id long, col_id long, value double")
        dim = lambda names, key, name: spark.createDataFrame([(i + 1, str(n)) for i, n in enumerate(names)], f"{key} long, {name} string")
        return cls(t, dim(cells, "row_id", "cell_id"), dim(feats, "col_id", "feat_id"), t)

    def wide(self, feats: Sequence[str]) -> DataFrame:
        """Few features as columns, every cell a row, zeros filled in."""
        own = self.subset(feats=list(feats)).named().groupBy("cell_id").pivot("feat_id", list(feats)).agg(F.sum("value"))
        return self.cells.select("cell_id").join(own, "cell_id", "left").na.fill(0.0, list(feats))

    # ---- value transforms

    def multiply(self, weights: float | DataFrame, axis: str = "cell") -> Matrix:
        """By a number, or by (row_id or col_id, w); a key without weight gives null."""
        if not isinstance(weights, DataFrame):
            return self._map("multiply", self.triplets.withColumn("value", F.col("value") * float(weights)))
        key = "row_id" if axis == "cell" else "col_id"
        w = weights.select(key, F.col("w").alias("__w"))
        return self._map("multiply", self.triplets.join(w, key, "left").select("row_id", "col_id", (F.col("value") * F.col("__w")).alias("value")))

    def log(self, base: float = 2.0) -> Matrix:
        return self._map("log", self.triplets.withColumn("value", F.log1p("value") / log(base)))

    def expm1(self, base: float = 2.0) -> Matrix:
        return self._map("expm1", self.triplets.withColumn("value", F.pow(F.lit(float(base)), F.col("value")) - 1))

    def clamp(self, low: float, high: float) -> Matrix:
        if low > 0:
            raise ValueError("a lower bound above 0 would fill the matrix")
        return self._map("clamp", self.triplets.withColumn("value", F.least(F.greatest("value", F.lit(float(low))), F.lit(float(high)))))

    def add(self, *_: object) -> Matrix:
        raise ValueError("adding would fill the matrix")

    def compare(self, op: str, threshold: float | DataFrame, axis: str = "feat") -> Matrix:
        """Entries that pass become 1, the others go. A threshold that 0 passes is refused; thresholds by key are (row_id or col_id, w), keys without one drop."""
        tests = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}
        if not isinstance(threshold, DataFrame):
            if bool(tests[op](0.0, float(threshold))):
                raise ValueError("0 passes: the result would be dense")
            t = self.triplets.where(tests[op](F.col("value"), F.lit(float(threshold))))
        else:
            key = "row_id" if axis == "cell" else "col_id"
            t = self.triplets.join(threshold.select(key, F.col("w").alias("__w")), key).where(tests[op](F.col("value"), F.col("__w")) & ~tests[op](F.lit(0.0), F.col("__w")))
        return self._map("compare", t.select("row_id", "col_id", F.lit(1.0).alias("value")))

    def library_norm(self, scale: float = 6000.0) -> Matrix:
        """Every cell's values times scale / its sum; a sum of 0 counts as 1. The sums are those of the view now, later subsets keep them."""
        own = replace(self, triplets=self._by_cell(self.triplets))
        s = own.triplets.groupBy("row_id").agg(F.sum("value").alias("s"))
        return own.multiply(s.select("row_id", (F.lit(float(scale)) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("w")))._relog("library_norm")

    def _relog(self, verb: str) -> Matrix:
        return replace(self, log_=(*self.log_[:-1], verb))

    def log_norm(self, base: float = 2.0, offset: float = 1.0) -> Matrix:
        if offset != 1:
            raise ValueError("only an offset of 1 keeps zeros")
        return self.log(base)

    # ---- the accumulator

    def accumulate(self, axis: str, stats: Sequence[str], threshold: float = 0.0, inclusive: bool = False, groups: DataFrame | None = None, weights: DataFrame | None = None, dense: bool = True, labels: DataFrame | None = None) -> DataFrame:
        """Sums over stored entries by feature or cell, and by label with ``groups`` (cell_id, label; cells without one drop out).

        ``stats``: sum, sumsq, sum3, sum4, nnz, sum_det, max, wsum (with ``weights``: row_id, w). The threshold
        concerns nnz and sum_det only. ``dense``: every id of the axis (times every label) has a row; ``labels`` has these, where they are known.
        """
        key, dim, name = ("col_id", self.feats, "feat_id") if axis == "feat" else ("row_id", self.cells, "cell_id")
        v = F.col("value")
        seen = v >= threshold if inclusive else v > threshold
        made = {"sum": F.sum(v), "sumsq": F.sum(v * v), "sum3": F.sum(v * v * v), "sum4": F.sum(v * v * v * v), "nnz": F.sum(seen.cast("double")), "sum_det": F.sum(F.when(seen, v).otherwise(0.0)), "max": F.max(v), "wsum": F.sum(v * F.col("w")) if weights is not None else None}
        t, keys = self._by_cell(self.triplets) if axis == "cell" or groups is not None else self.triplets, [key]
        if weights is not None:
            t = t.join(weights.select("row_id", "w"), "row_id")
        if groups is not None:
            by = self.cells.join(groups.where("label is not null"), "cell_id").select("row_id", "label")
            t, keys = t.join(by, "row_id"), [key, "label"]
        out = t.groupBy(*keys).agg(*(made[s].alias(s) for s in stats))
        if dense:
            base = dim.select(key, name)
            if groups is not None:
                base = base.crossJoin(counted(labels.select("label") if labels is not None else self.group_sizes(groups).select("label")))
            out = base.join(out, keys, "left").na.fill(0.0, list(stats))
        return out

    def n_cells(self) -> DataFrame:
        return self.cells.agg(F.count("*").cast("double").alias("n_cells"))

    def cell_stats(self, threshold: float = 0.0) -> DataFrame:
        n = self.feats.agg(F.count("*").cast("double").alias("n"))
        a = self.accumulate("cell", ["nnz", "sum"], threshold).crossJoin(F.broadcast(n))
        return a.select(F.col("cell_id").alias("cells"), F.col("nnz").alias("nr_feats"), (F.try_divide("nnz", "n") * 100).alias("perc_feats"), F.col("sum").alias("total_expr"))

    def feat_stats(self, threshold: float = 0.0) -> DataFrame:
        a = self.accumulate("feat", ["nnz", "sum", "sum_det"], threshold).crossJoin(F.broadcast(self.n_cells()))
        nan = F.lit(float("nan"))
        return a.select(F.col("feat_id").alias("feats"), F.col("nnz").alias("nr_cells"), (F.try_divide("nnz", "n_cells") * 100).alias("perc_cells"), F.col("sum").alias("total_expr"), F.try_divide("sum", "n_cells").alias("mean_expr"), F.when(F.col("nnz") > 0, F.try_divide("sum_det", "nnz")).otherwise(nan).alias("mean_expr_det"))

    def group_sizes(self, groups: DataFrame) -> DataFrame:
        return self.cells.join(groups.where("label is not null"), "cell_id").groupBy("label").agg(F.count("*").cast("double").alias("n_cells"))

    def by_position(self, labels: Sequence) -> DataFrame:
        """(cell_id, label) of labels given in the order of the cells' ids; None for no label."""
        spark, n = self.cells.sparkSession, self.cells.count()
        if len(labels) != n:
            raise ValueError(f"{len(labels)} labels for {n} cells")
        places = spark.createDataFrame([(i + 1, None if x is None else str(x)) for i, x in enumerate(labels)], "__at long, label string")
        return with_row_index(self.cells.select("row_id", "cell_id"), ["row_id"], name="__at").join(places, "__at").select("cell_id", "label")

    def grouped_feat_stats(self, groups: DataFrame | Sequence, threshold: float = 0.0, stats: Sequence[str] = ("sum", "sumsq", "nnz", "sum_det")) -> DataFrame:
        """Every feature with every label, zeros filled in; ``groups`` (cell_id, label), or labels in the order of the cells.

        ``stats`` says which sums to take, and so which columns come: total_expr and mean_expr (sum), sumsq and sd (both), nr_cells and
        perc_cells (nnz), mean_expr_det (nnz, sum_det). No cell with a label is an error.
        """
        if unknown := set(stats) - {"sum", "sumsq", "nnz", "sum_det"}:
            raise ValueError(f"unknown stats: {sorted(unknown)}")
        groups = groups if isinstance(groups, DataFrame) else self.by_position(groups)
        sizes = written(self.group_sizes(groups))  # a row for each label, read three times
        if not sizes.limit(1).count():
            raise ValueError("no cell has a label")
        a = self.accumulate("feat", list(stats), threshold, groups=groups, labels=sizes).join(sizes, "label")
        n, m, nan = F.col("n_cells"), F.col("sum") / F.col("n_cells"), F.lit(float("nan"))
        out = [F.col("feat_id").alias("feats"), "label", "n_cells"]
        if "sum" in stats:
            out += [F.col("sum").alias("total_expr"), m.alias("mean_expr")]
            if "sumsq" in stats:
                var = F.greatest(F.col("sumsq") - n * m * m, F.lit(0.0)) / F.nullif(n - 1, F.lit(0.0))
                out += ["sumsq", F.coalesce(F.sqrt(var), nan).alias("sd")]
        if "nnz" in stats:
            out += [F.col("nnz").alias("nr_cells"), (F.col("nnz") / n * 100).alias("perc_cells")]
            if "sum_det" in stats:
                out.append(F.when(F.col("nnz") > 0, F.try_divide("sum_det", "nnz")).otherwise(nan).alias("mean_expr_det"))
        return a.select(*out)

    def margins(self, what: str) -> DataFrame:
        """(id, value) for row_sums, col_sums, row_means or col_means; features are rows unless transposed. Null and NaN entries do not count."""
        side, kind = what.split("_")
        axis = "feat" if (side == "row") != self.transposed else "cell"
        clean = replace(self, triplets=self.triplets.where(F.col("value").isNotNull() & ~F.isnan("value")))
        a = clean.accumulate(axis, ["sum"])
        out = a.select(F.col("feat_id" if axis == "feat" else "cell_id").alias("id"), "sum")
        if kind == "sums":
            return out.withColumnRenamed("sum", "value")
        n = (self.cells if axis == "feat" else self.feats).agg(F.count("*").cast("double").alias("n"))
        return out.crossJoin(F.broadcast(n)).select("id", F.try_divide("sum", "n").alias("value"))

    def filter_masks(self, threshold: float = 1.0, feat_min_cells: int = 10, cell_min_feats: int = 10) -> tuple[DataFrame, DataFrame]:
        """(features, cells) to keep, by raw values at or above the threshold: first features, then cells over those features."""
        own = replace(self, triplets=self.raw)
        feats = own.accumulate("feat", ["nnz"], threshold, inclusive=True).where(F.col("nnz") >= feat_min_cells).select("feat_id", "col_id")
        t = own.triplets.join(feats.select("col_id"), "col_id", "left_semi")
        cells = replace(own, triplets=t).accumulate("cell", ["nnz"], threshold, inclusive=True).where(F.col("nnz") >= cell_min_feats).select("cell_id")
        return feats.select("feat_id"), cells

    def histogram(self, bins: int = 1024) -> DataFrame:
        """(feat_id, bin, n, n_zero): equal bins over (0, max] of each feature, and how many cells have nothing."""
        top = self.triplets.groupBy("col_id").agg(F.max("value").alias("top")).where("top > 0")
        at = F.least(F.ceil(F.col("value") * bins / F.col("top")).cast("int") - 1, F.lit(bins - 1)).alias("bin")
        counts = self.triplets.where("value > 0").join(top, "col_id").select("col_id", at).groupBy("col_id", "bin").agg(F.count("*").alias("n"))
        total = counts.groupBy("col_id").agg(F.sum("n").alias("held"))
        return counts.join(total, "col_id").join(self.feats, "col_id").crossJoin(F.broadcast(self.n_cells())).select("feat_id", "bin", "n", (F.col("n_cells").cast("long") - F.col("held")).alias("n_zero"))

