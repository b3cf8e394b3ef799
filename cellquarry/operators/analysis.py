"""Statistics over a matrix: variable features, markers, enrichment, correlation, components, smoothing."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from math import log
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from cellquarry.functions import stats as S
from cellquarry.operators.matrix import Matrix
from cellquarry.plans.indexing import with_row_index
from cellquarry.plans.rules import counted, partitions, small
from cellquarry.plans.store import cleaned_up, written

if TYPE_CHECKING:
    from cellquarry.operators.graph import Graph

NAN = float("nan")

# ---- variable features


def base_stats(m: Matrix, threshold: float = 0.0) -> DataFrame:
    """feats, nr_cells, total_expr, mean_expr, sd, cov (sample deviation over all cells, zeros included)."""
    a = m.accumulate("feat", ["nnz", "sum", "sumsq"], threshold).crossJoin(F.broadcast(m.n_cells()))
    mean = F.col("sum") / F.col("n_cells")
    var = F.greatest(F.col("sumsq") - F.col("n_cells") * mean * mean, F.lit(0.0)) / F.nullif(F.col("n_cells") - 1, F.lit(0.0))
    out = a.select(F.col("feat_id").alias("feats"), F.col("nnz").alias("nr_cells"), F.col("sum").alias("total_expr"), mean.alias("mean_expr"), F.sqrt(var).alias("sd"))
    return out.withColumn("cov", F.coalesce(F.try_divide("sd", "mean_expr"), F.lit(NAN)))


def variable_loess(m: Matrix, span: float = 0.75, chunk: int = 256) -> DataFrame:
    """Residuals of cov ~ log(mean) by local regression fitted at every feature, largest first.

    Features of one mean have one fit and count together in all others, so the driver and every task get the distinct means
    (32 bytes each) and a task fits ``chunk`` of them; features without a mean have no fit.
    """
    own = base_stats(m).where("nr_cells > 0 and mean_expr > 0").withColumn("x", F.log("mean_expr"))
    own = written(own)  # read three times
    p = own.groupBy("x").agg(F.count("*").alias("n"), F.avg("cov").alias("y")).toPandas().sort_values("x")
    xs, ys, times = p["x"].to_numpy(float), p["y"].to_numpy(float), p["n"].to_numpy(np.int64)
    alone = ys.copy()  # what is fitted where all neighbours have one mean: the least values, in the order of cov
    k = S.neighbours(int(times.sum()), span)
    if (crowded := xs[times > k].tolist()) and k:
        spark, w = own.sparkSession, Window.partitionBy("x").orderBy("cov").rowsBetween(Window.unboundedPreceding, 0)
        many = own.join(F.broadcast(spark.createDataFrame([(x,) for x in crowded], "x double")), "x").groupBy("x", "cov").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(w))
        taken = F.least(F.col("n"), F.greatest(F.lit(k) - F.col("upto") + F.col("n"), F.lit(0)))
        for r in many.where(taken > 0).groupBy("x").agg((F.sum(F.col("cov") * taken) / k).alias("y")).collect():
            alone[np.searchsorted(xs, r["x"])] = r["y"]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column("id").to_pylist():
                at = slice(i * chunk, (i + 1) * chunk)
                yield pa.RecordBatch.from_arrays([pa.array(xs[at]), pa.array(S.loess_counted(xs, ys, times, alone, span, at))], ["x", "fit"])

    tasks = -(-len(xs) // chunk)
    curve = own.sparkSession.range(0, tasks, 1, max(1, min(tasks, 10_000))).mapInArrow(fit, "x double, fit double")
    return own.join(small(curve, len(xs)), "x").withColumn("cov_diff", F.col("cov") - F.col("fit")).drop("x", "fit").orderBy(F.desc("cov_diff"), "feats")


def variable_groups(m: Matrix, n: int = 20) -> DataFrame:
    """z-scores of cov within quantile bins of the mean (type 7 quantiles, right-closed, lowest included)."""
    own = base_stats(m)
    probs = F.array(*(F.lit(i / n) for i in range(n + 1)))
    cut = own.agg(F.percentile("mean_expr", probs).alias("b")).withColumn("tied", F.size(F.array_distinct("b")) < n + 1)
    pos = own.where("mean_expr > 0").agg(F.percentile("mean_expr", probs).alias("p"))
    cuts = cut.crossJoin(pos).select(F.when(F.col("tied"), F.concat(F.array(F.lit(0.0)), F.slice("p", 2, n))).otherwise(F.col("b")).alias("b"))
    bins = F.greatest(F.size(F.filter(F.slice("b", 1, n), lambda e: e < F.col("mean_expr"))), F.lit(1))
    out = own.crossJoin(F.broadcast(cuts)).withColumn("bin", bins.cast("int")).drop("b")
    w = Window.partitionBy("bin")
    ok = F.when(~F.isnan("cov"), F.col("cov"))
    return out.withColumn("cov_group_zscore", F.try_divide(ok - F.avg(ok).over(w), F.stddev_samp(ok).over(w)))


def pearson_residual_variance(m: Matrix, theta: float = 100.0) -> DataFrame:
    """Variance of analytic negative binomial residuals clipped at the root of the number of cells; raw counts.

    Zeros are summed over the distinct cell totals, stored entries correct for themselves.
    """
    if not (theta > 0 and np.isfinite(theta)):
        raise ValueError("theta must be positive and finite")
    g = m.triplets.groupBy("col_id").agg(F.sum("value").alias("g")).where("g > 0")
    c = m.triplets.groupBy("row_id").agg(F.sum("value").alias("c")).where("c > 0")
    total = c.agg(F.sum("c").alias("t"), F.count("*").cast("double").alias("n"))
    sizes = c.groupBy("c").agg(F.count("*").cast("double").alias("k")).crossJoin(F.broadcast(total))
    mu = F.col("g") * F.col("c") / F.col("t")
    sd = F.sqrt(mu + mu * mu / theta)
    edge = F.sqrt("n")
    zero = F.greatest(-mu / sd, -edge)
    z0 = g.crossJoin(sizes).groupBy("col_id").agg(F.sum(F.col("k") * zero).alias("a0"), F.sum(F.col("k") * zero * zero).alias("b0"), F.first("n").alias("n"))
    z = F.least(F.greatest((F.col("value") - mu) / sd, -edge), edge)
    own = m.triplets.join(g, "col_id").join(c, "row_id").crossJoin(F.broadcast(total)).groupBy("col_id").agg(F.sum(z - zero).alias("a1"), F.sum(z * z - zero * zero).alias("b1"), F.sum("value").alias("sum"))
    s, q = F.col("a0") + F.col("a1"), F.col("b0") + F.col("b1")
    var = z0.join(own, "col_id").select("col_id", "sum", ((q - s * s / F.col("n")) / (F.col("n") - 1)).alias("v"))
    out = m.feats.join(var, "col_id", "left").crossJoin(F.broadcast(m.n_cells()))
    return out.select(F.col("feat_id").alias("feats"), F.coalesce("v", F.lit(0.0)).alias("var"), (F.coalesce("sum", F.lit(0.0)) / F.col("n_cells")).alias("mean_expr")).orderBy(F.desc("var"), "feats")


# ---- markers


def moments(m: Matrix, groups: DataFrame, sets: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(feat_id, label, n, s, q): cells, sums and sums of squares; with ``sets`` pooled over each set's labels."""
    sizes = written(m.group_sizes(groups))  # a row for each label, read twice
    a = m.accumulate("feat", ["sum", "sumsq"], groups=groups, labels=sizes).join(sizes, "label").select("feat_id", "label", F.col("n_cells").alias("n"), F.col("sum").alias("s"), F.col("sumsq").alias("q"))
    if sets is None:
        return a
    of = m.cells.sparkSession.createDataFrame([(k, v) for k, vs in sets.items() for v in vs], "pool string, label string")
    return a.join(small(of, sum(map(len, sets.values()))), "label").groupBy("feat_id", F.col("pool").alias("label")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))


def welch(m: Matrix, groups: DataFrame, comparison: str = "pairwise", nodes: Mapping[str, tuple[Sequence[str], Sequence[str]]] | None = None, lfc: float = 0.0) -> DataFrame:
    """Host against target: (feat_id, host, target, lfc, std_lfc, err, df, t). ``comparison``: pairwise, one_vs_rest or nodes (name -> left and right labels)."""
    if comparison == "pairwise":
        a = moments(m, groups).groupBy("feat_id").agg(F.collect_list(F.struct("label", "n", "s", "q")).alias("g"))
        pairs = a.select("feat_id", F.explode("g").alias("h"), "g").select("feat_id", "h", F.explode("g").alias("t")).where("h.label != t.label").select("feat_id", F.col("h.label").alias("host"), F.col("t.label").alias("target"), *(F.col(f"{x}.{c}").alias(f"{x}{c}") for x in "ht" for c in "nsq"))
    elif comparison == "one_vs_rest":
        a = moments(m, groups)
        w = Window.partitionBy("feat_id")
        names = F.array_sort(F.collect_set("label").over(w))
        pairs = a.select("feat_id", F.col("label").alias("host"), F.array_join(F.array_remove(names, F.col("label")), "_").alias("target"), *(F.col(c).alias(f"h{c}") for c in "nsq"), *((F.sum(c).over(w) - F.col(c)).alias(f"t{c}") for c in "nsq"))
    else:
        sides = {f"{k}|{i}": v[i] for k, v in (nodes or {}).items() for i in (0, 1)}
        a = moments(m, groups, sides).withColumn("node", F.regexp_extract("label", r"^(.*)\|\d$", 1)).withColumn("side", F.substring("label", -1, 1))
        one = lambda s, p: a.where(F.col("side") == s).select("feat_id", "node", *(F.col(c).alias(p + c) for c in "nsq"))
        pairs = one("0", "h").join(one("1", "t"), ["feat_id", "node"]).select("feat_id", F.col("node").alias("host"), F.lit("right").alias("target"), *(f"{p}{c}" for p in "ht" for c in "nsq"))
    mean = lambda p: F.col(f"{p}s") / F.col(f"{p}n")
    var = lambda p: F.greatest((F.col(f"{p}q") - F.col(f"{p}s") * mean(p)) / F.nullif(F.col(f"{p}n") - 1, F.lit(0.0)), F.lit(1e-8))
    out = pairs.withColumns({"hv": F.when(F.col("hn") > 1, var("h")), "tv": F.when(F.col("tn") > 1, var("t"))})
    eh, et = F.col("hv") / F.col("hn"), F.col("tv") / F.col("tn")
    diff = mean("h") - mean("t")
    pooled = F.sqrt(((F.col("hn") - 1) * F.col("hv") + (F.col("tn") - 1) * F.col("tv")) / (F.col("hn") + F.col("tn") - 2))
    out = out.select("feat_id", "host", "target", diff.alias("lfc"), F.when(diff == 0, 0.0).otherwise(diff / pooled).alias("std_lfc"), (eh + et).alias("err"), ((eh + et) * (eh + et) / (eh * eh / (F.col("hn") - 1) + et * et / (F.col("tn") - 1))).alias("df"))
    return out.withColumn("t", (F.col("lfc") - lfc) / F.sqrt("err"))


@F.pandas_udf(T.StructType([T.StructField("left", T.DoubleType()), T.StructField("right", T.DoubleType())]))
def _tails(d: pd.Series, err: pd.Series, df: pd.Series, lfc: pd.Series) -> pd.DataFrame:
    sd = np.sqrt(err.to_numpy(float))
    left = S.log_t_cdf((d + lfc).to_numpy(float) / sd, df.to_numpy(float))
    right = S.log_t_cdf(-(d - lfc).to_numpy(float) / sd, df.to_numpy(float))
    return pd.DataFrame({"left": left, "right": right})


def markers(m: Matrix, groups: DataFrame, comparison: str = "pairwise", direction: str = "any", lfc: float = 0.0, nodes: Mapping | None = None) -> DataFrame:
    """welch() with log_p and log_fdr (adjusted over the features of each comparison). Directions: any, up, down."""
    w = welch(m, groups, comparison, nodes)
    p = w.withColumn("tails", _tails("lfc", "err", "df", F.lit(float(lfc))))
    pick = {"up": F.col("tails.right"), "down": F.col("tails.left"), "any": F.least(F.lit(0.0), F.least(F.col("tails.left"), F.col("tails.right")) + log(2))}[direction]
    p = p.withColumn("log_p", pick).drop("tails")
    mine = Window.partitionBy("host", "target")
    up = mine.orderBy("log_p", "feat_id")
    p = p.withColumn("__r", F.row_number().over(up)).withColumn("__a", F.col("log_p") + F.log(F.count("*").over(mine) / F.col("__r")))
    return p.withColumn("log_fdr", _least_from_here(mine, "log_p", "feat_id")).drop("__r", "__a")


def _least_from_here(mine: WindowSpec, *order: str) -> Column:
    """0 or the least __a of a row and those after it: as a running minimum from the end, since a frame that ends with the partition is gone through anew for each row."""
    back = mine.orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    return F.least(F.lit(0.0), F.min("__a").over(back))


def combine_markers(pairs: DataFrame, kind: str = "any", min_prop: float | None = None) -> DataFrame:
    """One row for each host and feature of markers(): top (rank-based, for any), log_p combined, log_fdr, mean lfc.

    any: Simes; all: the largest; some: Holm's value at the ``min_prop`` position (0.5).
    """
    by_pair = Window.partitionBy("host", "target").orderBy("log_p", "feat_id")
    n = F.count("*").over(Window.partitionBy("host", "feat_id"))
    by_p = Window.partitionBy("host", "feat_id").orderBy("log_p", "target")
    r = pairs.withColumn("rank", F.row_number().over(by_pair)).withColumn("n", n).withColumn("i", F.row_number().over(by_p))
    value = {"any": F.min(F.col("log_p") + F.log(F.col("n") / F.col("i"))), "all": F.max("log_p"), "some": F.max(F.when(F.col("i") <= F.ceil(F.col("n") * (min_prop or 0.5)), F.least(F.lit(0.0), F.col("log_p") + F.log(F.col("n") - F.col("i") + 1))))}[kind]
    k = F.ceil(F.size("ranks") * (min_prop or {"any": 0.0, "some": 0.5, "all": 1.0}[kind])).cast("int")
    out = r.groupBy("host", "feat_id").agg(value.alias("log_p"), F.avg("lfc").alias("mean_lfc"), F.array_sort(F.collect_list("rank")).alias("ranks"))
    out = out.withColumn("top", F.element_at("ranks", F.greatest(k, F.lit(1)))).drop("ranks")
    mine = Window.partitionBy("host")
    up = mine.orderBy("log_p", "feat_id")
    a = F.col("log_p") + F.log(F.count("*").over(mine) / F.row_number().over(up))
    return out.withColumn("__a", a).withColumn("log_fdr", _least_from_here(mine, "log_p", "feat_id")).drop("__a")


# ---- enrichment


def page_enrichment(m: Matrix, sign: DataFrame, min_overlap: int = 5, reverse_log: bool = True, base: float = 2.0, scale: bool = False) -> DataFrame:
    """(cell_id, type, zscore) of marker sets ``sign`` (feat_id, type): parametric analysis of gene sets."""
    own = sign.join(m.feats, "feat_id").select("col_id", "type").distinct()
    sizes = own.groupBy("type").agg(F.count("*").cast("double").alias("k")).where(F.col("k") > min_overlap)
    if sizes.count() < 2:
        raise ValueError("at least two types need enough markers")
    n_feats = m.feats.agg(F.count("*").cast("double").alias("g"))
    v = F.col("value")
    s = m.triplets.groupBy("col_id").agg(F.sum(F.pow(F.lit(base), v) - 1 if reverse_log else v).alias("s"))
    mean = F.coalesce(F.col("s"), F.lit(0.0)) / F.col("n_cells")
    ref = m.feats.join(s, "col_id", "left").crossJoin(F.broadcast(m.n_cells())).select("col_id", (F.log(mean + 1) if reverse_log else mean).alias("m"))
    whole = ref.agg(F.sum("m").alias("m1"), F.sum(F.col("m") * F.col("m")).alias("m2")).crossJoin(n_feats)
    a = m.triplets.join(ref, "col_id").groupBy("row_id").agg(F.sum("value").alias("x1"), F.sum(v * v).alias("x2"), F.sum(v * F.col("m")).alias("xm"))
    cell = m.cells.join(a, "row_id", "left").na.fill(0.0).crossJoin(F.broadcast(whole))
    s1, s2, g = F.col("x1") - F.col("m1"), F.col("x2") - 2 * F.col("xm") + F.col("m2"), F.col("g")
    cell = cell.select("row_id", "cell_id", (s1 / g).alias("mid"), F.sqrt(F.greatest(s2 - s1 * s1 / g, F.lit(0.0)) / (g - 1)).alias("sd"))
    sets = sizes.join(own.join(ref, "col_id").groupBy("type").agg(F.sum("m").alias("tm")), "type")
    got = m.triplets.join(own, "col_id").groupBy("row_id", "type").agg(F.sum("value").alias("tx"))
    z = cell.crossJoin(counted(sets)).join(got, ["row_id", "type"], "left").na.fill(0.0, ["tx"])
    z = z.select("cell_id", "type", F.try_divide(((F.col("tx") - F.col("tm")) / F.col("k") - F.col("mid")) * F.sqrt("k"), "sd").alias("zscore"))
    if scale:
        w = Window.partitionBy("type")
        z = z.withColumn("zscore", F.try_divide(F.col("zscore") - F.avg("zscore").over(w), F.stddev_samp("zscore").over(w)))
    return z.orderBy("cell_id", "type")


def rank_enrichment(m: Matrix, sign: DataFrame) -> DataFrame:
    """Extension: mean rank, within each feature over its cells with values, of a set's features in a cell."""
    r = m.triplets.withColumn("r", F.percent_rank().over(Window.partitionBy("col_id").orderBy("value")))
    return r.join(sign.join(m.feats, "feat_id").select("col_id", "type").distinct(), "col_id").groupBy("row_id", "type").agg(F.avg("r").alias("score")).join(m.cells, "row_id").select("cell_id", "type", "score")


def deconvolve(m: Matrix, signature: DataFrame) -> DataFrame:
    """(cell_id, type, share): non-negative weights of the signature (feat_id, type, value) for each cell, scaled to 1, by damped weighted least squares.

    Features with the same row of the signature weigh the same, so a cell's values are summed over them and each kind of row counts as
    often as it occurs: the same sums, over kinds instead of features. A cell without values of the signature's features has shares of 0.
    """
    each = signature.where(F.col("type").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value")).groupBy("feat_id", "type").agg(F.avg("value").alias("value"))
    own = each.where("value != 0").groupBy("feat_id").agg(F.array_sort(F.collect_list(F.struct("type", "value"))).alias("row"))
    kinds = sorted(own.groupBy("row").agg(F.count("*").alias("n")).collect(), key=lambda r: [tuple(x) for x in r["row"]])  # kinds of rows: features at most
    types = sorted(r["type"] for r in each.select("type").distinct().collect())
    a, times = np.zeros((len(kinds), len(types))), np.array([r["n"] for r in kinds], float)
    for i, r in enumerate(kinds):
        for x in r["row"]:
            a[i, types.index(x["type"])] = x["value"]
    spark = m.cells.sparkSession
    known = spark.createDataFrame([(i, r["row"]) for i, r in enumerate(kinds)], T.StructType([T.StructField("kind", T.IntegerType()), own.schema["row"]]))
    kind_of = m.feats.join(own.join(small(known, len(kinds)), "row").select("feat_id", "kind"), "feat_id").select("col_id", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, min(4096, (1 << 22) // max(len(kinds) * len(types), 1)))
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                lists = batch.column("kinds")
                row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                at, value = lists.flatten().to_numpy(zero_copy_only=False), batch.column("vals").flatten().to_numpy(zero_copy_only=False)
                b = np.bincount(row * len(kinds) + at, value, batch.num_rows * len(kinds)).reshape(batch.num_rows, len(kinds))
                share = np.zeros((batch.num_rows, len(types)))
                some = np.unique(row)
                if len(some):
                    share[some] = S.damped_shares_of_kinds(a, times, b[some])
                cells = batch.column("cell_id").take(pa.array(np.repeat(np.arange(batch.num_rows), len(types))))
                yield pa.RecordBatch.from_arrays([cells, pa.array(types * batch.num_rows, pa.string()), pa.array(share.ravel())], ["cell_id", "type", "share"])

    sums = m.triplets.join(kind_of, "col_id").groupBy("row_id", "kind").agg(F.sum("value").alias("v"))
    lists = sums.groupBy("row_id").agg(F.collect_list("kind").alias("kinds"), F.collect_list("v").alias("vals"))
    every = m.cells.select("row_id", "cell_id").join(lists, "row_id", "left").select("cell_id", F.coalesce("kinds", F.array().cast("array<int>")).alias("kinds"), F.coalesce("vals", F.array().cast("array<double>")).alias("vals"))
    return every.mapInArrow(run, f"cell_id {m.cells.schema['cell_id'].dataType.simpleString()}, type string, share double")


# ---- products, correlation, components


def gram(m: Matrix) -> DataFrame:
    """(f1, f2, g), f1 <= f2: sums over cells of products of two features' values.

    Where pairs of features are too many to be summed within a task first, they are dealt to partitions of bounded size.
    """
    tasks = partitions(m.triplets)
    cells = m.triplets.select("row_id", "col_id", "value").repartition(tasks, "row_id").groupBy("row_id").agg(F.collect_list(F.struct("col_id", "value")).alias("a"))
    pairs = cells.select("a", F.explode("a").alias("x")).select("x", F.explode("a").alias("y")).where("x.col_id <= y.col_id").select(F.col("x.col_id").alias("f1"), F.col("y.col_id").alias("f2"), (F.col("x.value") * F.col("y.value")).alias("g"))
    pairs = pairs if m.feats.count() < 2048 else pairs.repartition(4 * tasks, "f1", "f2")
    return pairs.groupBy("f1", "f2").agg(F.sum("g").alias("g"))


def correlation(m: Matrix, sparse: bool = False, network: Graph | None = None, hops: int = 1) -> DataFrame:
    """(feat1, feat2, r): Pearson correlations of all pairs of features, the first with the lesser col_id; null where one does not vary.

    A pair that shares no cell has no product sum and follows from the sums alone; ``sparse`` leaves such pairs out. The others
    are made where they are returned, each feature against blocks of features, so that only pairs with a shared cell are shuffled.
    With a ``network`` of the cells the values are first smoothed along it.
    """
    m = network.smooth(m, hops) if network is not None else m
    s = m.accumulate("feat", ["sum", "sumsq"]).crossJoin(F.broadcast(m.n_cells())).select("col_id", "feat_id", (F.col("sum") / F.col("n_cells")).alias("mu"), (F.col("sumsq") - F.col("sum") * F.col("sum") / F.col("n_cells")).alias("d"), "n_cells")
    s = s if sparse else written(with_row_index(s, ["col_id"], name="at"))
    extra = [] if sparse else ["at"]
    left = s.select(F.col("col_id").alias("f1"), F.col("feat_id").alias("feat1"), F.col("mu").alias("m1"), F.col("d").alias("d1"), "n_cells", *(F.col(c).alias("at1") for c in extra))
    right = s.select(F.col("col_id").alias("f2"), F.col("feat_id").alias("feat2"), F.col("mu").alias("m2"), F.col("d").alias("d2"), *(F.col(c).alias("at2") for c in extra))
    shared = gram(m).where("f1 < f2").join(left, "f1").join(right, "f2")
    r = lambda g: F.try_divide(g - F.col("n_cells") * F.col("m1") * F.col("m2"), F.sqrt(F.col("d1") * F.col("d2"))).alias("r")
    if sparse:
        return shared.select("feat1", "feat2", r(F.col("g")))
    n = s.count()
    size = min(max(-(-n // 16), 64), 8192)  # features of a block; a task has 4 blocks against one
    blocks = -(-n // size)
    shared = written(shared)
    held = shared.groupBy("at1", F.floor((F.col("at2") - 1) / size).alias("block")).agg(F.collect_list(((F.col("at2") - 1) % size + 1).cast("int")).alias("held"))
    part = F.floor((F.col("at1") - 1) / (4 * size)).alias("part")
    one = left.withColumn("block", F.explode(F.sequence(F.floor((F.col("at1") - 1) / size), F.lit(blocks - 1).cast("long")))).join(held, ["at1", "block"], "left").withColumn("part", part)
    of = right.groupBy(F.floor((F.col("at2") - 1) / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("at2", "feat2", "m2", "d2"))).alias("own"))
    of = of.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("block") / 4))))
    tasks = max(1, blocks * (blocks + 4) // 8)
    first = F.greatest(F.col("at1") - F.col("block") * size + 1, F.lit(1)).cast("int")
    rest = F.when(first <= F.size("own"), F.array_except(F.sequence(first, F.size("own")), F.coalesce("held", F.array().cast("array<int>"))))
    pairs = one.repartition(tasks, "block", "part").join(of.repartition(tasks, "block", "part").hint("shuffle_hash"), ["block", "part"]).select("feat1", "m1", "d1", "n_cells", "own", F.explode(rest).alias("i"))
    pairs = pairs.select("feat1", "m1", "d1", "n_cells", F.get("own", F.col("i") - 1).alias("x")).select("feat1", "m1", "d1", "n_cells", "x.feat2", "x.m2", "x.d2")
    return pairs.select("feat1", "feat2", r(F.lit(0.0))).unionByName(shared.select("feat1", "feat2", r(F.col("g"))))


def crossprod(m: Matrix, weights: DataFrame) -> DataFrame:
    """(cell_id, name, value): for ``weights`` (feat_id, name, w) the weighted sum of each cell's values; zeros included."""
    w = weights.join(m.feats, "feat_id").select("col_id", "name", "w")
    got = m.triplets.join(w, "col_id").groupBy("row_id", "name").agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    return m.cells.crossJoin(counted(weights.select("name").distinct())).join(got, ["row_id", "name"], "left").na.fill(0.0, ["value"]).select("cell_id", "name", "value")


def _moments_by_feature(m: Matrix, scale: bool) -> tuple[list[int], np.ndarray, np.ndarray, int]:
    n = m.cells.count()
    s = sorted((r.col_id, r["sum"], r["sumsq"]) for r in m.accumulate("feat", ["sum", "sumsq"]).collect())
    mu = np.array([x[1] for x in s]) / n
    var = np.maximum(np.array([x[2] for x in s]) - n * mu**2, 0) / max(n - 1, 1)
    sd = np.sqrt(var) if scale else np.ones(len(s))
    sd[sd == 0] = 1.0
    return [x[0] for x in s], mu, sd, n


def _entries(batch: pa.RecordBatch, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the entries of a batch of lists; ``feats``: the sorted ids."""
    cols = batch.column("cols")
    row = np.repeat(np.arange(batch.num_rows), cols.value_lengths().to_numpy(zero_copy_only=False))
    return row, np.searchsorted(feats, cols.flatten().to_numpy(zero_copy_only=False)), batch.column("vals").flatten().to_numpy(zero_copy_only=False)


def _times(n: int, entries: tuple[np.ndarray, np.ndarray, np.ndarray], basis: np.ndarray) -> np.ndarray:
    """X B of a sparse batch of n rows."""
    row, col, val = entries
    return np.column_stack([np.bincount(row, val * b[col], n) for b in basis.T])


def _gram(n: int, entries: tuple[np.ndarray, np.ndarray, np.ndarray], p: int) -> np.ndarray:
    """X'X of a sparse batch: by pairs of entries of a row where these are few, else by a dense block."""
    row, col, val = entries
    size = np.bincount(row, minlength=n)
    if (size.astype(float) ** 2).sum() * 50 < float(n) * p * p:
        many = size[row]
        first = np.repeat(np.arange(len(row)), many)
        start = np.repeat((np.cumsum(size) - size)[row], many)
        second = start + np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
        return np.bincount(col[first] * p + col[second], val[first] * val[second], p * p).reshape(p, p)
    x = np.zeros((n, p))
    x[row, col] = val
    return x.T @ x


def pca(m: Matrix, ncp: int = 50, method: str = "auto", center: bool = True, scale: bool = True, oversample: int = 10, powers: int = 2, seed: int = 1234, relerr: float = 0.01, most_bytes: float = 5e9, feats_to_use: Sequence[str] | DataFrame | None = None, dry_run: bool = False) -> dict:
    """Components of the cells over few thousand features: {"sdev", "loadings" (features x k), "features", "scores" DataFrame}.

    gram: eigenvectors of the features' Gram matrix, summed from blocks of cells; random: subspace
    iteration with the same block products; auto: gram where the matrix fits ``most_bytes``. Signs:
    the largest loading of each component is positive. ``dry_run`` tells method, size and features only.
    """
    m = m if feats_to_use is None else m.subset(feats=feats_to_use)
    if method in ("exact", "irlba"):
        raise ValueError("a dense decomposition is not offered; use gram or random")
    feats, mu, sd, n = _moments_by_feature(m, scale)
    mu = mu if center else np.zeros_like(mu)
    p = len(feats)
    if method == "auto":
        method = "gram" if p * p * 8 < most_bytes else "random"
    if ncp >= p:
        ncp = max(p - 1, 1)
    at, spark = np.array(feats, np.int64), m.cells.sparkSession
    sc = spark.sparkContext
    if dry_run:
        return {"method": method, "features": feats, "ncp": ncp, "bytes": 8.0 * p * (p if method == "gram" else ncp + oversample)}
    none = m.cells.select("row_id", "cell_id", F.lit(None).cast("bigint").alias("col_id"), F.lit(None).cast("double").alias("value"))
    rows = m.triplets.select("row_id", F.lit(None).cast(m.cells.schema["cell_id"].dataType).alias("cell_id"), F.col("col_id").cast("bigint").alias("col_id"), "value").unionByName(none)
    rows = rows.repartitionByRange(partitions(m.triplets, 1 << 21), "row_id")  # cells that stand together share features more often
    cells = rows.groupBy("row_id").agg(F.max("cell_id").alias("cell_id"), F.collect_list("col_id").alias("cols"), F.collect_list("value").alias("vals")).where("cell_id is not null").drop("row_id").persist()

    def product(basis: np.ndarray | None) -> np.ndarray:
        """X'X B (or X'X) of the scaled, centred values; partitions send their sums in blocks of the features they hold, which are added up."""
        width = p if basis is None else basis.shape[1]
        step = max(1, (4 << 20) // (8 * width)) if basis is None else 1024
        held = sc.broadcast(None if basis is None else basis / sd[:, None])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scaled, out, sums, met = held.value, None, np.zeros(width), np.zeros(-(-p // step), bool)
            shift = None if scaled is None else mu @ scaled
            for b in batches:
                for i in range(0, b.num_rows, 1024 if basis_is_none else 1 << 16):
                    part = b.slice(i, 1024 if basis_is_none else 1 << 16)
                    own = _entries(part, at)
                    out = np.zeros((p, width)) if out is None else out
                    if basis_is_none:
                        out += _gram(part.num_rows, own, p)
                        met[:] = True
                    else:
                        xb = _times(part.num_rows, own, scaled) - shift
                        row, col, val = own
                        some, place = np.unique(col, return_inverse=True)
                        out[some] += np.column_stack([np.bincount(place, val * y[row], len(some)) for y in xb.T])
                        sums += xb.sum(axis=0)
                        met[some // step] = True
            if out is not None:
                found = np.flatnonzero(met).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["i", "rows"])
                for i in range(0, len(found), 64):
                    yield pa.RecordBatch.from_arrays([pa.array([j * step for j in found[i : i + 64]], pa.int32()), pa.array([out[j * step : (j + 1) * step].tobytes() for j in found[i : i + 64]], pa.binary())], ["i", "rows"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"i": [pdf["i"].iloc[0]], "rows": [sum(np.frombuffer(r) for r in pdf["rows"]).tobytes()]})

        basis_is_none = basis is None
        with cleaned_up(spark):
            blocks = cells.mapInArrow(run, "i int, rows binary").groupBy("i").applyInPandas(add, "i int, rows binary").collect()
        held.destroy()
        g, total = np.zeros((p, width)), np.zeros(width)
        for r in blocks:
            if r.i < 0:
                total = np.frombuffer(r["rows"])
            else:
                g[r.i : r.i + step] = np.frombuffer(r["rows"]).reshape(-1, width)
        return (g - n * np.outer(mu, mu)) / np.outer(sd, sd) if basis_is_none else (g - np.outer(mu, total)) / sd[:, None]

    if method == "gram":
        value, vec = np.linalg.eigh(product(None))
        value, vec = value[::-1][:ncp], vec[:, ::-1][:, :ncp]
        if value[0] > 0 and value[-1] > 0 and np.finfo(float).eps * value[0] / value[-1] / 2 > relerr:
            method = "random"
    if method == "random":
        q = np.linalg.qr(np.random.default_rng(seed).normal(size=(p, min(ncp + oversample, p))))[0]
        for _ in range(powers + 1):
            q = np.linalg.qr(product(q))[0]
        small, turn = np.linalg.eigh((lambda t: (t + t.T) / 2)(q.T @ product(q)))
        value, vec = small[::-1][:ncp], (q @ turn)[:, ::-1][:, :ncp]
    vec = vec * np.sign(vec[np.abs(vec).argmax(axis=0), np.arange(vec.shape[1])])
    turn, shift = vec / sd[:, None], mu @ (vec / sd[:, None])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = _times(b.num_rows, _entries(b, at), turn) - shift
            yield pa.RecordBatch.from_arrays([b.column("cell_id"), pa.array(score.tolist(), pa.list_(pa.float64()))], ["cell_id", "scores"])

    return {"sdev": np.sqrt(np.maximum(value, 0) / max(n - 1, 1)), "loadings": vec, "features": feats, "scores": cells.mapInArrow(project, f"cell_id {m.cells.schema['cell_id'].dataType.simpleString()}, scores array<double>"), "method": method}


# ---- thresholds


def binarize(m: Matrix, threshold: float | DataFrame | str = "kmeans", percentage_rank: float = 30.0, bins: int = 1024) -> Matrix:
    """1 where a value passes: a number, (col_id, w), or a cut per feature from its histogram (kmeans: two means; rank: the top share).

    A rule's cut is in units of histogram bins, so values are scaled to them before they are compared; a feature without positive values has no cut.
    """
    if not isinstance(threshold, str):
        return m.compare(">", threshold)
    h = m.histogram(bins).join(m.feats, "feat_id").groupBy("col_id").agg(F.first("n_zero").alias("n_zero"), F.collect_list("bin").alias("bins"), F.collect_list("n").alias("ns"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges = []
            at = b.column("bins").offsets.to_numpy()
            every, ns = (b.column(c).values.to_numpy() for c in ("bins", "ns"))
            for x, y, zero in zip(at[:-1].tolist(), at[1:].tolist(), b.column("n_zero").to_pylist(), strict=True):
                pos, n = np.append(every[x:y] + 0.5, 0.0), np.append(ns[x:y], zero)
                edge = S.two_means_cut(pos, n) if threshold == "kmeans" else S.rank_cut(pos, n, percentage_rank)
                edges.append(max(edge, 0.0))
            yield pa.RecordBatch.from_arrays([b.column("col_id"), pa.array(edges, pa.float64())], ["col_id", "w"])

    top = m.triplets.groupBy("col_id").agg(F.max("value").alias("top")).where("top > 0")
    scaled = m.multiply(top.select("col_id", (F.lit(float(bins)) / F.col("top")).alias("w")), axis="feat")
    return scaled.compare(">", h.mapInArrow(cut, f"col_id {m.feats.schema['col_id'].dataType.simpleString()}, w double"))
