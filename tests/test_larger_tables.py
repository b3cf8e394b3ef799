"""What showed only on larger tables, on small ones that have its cause."""

from __future__ import annotations

import os
import re

import numpy as np
from pyspark.sql import functions as F

from cellquarry import catalogue
from cellquarry.functions import ids, stats
from cellquarry.operators import analysis as A
from cellquarry.operators.graph import Graph
from cellquarry.operators.matrix import Matrix


def test_codes_of_numbers_beyond_32_bits(spark, tmp_path):
    """Eight letters hold 32 bits: of a longer number the last ones were cut off, and the number read back was another."""
    n = [0, 7919, 2**32 - 1, 2**32, 600_000 * 7919, 2**62 + 5]
    got = spark.createDataFrame([(x,) for x in n], "n long").select("n", ids.cell_code(F.col("n"), F.lit(1)).alias("code"))
    rows = got.withColumn("back", ids.cell_number(F.col("code"))).collect()
    assert [r.back for r in rows] == n and len({r.code for r in rows}) == len(n)
    assert [len(r.code) for r in rows[:3]] == [10, 10, 10]
    spark.createDataFrame([(1,), (600_000,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    found = {r.o_orderkey: (r.code, r.back) for r in catalogue.xenium_id_codec(spark, str(tmp_path)).collect()}
    assert found == {1: ("aaaaboop-1", 7919), 600_000: ("bbldejme-1", 4_751_400_000)}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def random_matrix(spark, cells: int, feats: int, each: int, seed: int = 1) -> tuple[Matrix, np.ndarray]:
    """Cells 1 .. of ``each`` entries with small whole values, and the dense array (cells x features)."""
    rng = np.random.default_rng(seed)
    x = np.zeros((cells, feats))
    for row in x:
        row[rng.choice(feats, each, replace=False)] = rng.integers(1, 6, each)
    return Matrix.from_array(spark, x.T, [f"f{i + 1:05}" for i in range(feats)], [f"c{i + 1}" for i in range(cells)]), x


def test_pairs_without_a_shared_cell_are_not_shuffled(spark):
    """All pairs were made by one nested loop and then shuffled, to meet the few that share a cell."""
    m, x = random_matrix(spark, 150, 300, 3)
    got = A.correlation(m)
    assert "NestedLoop" not in plan_of(got).split("Union", 1)[1] and "Cartesian" not in plan_of(got)
    rows = {(r.feat1, r.feat2): r.r for r in got.collect()}
    assert len(rows) == got.count() == 300 * 299 // 2 and all(a < b for a, b in rows)
    with np.errstate(all="ignore"):
        want = np.corrcoef(x.T)
    for (a, b), r in rows.items():
        w = want[int(a[1:]) - 1, int(b[1:]) - 1]
        assert (r is None and np.isnan(w)) or abs(r - w) < 1e-9


def test_rounding_is_that_of_spark(spark):
    rng = np.random.default_rng(2)
    own = [0.00005, 0.00015, 1.00005, -1.00005, 2.67545, 1e300, -0.00001, float("inf"), float("-inf"), float("nan"), None, 123456.78905]
    own += [float(x) for x in (rng.integers(-(10**7), 10**7, 2000) / 10**5).tolist() + (rng.normal(size=2000) * 10.0 ** rng.integers(-6, 9, 2000)).tolist()]
    d = spark.createDataFrame([(x,) for x in own], "x double").select(catalogue.rounded(F.col("x"), 4).alias("a"), F.round("x", 4).alias("b"))
    assert d.where("not (a <=> b)").count() == 0


def test_least_of_what_follows_in_one_pass(spark):
    """Spark goes through a frame from a row to the end of its partition anew for each row: quadratic in the features."""
    m, _ = random_matrix(spark, 60, 40, 5)
    groups = m.cells.select("cell_id", (F.col("row_id") % 3).cast("string").alias("label"))
    pairs = A.markers(m, groups)
    for kind in ("any", "some", "all"):
        out = A.combine_markers(pairs, kind)
        assert not re.search(r"currentrow\$\(\), unboundedfollowing", plan_of(out))
        for host in "012":
            own = out.where(F.col("host") == host).orderBy("log_p", "feat_id").toPandas()
            a = own["log_p"] + np.log(len(own) / np.arange(1, len(own) + 1))
            assert np.allclose(own["log_fdr"], np.minimum(a[::-1].cummin()[::-1], 0.0), rtol=1e-12)


def test_shares_take_as_long_as_kinds_of_signature_rows(spark):
    """Each cell went through all features of the signature some hundred times; it now goes through the kinds of their rows, with the same shares."""
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 3, (7, 3)).astype(float)
    a = rows[rng.integers(0, 7, 90)]
    b = np.where(rng.random((25, 90)) < 0.1, rng.integers(1, 9, (25, 90)), 0).astype(float)
    b[3] = 0
    m = Matrix.from_array(spark, b.T, [f"f{i:02}" for i in range(90)], [f"c{i}" for i in range(25)])
    sign = spark.createDataFrame([(f"f{i:02}", f"t{j}", float(a[i, j])) for i in range(90) for j in range(3)], "feat_id string, type string, value double")
    whole = stats.damped_shares_of_kinds
    out = {(r.cell_id, r.type): r.share for r in A.deconvolve(m, sign).collect()}
    for i in range(25):
        want = stats.damped_shares(a, b[i]) if b[i].any() else np.zeros(3)
        assert np.allclose([out[f"c{i}", f"t{j}"] for j in range(3)], want, atol=1e-6)
    kinds, times = np.unique(a[a.any(axis=1)], axis=0, return_counts=True)
    sums = np.stack([b[:, (a == k).all(axis=1)].sum(axis=1) for k in kinds], axis=1)
    assert np.allclose(whole(kinds, times.astype(float), sums), [stats.damped_shares(a, x) for x in b], atol=1e-6)
    plan = plan_of(A.deconvolve(m, sign))
    assert "kinds" in plan and "collect_list(feat_id" not in plan


def test_local_regression_takes_equal_means_together(spark):
    """All means and deviations stood in one row, which was repeated for each task: the features' number squared."""
    rng = np.random.default_rng(6)
    x = np.repeat(np.sort(rng.random(40)), rng.integers(1, 12, 40))
    for own in (x, np.where(x < 0.97, 0.5, x), np.round(x, 1)):  # also: more points at one place than a fit takes
        y = np.sin(4 * own) + rng.random(len(own))
        order = np.lexsort((y, own))
        own, y = own[order], y[order]
        for span in (0.75, 0.3, 1.0):
            u, inv, n = np.unique(own, return_inverse=True, return_counts=True)
            k = stats.neighbours(len(own), span)
            alone = np.array([y[own == v][:k].mean() for v in u])
            got = stats.loess_counted(u, np.bincount(inv, y) / n, n, alone, span, slice(0, len(u)))
            assert np.allclose(got, stats.loess(own, y, span)[np.searchsorted(own, u)], atol=1e-6)
    cells = rng.poisson(2.0, (12, 30)).astype(float) * (1 + np.arange(12))[:, None]
    crowd = np.concatenate([cells] + [rng.permuted(cells[:1], axis=1) for _ in range(60)])
    m = Matrix.from_array(spark, crowd, [f"f{i:03}" for i in range(72)], [f"c{i}" for i in range(30)])
    out = A.variable_loess(m, chunk=7)
    assert "collect_list" not in plan_of(out)
    got = out.toPandas().sort_values(["mean_expr", "cov"])
    assert len(got) == 72 and np.allclose(got["cov"] - stats.loess(np.log(got["mean_expr"]), got["cov"]), got["cov_diff"], atol=1e-6)


def shuffle_files(spark) -> int:
    """How many files of map tasks lie in the block manager's folders."""
    return sum(1 for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs() for _, _, names in os.walk(d.getPath()) for x in names if re.match(r"shuffle_\d+_\d+_\d+\.data$", x))


def test_passes_over_components_leave_no_shuffle_files(spark):
    """Every pass over the cells left its partial sums on disk."""
    m, x = random_matrix(spark, 200, 60, 6)
    before = shuffle_files(spark)
    got = A.pca(m, 3, method="random", powers=30)
    left = shuffle_files(spark) - before
    value = np.linalg.eigvalsh(np.corrcoef(x.T))[::-1][:3]
    assert np.allclose(got["sdev"] ** 2, value, rtol=1e-3) and got["scores"].count() == 200
    assert left < 32  # the passes


def test_stored_matrix_is_dealt_once(spark):
    """Entries were dealt by cell and feature, again by cell, and both once more for each count of them."""
    m = catalogue.fresh_matrix(spark, "/root/testdata/sf0.001", placed=True)
    plan = plan_of(m.triplets.sortWithinPartitions("row_id", "col_id"))
    assert plan.count("Exchange") == 1 and "rangepartitioning(row_id" in plan
    seen = m.triplets.select("row_id", F.spark_partition_id().alias("p")).distinct().groupBy("row_id").count()
    assert seen.where("count > 1").count() == 0


def test_cuts_and_products_without_a_task_for_each_feature(spark):
    """Cuts went through Python feature by feature, products through a join of the entries with themselves."""
    m, x = random_matrix(spark, 80, 30, 5)
    assert "FlatMapGroupsInPandas" not in plan_of(A.binarize(m, "kmeans", bins=16).triplets)
    out = A.gram(m)
    assert "SortMergeJoin" not in plan_of(out) and "BroadcastHashJoin" not in plan_of(out)
    want = x.T @ x
    got = {(r.f1, r.f2): r.g for r in out.collect()}
    assert all(abs(want[a - 1, b - 1] - v) < 1e-9 for (a, b), v in got.items())
    assert len(got) == int((np.triu(want) > 0).sum())


def test_graphs_over_cells_deal_bounded_parts_by_number(spark):
    """Two hops shuffled what the first hop made of all values for each neighbour, sums by neighbours dealt named entries, motifs made their pairs again for each use."""
    m, x = random_matrix(spark, 40, 12, 3)
    edges = [(i, i + k, w) for i in range(1, 41) for k, w in ((3, 2.0), (7, 0.5)) if i + k <= 42]  # cells 41 and 42 are none of the matrix
    g = Graph.of(spark.createDataFrame([(f"c{a}", f"c{b}", w) for a, b, w in edges], "from_id string, to_id string, weight double"))
    a = np.eye(42)
    for i, j, w in edges:
        a[i - 1, j - 1] += w
        a[j - 1, i - 1] += w
    a = (a / a.sum(axis=1, keepdims=True))[:40, :40]
    for hops in (1, 2, 3):
        out = g.smooth(m, hops)
        plan = plan_of(out.triplets)
        assert plan.count("REPARTITION_BY_NUM") >= 2
        got = np.zeros((40, 12))
        for r in out.triplets.collect():
            got[r.row_id - 1, r.col_id - 1] = r.value
        assert np.allclose(got, np.linalg.matrix_power(a, hops) @ x)
    groups = m.cells.select("cell_id", (F.col("row_id") % 2).cast("string").alias("label"))
    sums = g.neighbour_sums(m, groups)
    w = np.zeros((40, 40))
    for i, j, v in edges:
        if j <= 40:
            w[i - 1, j - 1] = w[j - 1, i - 1] = v
    for r in sums.collect():
        of = np.array([(i + 1) % 2 == int(r.label) for i in range(40)])
        assert abs(r.nbr_sum - (x[:, int(r.feat_id[1:]) - 1] * w[:, of].sum(axis=1)).sum()) < 1e-9
    assert "REPARTITION_BY_NUM" in plan_of(g.label_proportions(groups.withColumnRenamed("cell_id", "node_id")))
