"""Graphs: edges and nodes as DataFrames, views by vertex, and statistics along edges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellquarry.operators.matrix import Matrix
from cellquarry.plans.indexing import with_row_index
from cellquarry.plans.rules import keep_ids, partitions
from cellquarry.plans.store import written


@dataclass(frozen=True)
class Graph:
    """``edges`` (from_id, to_id, weight); undirected edges stand once. ``nodes`` (node_id) keeps isolated ones; ``picked``: selected vertices."""

    edges: DataFrame
    nodes: DataFrame
    directed: bool = False
    picked: DataFrame | None = None

    @classmethod
    def of(cls, edges: DataFrame, nodes: DataFrame | None = None, directed: bool = False, from_col: str = "from_id", to_col: str = "to_id", weight_col: str | None = "weight") -> Graph:
        e = edges.select(F.col(from_col).alias("from_id"), F.col(to_col).alias("to_id"), (F.col(weight_col).cast("double") if weight_col in edges.columns else F.lit(1.0)).alias("weight"))
        return cls(e, nodes if nodes is not None else e.select(F.col("from_id").alias("node_id")).union(e.select("to_id")).distinct(), directed)

    @classmethod
    def from_neighbours(cls, nn: DataFrame, directed: bool = True) -> Graph:
        """Rows of (id, neighbours array, distances array) as edges; weight = 1 / (1 + distance)."""
        e = nn.select("id", F.explode(F.arrays_zip("neighbours", "distances")).alias("x")).select(F.col("id").alias("from_id"), F.col("x.neighbours").alias("to_id"), (1 / (1 + F.col("x.distances"))).alias("weight"))
        return cls(e, nn.select(F.col("id").alias("node_id")), directed)

    def _flags(self, col: str, ids: Sequence | DataFrame, name: str) -> tuple[DataFrame, str]:
        other = ids.select(F.col(ids.columns[0]).alias(f"__{name}")).distinct() if isinstance(ids, DataFrame) else self.edges.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], f"__{name} {self.edges.schema['from_id'].dataType.simpleString()}")
        return other, f"__{name}"

    def _marked(self, marks: dict[str, tuple[str, Sequence | DataFrame]]) -> DataFrame:
        out = self.edges
        for name, (col, ids) in marks.items():
            other, key = self._flags(col, ids, name)
            out = out.join(other, out[col] == other[key], "left").withColumn(name, F.col(key).isNotNull()).drop(key)
        return out

    def induced(self, ids: Sequence | DataFrame, negate: bool = False) -> Graph:
        """Edges with both ends among the ids (negated: the rest of the edges); the vertices stay selected, isolated ones too."""
        e = self._marked({"a": ("from_id", ids), "b": ("to_id", ids)})
        keep = F.col("a") & F.col("b")
        base = self.picked if self.picked is not None else self.nodes.select("node_id")
        return replace(self, edges=e.where(~keep if negate else keep).drop("a", "b"), picked=keep_ids(base, "node_id", ids, negate))

    def slice(self, a: Sequence | DataFrame, b: Sequence | DataFrame) -> Graph:
        """Edges from a to b; either way round if undirected."""
        marks = {"fa": ("from_id", a), "tb": ("to_id", b)} | ({} if self.directed else {"fb": ("from_id", b), "ta": ("to_id", a)})
        keep = F.col("fa") & F.col("tb")
        return replace(self, edges=self._marked(marks).where(keep if self.directed else keep | (F.col("fb") & F.col("ta"))).drop(*marks))

    def endpoint(self, ids: Sequence | DataFrame) -> Graph:
        """Edges that end in the ids (undirected: at either side)."""
        marks = {"t": ("to_id", ids)} | ({} if self.directed else {"f": ("from_id", ids)})
        return replace(self, edges=self._marked(marks).where(F.col("t") if self.directed else F.col("t") | F.col("f")).drop(*marks))

    def vertices(self) -> DataFrame:
        """Selected vertices, or those that edges use."""
        used = self.edges.select(F.col("from_id").alias("node_id")).union(self.edges.select("to_id")).distinct()
        return self.picked if self.picked is not None else used

    def counts(self) -> tuple[int, int]:
        return self.edges.count(), self.vertices().count()

    def materialise(self) -> tuple[DataFrame, DataFrame]:
        """(nodes (id, node_id), edges (from, to, weight)): the view's vertices numbered 1 .. n in order, selected ones without edges included."""
        nodes = with_row_index(self.vertices().select("node_id").distinct(), ["node_id"], name="id").select("id", "node_id")
        own = self.edges.join(nodes.select(F.col("id").alias("from"), F.col("node_id").alias("from_id")), "from_id").join(nodes.select(F.col("id").alias("to"), F.col("node_id").alias("to_id")), "to_id")
        return nodes, own.select("from", "to", "weight")

    def relabel(self, names: DataFrame) -> Graph:
        """Node ids replaced by names (node_id, name); edges and nodes without a name are an error."""
        own = names.select(F.col("node_id").alias("__id"), F.col("name").alias("__name"))
        if self.nodes.join(own, self.nodes["node_id"] == own["__id"], "left_anti").limit(1).count():
            raise ValueError("every node needs a name")
        to = lambda d, c: d.join(own, d[c] == own["__id"]).withColumn(c, F.col("__name")).drop("__id", "__name")
        return replace(self, edges=to(to(self.edges, "from_id"), "to_id").select("from_id", "to_id", "weight"), nodes=to(self.nodes, "node_id"), picked=to(self.picked, "node_id") if self.picked is not None else None)

    def to_pandas(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Vertices and edges (from, to, weight) as tables on the driver."""
        return self.vertices().toPandas(), self.edges.select(F.col("from_id").alias("from"), F.col("to_id").alias("to"), "weight").toPandas()

    def both_ways(self, loops: float = 0.0, weighted: bool = True) -> DataFrame:
        """(node, other, w) in both directions, with self loops of weight ``loops``."""
        w = F.col("weight") if weighted else F.lit(1.0)
        out = self.edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("other"), w.alias("w")).unionByName(self.edges.select(F.col("to_id").alias("node"), F.col("from_id").alias("other"), w.alias("w")))
        return out.unionByName(self.nodes.select(F.col("node_id").alias("node"), F.col("node_id").alias("other"), F.lit(float(loops)).alias("w"))) if loops else out

    def degree(self, weighted: bool = False) -> DataFrame:
        got = self.both_ways(weighted=weighted).groupBy("node").agg(F.sum("w").alias("degree"))
        return self.nodes.select(F.col("node_id").alias("node")).join(got, "node", "left").na.fill(0.0, ["degree"])

    def label_proportions(self, labels: DataFrame, alpha: float = 1.0, weighted: bool = False, wide: Sequence[str] | None = None) -> DataFrame:
        """(node, label, prop) of the neighbours' labels (node_id, label); unlabelled ones are a null label. ``wide``: labels as columns."""
        own = replace(self, edges=written(self.edges))  # read for both directions; its size tells how many partitions bound a task
        tasks = 2 * partitions(own.edges)
        out = own.both_ways(alpha, weighted).repartition(tasks, "other").join(labels.select(F.col("node_id").alias("other"), "label"), "other", "left")
        out = out.repartition(tasks, "node").groupBy("node", "label").agg(F.sum("w").alias("w"))
        out = out.select("node", "label", F.try_divide("w", F.sum("w").over(Window.partitionBy("node"))).alias("prop"))
        return out if wide is None else out.groupBy("node").pivot("label", list(wide)).agg(F.sum("prop")).na.fill(0.0)

    def pairs(self) -> DataFrame:
        """(a, b, w), a < b: one row for each pair of view vertices; mutual directed edges average."""
        own = self.edges.where("from_id != to_id")
        if self.picked is not None:
            own = keep_ids(keep_ids(own, "from_id", self.picked), "to_id", self.picked)
        return own.groupBy(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).agg(F.avg("weight").alias("w"))

    def edge_products(self, m: Matrix) -> DataFrame:
        """(feat_id, edge_prod): sums over pairs of w * v_a * v_b."""
        ids = m.cells.select("cell_id", "row_id")
        own = self.pairs().join(ids.withColumnsRenamed({"cell_id": "a", "row_id": "ra"}), "a").join(ids.withColumnsRenamed({"cell_id": "b", "row_id": "rb"}), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"), "w")  # triplets meet by number, not by name
        a, b = (m.triplets.select(F.col("row_id").alias(k), "col_id", F.col("value").alias(f"v{k}")) for k in "ab")
        got = own.join(a, "a").join(b, ["b", "col_id"]).groupBy("col_id").agg(F.sum(F.col("w") * F.col("va") * F.col("vb")).alias("edge_prod"))
        return m.feats.join(got, "col_id", "left").na.fill(0.0, ["edge_prod"]).select("feat_id", "edge_prod")

    def edge_statistics(self, m: Matrix) -> tuple[DataFrame, DataFrame]:
        """By feature: sum .. sum4, deg_sum, deg_sumsq, edge_prod; of the graph: n_cells, n_edges, sum_w, sum_w2, sum_deg2."""
        p = self.pairs()
        deg = p.select(F.col("a").alias("cell_id"), "w").union(p.select("b", "w")).groupBy("cell_id").agg(F.sum("w").alias("deg"))
        own = m.accumulate("feat", ["sum", "sumsq", "sum3", "sum4"])
        v = m.triplets.join(m.cells, "row_id").join(deg, "cell_id").groupBy("col_id").agg(F.sum(F.col("deg") * F.col("value")).alias("deg_sum"), F.sum(F.col("deg") * F.col("value") * F.col("value")).alias("deg_sumsq"))
        feats = own.join(v, "col_id", "left").na.fill(0.0).join(self.edge_products(m), "feat_id").drop("col_id")
        whole = p.agg(F.count("*").alias("n_edges"), F.sum("w").alias("sum_w"), F.sum(F.col("w") * F.col("w")).alias("sum_w2")).crossJoin(deg.agg(F.sum(F.col("deg") * F.col("deg")).alias("sum_deg2"))).crossJoin(m.cells.agg(F.count("*").alias("n_cells")))
        return feats, whole

    def neighbour_sums(self, m: Matrix, groups: DataFrame) -> DataFrame:
        """(feat_id, label, nbr_sum): sums over cells of value times the weight of their edges into the group."""
        p = self.pairs()
        both = p.select(F.col("a").alias("cell_id"), F.col("b").alias("other"), "w").union(p.select("b", "a", "w"))
        into = both.join(groups.select(F.col("cell_id").alias("other"), "label"), "other").groupBy("cell_id", "label").agg(F.sum("w").alias("w"))
        into = into.join(m.cells.select("cell_id", "row_id"), "cell_id").select("row_id", "label", "w")  # triplets meet by number, not by name
        got = m._by_cell(m.triplets).join(into, "row_id").groupBy("col_id", "label").agg(F.sum(F.col("value") * F.col("w")).alias("nbr_sum"))
        return got.join(m.feats, "col_id").select("feat_id", "label", "nbr_sum")

    def group_edges(self, groups: DataFrame) -> DataFrame:
        """(k, l, w): edge weight between groups, both directions."""
        p = self.pairs()
        both = p.select("a", "b", "w").union(p.select("b", "a", "w"))
        return both.join(groups.select(F.col("cell_id").alias("a"), F.col("label").alias("k")), "a").join(groups.select(F.col("cell_id").alias("b"), F.col("label").alias("l")), "b").groupBy("k", "l").agg(F.sum("w").alias("w"))

    def group_paths(self, groups: DataFrame) -> DataFrame:
        """(k, l, m, w): sums over cells i of group k of a_il * a_im, a_il its edge weight into group l."""
        p = self.pairs()
        both = p.select(F.col("a").alias("cell_id"), F.col("b").alias("other"), "w").union(p.select("b", "a", "w"))
        into = both.join(groups.select(F.col("cell_id").alias("other"), F.col("label").alias("l")), "other").groupBy("cell_id", "l").agg(F.sum("w").alias("w"))
        other = into.select("cell_id", F.col("l").alias("m"), F.col("w").alias("w2"))
        return into.join(other, "cell_id").join(groups.select("cell_id", F.col("label").alias("k")), "cell_id").groupBy("k", "l", "m").agg(F.sum(F.col("w") * F.col("w2")).alias("w"))

    def smooth(self, m: Matrix, hops: int = 1, self_weight: float = 1.0, weighted: bool = True) -> Matrix:
        """Each cell's values averaged with its neighbours' (weights scaled to 1 with itself at ``self_weight``), ``hops`` times."""
        ids = m.cells.select("cell_id", "row_id")
        own = self.edges.join(ids.withColumnsRenamed({"cell_id": "from_id", "row_id": "i"}), "from_id", "left").join(ids.withColumnsRenamed({"cell_id": "to_id", "row_id": "j"}), "to_id", "left")  # an end that is no cell counts in the weights of the other
        own = written(own.select("i", "j", (F.col("weight") if weighted else F.lit(1.0)).alias("w")))  # edges by number, read for both directions
        tasks = 2 * partitions(own)
        both = own.select(F.col("i").alias("to"), F.col("j").alias("row_id"), "w").unionByName(own.select(F.col("j").alias("to"), F.col("i").alias("row_id"), "w"))
        both = both.unionByName(ids.select(F.col("row_id").alias("to"), "row_id", F.lit(float(self_weight)).alias("w")))
        both = both.where("to is not null").repartition(tasks, "to").groupBy("to", "row_id").agg(F.sum("w").alias("w"))
        op = both.select("to", "row_id", (F.col("w") / F.sum("w").over(Window.partitionBy("to"))).alias("w")).where("row_id is not null")
        if hops > 1:  # neighbourhoods overlap, so the weights over all hops are fewer than the values that each hop would make
            op = one = written(op)
            for _ in range(hops - 1):
                far = one.select(F.col("to").alias("mid"), F.col("row_id").alias("last"), F.col("w").alias("v")).repartition(tasks, "mid")
                op = op.repartition(tasks, "row_id").join(far, F.col("row_id") == F.col("mid")).repartition(4 * tasks, "to").groupBy("to", "last").agg(F.sum(F.col("w") * F.col("v")).alias("w")).withColumnRenamed("last", "row_id")
        tasks = 4 * tasks * hops
        t = m.triplets.repartition(tasks, "row_id").join(op.repartition(tasks, "row_id"), "row_id").select("to", "col_id", (F.col("w") * F.col("value")).alias("value")).repartition(tasks, "to")
        t = t.groupBy("to", "col_id").agg(F.sum("value").alias("value")).where("value != 0").select(F.col("to").alias("row_id"), "col_id", "value")
        return replace(m, triplets=t, log_=(*m.log_, "smooth"))

    def motifs(self, labels: DataFrame) -> DataFrame:
        """(motif, labels, n): triangles and open wedges (middle label second) by label (node_id, label), among labelled nodes.

        Triangles are listed from their end of least degree, so no node lists over sqrt(2 edges) ends.
        Wedges are counted from each node's neighbours by label, less those that triangles close. With a column ``perm`` in the labels
        the motifs are counted for each of its values.
        """
        by = ["perm"] if "perm" in labels.columns else []
        p = written(self.pairs().select("a", "b"))  # read five times
        both = p.union(p.select("b", "a"))
        degree = both.groupBy("a").agg(F.count("*").alias("d"))
        up = both.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("e")), "b").where(F.struct("d", "a") < F.struct("e", "b")).select(F.col("a").alias("x"), F.col("b").alias("y"), F.struct("e", "b").alias("place"))
        up = written(up)  # read twice
        lab = lambda name: labels.select(F.col("node_id").alias(name), F.col("label").alias(f"l{name}"), *by)
        two = up.join(up.select("x", F.col("y").alias("z"), F.col("place").alias("beyond")), "x").where("place < beyond")
        closed = two.join(both.select(F.col("a").alias("y"), F.col("b").alias("z")), ["y", "z"], "left_semi").select("x", "y", "z")
        tri = closed.join(lab("x"), "x").join(lab("y"), ["y", *by]).join(lab("z"), ["z", *by])
        tri = tri.groupBy(*by, F.array_sort(F.array("lx", "ly", "lz")).alias("ls")).agg(F.count("*").alias("n"))
        near = both.select(F.col("a").alias("m"), F.col("b").alias("x")).join(lab("x"), "x").groupBy("m", *by, "lx").agg(F.count("*").alias("c"))
        pairs = near.join(near.select("m", *by, F.col("lx").alias("ly"), F.col("c").alias("c2")), ["m", *by]).where("lx <= ly").join(lab("m"), ["m", *by])
        every = pairs.select(*by, "lx", "lm", "ly", F.when(F.col("lx") == F.col("ly"), F.expr("c * (c - 1) div 2")).otherwise(F.col("c") * F.col("c2")).alias("n"))
        turns = F.explode(F.array(*(F.struct(F.get("ls", F.lit(i)).alias("lx"), F.get("ls", F.lit(m)).alias("lm"), F.get("ls", F.lit(j)).alias("ly")) for i, m, j in ((1, 0, 2), (0, 1, 2), (0, 2, 1)))))
        less = tri.select(*by, turns.alias("w"), "n").select(*by, "w.*", (-F.col("n")).alias("n"))
        wedges = every.unionByName(less).groupBy(*by, F.concat_ws("-", "lx", "lm", "ly").alias("labels")).agg(F.sum("n").alias("n")).where("n > 0")
        return tri.select(*by, F.lit("triangle").alias("motif"), F.array_join("ls", "-").alias("labels"), "n").unionByName(wedges.select(*by, F.lit("wedge").alias("motif"), "labels", "n"))

    def motif_enrichment(self, labels: DataFrame, n_perm: int = 100, seed: int = 1234) -> DataFrame:
        """(motif, labels, n, mean, sd, z, p): counts against those of ``n_perm`` permutations of the labels among the labelled nodes.

        A permutation gives the i-th node the label of the node that is i-th by a seeded hash. p: share of permutations, the
        observed one among them, with at least as many.
        """
        own = written(with_row_index(labels.where("label is not null").select("node_id", "label").distinct(), ["node_id"], name="i").select("i", "node_id", "label"))
        dealt = own.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_perm))))
        order = Window.partitionBy("perm").orderBy(F.xxhash64(F.lit(seed), "perm", "node_id"), "node_id")
        turned = dealt.select("perm", "label", F.row_number().over(order).cast("long").alias("i")).join(own.select("i", "node_id"), "i").select("perm", "node_id", "label")
        counts = self.motifs(turned.unionByName(own.select(F.lit(0).alias("perm"), "node_id", "label")))
        counts = written(counts)
        seen = counts.where("perm = 0").select("motif", "labels", F.col("n").alias("observed"))
        each = counts.where("perm > 0").join(seen, ["motif", "labels"], "full").groupBy("motif", "labels", F.coalesce("observed", F.lit(0)).alias("n"))
        out = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s"), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("q"), F.sum((F.col("n") >= F.coalesce("observed", F.lit(0))).cast("int")).alias("above"), F.count("n").alias("k"))
        mean, zeros = F.col("s") / n_perm, F.when(F.col("n") == 0, n_perm - F.col("k")).otherwise(0)
        sd = F.sqrt(F.greatest(F.col("q") / n_perm - mean * mean, F.lit(0.0)))
        return out.select("motif", "labels", "n", mean.alias("mean"), sd.alias("sd"), F.try_divide(F.col("n") - mean, sd).alias("z"), ((F.coalesce("above", F.lit(0)) + zeros + 1) / (n_perm + 1)).alias("p"))
