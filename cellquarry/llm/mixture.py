"""Mixing sources to target weights: hierarchical budgets over a domain-language-source tree."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellquarry.llm.bpecount import merger, split_patterns
from cellquarry.llm.common import pieces_of, texts_of, written
from cellquarry.plans.rules import small

NONE = "(none)"  # stands for a null name
LEAF = ["d", "l", "s"]


def spread(nodes: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Shares ``b`` of the parents' budgets ``up`` for ``nodes`` (parent columns, key, w, room, up), by weight.

    What a node has no room for goes to its siblings by their weights: by rising room / weight nodes are filled as long
    as what is left holds; from the first that isn't, all get their weight times one level.
    """
    by = Window.partitionBy(*parent).orderBy(F.col("room") / F.col("w"), key)
    before = F.coalesce(F.sum("room").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("up") - before) / F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    own = nodes.where("w > 0 and room > 0").withColumn("level", level).withColumn("full", F.col("room") / F.col("w") <= F.col("level"))
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy(*parent))
    return own.withColumn("b", F.when(F.col("full"), F.col("room")).otherwise(F.greatest(common * F.col("w"), F.lit(0.0)))).drop("level", "full", "up")


def budgets(supply: DataFrame, share: float, weights: Mapping[tuple, float], most_epochs: int) -> DataFrame:
    """(d, l, s, n, budget long) for the leaves of ``supply`` (d, l, s, n: tokens); leaves that get nothing may be left out.

    ``weights`` has relative weights of nodes, by path (domain,), (domain, language) or the whole leaf; 1 where
    none is given. A node takes its share of its parent's budget, bounded by what all its leaves have in
    ``most_epochs`` epochs, so a shortage goes to siblings first and reaches an ancestor's siblings only when no
    sibling has room. The root's budget is ``share`` of all tokens. Every step is a plan over the tree's nodes; none come to the driver.
    """
    spark = supply.sparkSession
    now = supply.agg((F.least(F.lit(float(share)), F.lit(float(most_epochs))) * F.sum("n")).alias("b")).withColumn("root", F.lit(0))
    for depth in range(1, 4):
        path, parent = LEAF[:depth], LEAF[: depth - 1] or ["root"]
        given = [(*k, float(w)) for k, w in weights.items() if len(k) == depth]
        w = spark.createDataFrame(given, ", ".join(f"{c} string" for c in path) + ", w double")
        own = supply.groupBy(*path).agg((F.sum("n").cast("double") * most_epochs).alias("room"), F.sum("n").alias("n")).withColumn("root", F.lit(0))
        own = own.join(small(w, len(given)), path, "left").na.fill(1.0, ["w"]).join(now.select(*parent, F.col("b").alias("up")), parent)
        now = spread(own, parent, path[-1])
    return now.select(*LEAF, "n", F.floor(F.col("b") + 1e-6).cast("long").alias("budget"))


def counted(docs: DataFrame, tokenizer_path: str | None) -> DataFrame:
    """``docs`` (d, l, s, id, mark, text) with the tokens ``n`` of the text in its place."""
    if tokenizer_path is None:
        return docs.withColumn("n", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")).drop("text")

    patterns = split_patterns(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(tokenizer_path, patterns)
        for batch in batches:
            for part in pieces_of(batch):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*LEAF, "id", "mark")), pa.array(np.array(m.counts(texts_of(part)), np.int64))], [*LEAF, "id", "mark", "n"])

    return docs.mapInArrow(run, "d string, l string, s string, id long, mark long, n long")


def mix_sources(
    docs: DataFrame,
    domain: Column,
    weights: Mapping[tuple, float] | None = None,
    share: float = 1.0,
    most_epochs: int = 2,
    seed: int = 11,
    tokenizer_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    details: bool = False,
) -> DataFrame:
    """Rows of ``docs`` mixed to target weights; a row comes once for each epoch in which its leaf takes it.

    The budget is ``share`` of all tokens: those of the byte-level BPE file ``tokenizer_path``, counted once, or words between
    white space. A leaf reads its rows in an order seeded by epoch, whole epochs first and of the last one the
    shortest prefix that reaches its budget. Null names are leaves of their own; a null text has no tokens and
    comes with its leaf's prefix; a leaf without tokens gives no rows, an empty table none. Rows that repeat an id and text
    follow each other in the order; if the prefix ends among them, it takes the least (as JSON) as often as it needs. With
    ``details`` the columns domain, n_tokens and epoch are added, and columns of ``docs`` with these names are left out.
    """
    slots = {"d": domain, "l": docs[lang_col], "s": docs[source_col]}
    added = ("domain", "n_tokens", "epoch") if details else ()
    keep = [c for c in docs.columns if c.lower() not in added]
    key_of = [*(F.coalesce(c.cast("string"), F.lit(NONE)).alias(k) for k, c in slots.items()), F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(docs[text_col]).alias("mark")]
    each = counted(docs.select(*key_of, docs[text_col].cast("string").alias("text")), tokenizer_path)
    thin = written(each.groupBy(*LEAF, "id", "mark").agg(F.max("n").alias("n"), F.count("*").alias("m")))
    supply = written(thin.groupBy(*LEAF).agg(F.sum(F.col("n") * F.col("m")).alias("n")).where("n > 0"))
    plan = written(budgets(supply, share, weights or {}, most_epochs).where("budget > 0").select(*LEAF, F.expr("budget div n").alias("whole"), F.expr("budget % n").alias("rest")))
    leaves, rows = plan.count(), thin.count()
    bits = max(0, min(30, (rows // 1000).bit_length()))
    order = F.xxhash64(F.lit(seed), "whole", "id", "mark")
    part = thin.join(small(plan.where("rest > 0"), leaves), LEAF).withColumn("key", order)
    part = part.withColumn("slot", F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits) if bits else F.lit(0))
    by_slot = Window.partitionBy(*LEAF).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("n") * F.col("m")
    last = part.groupBy(*LEAF, "slot", "rest").agg(F.sum(n).alias("sum")).withColumn("upto", F.sum("sum").over(by_slot)).where("upto >= rest and upto - sum < rest").select(*LEAF, "slot", (F.col("upto") - F.col("sum")).alias("before"))
    inside = Window.partitionBy(*LEAF).orderBy("key", "id", "mark").rowsBetween(Window.unboundedPreceding, 0)
    ends = part.join(small(last, leaves), [*LEAF, "slot"]).withColumn("before", F.col("before") + F.sum(n).over(inside) - n).where("before < rest")  # one slot of each leaf: about a thousand different rows
    ends = ends.groupBy(*LEAF).agg(F.max_by(F.struct("key", "id", "mark", "m", F.ceil(F.try_divide(F.col("rest") - F.col("before"), F.col("n"))).alias("j")), F.struct("key", "id", "mark")).alias("e"))
    plan = written(plan.join(small(ends, leaves), LEAF, "left").select(*LEAF, "whole", "e.*"))  # key, id, mark: the last row of the prefix; m times it stands there, j times it is taken
    ended = plan.select(*LEAF, "whole", *(F.col(c).alias(f"e_{c}") for c in ("key", "id", "mark", "m", "j")))
    taken = docs.select(F.struct(*(docs[c] for c in keep)).alias("row"), *key_of).join(small(ended, leaves), LEAF).withColumn("key", order)
    here, end = F.struct("key", "id", "mark"), F.struct(F.col("e_key").alias("key"), F.col("e_id").alias("id"), F.col("e_mark").alias("mark"))
    in_prefix = F.col("e_key").isNotNull() & ((here < end) | ((here == end) & (F.col("e_j") == F.col("e_m"))))
    copies = (F.col("whole") + F.coalesce(in_prefix, F.lit(False)).cast("long")).cast("int")
    out = taken.withColumn("copies", copies).where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("row", *LEAF, "id", "mark", "epoch")
    if plan.where("j < m").limit(1).count():
        some = taken.where((here == end) & (F.col("e_j") < F.col("e_m"))).groupBy(*LEAF, "id", "mark", "whole", "e_j").agg(F.min_by("row", F.to_json("row")).alias("row"))
        out = out.unionByName(some.select("row", *LEAF, "id", "mark", F.explode(F.array_repeat(F.col("whole").cast("int"), F.col("e_j").cast("int"))).alias("epoch")))
    names = [F.col("row").getField(c).alias(c) for c in keep]
    if not details:
        return out.select(*names)
    return out.join(thin.select(*LEAF, "id", "mark", "n"), [*LEAF, "id", "mark"]).select(*names, F.col("d").alias("domain"), F.col("n").alias("n_tokens"), "epoch")
