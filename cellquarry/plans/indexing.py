"""Row numbers at scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellquarry.plans.store import written


def with_row_index(df: DataFrame, order: Sequence[str | Column] = (), offset: int = 0, name: str = "row_index", within: Sequence[str] = ()) -> DataFrame:
    """Adds 1 .. n (+ offset) in the given order, or as the rows come; ``within``: restarting in each group.

    In two passes, without bringing all rows into one task: the range-sorted rows are written with
    their partition and place, partitions are counted, and each adds what stands before it. The rows
    are written because a second sort may cut its partitions elsewhere.
    """
    if within:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*within).orderBy(*(order or within))) + offset).cast("long"))
    own = df.orderBy(*order) if order else df
    indexed = written(own.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()))
    counts = sorted((r["__p"], r["count"]) for r in indexed.groupBy("__p").count().collect())  # a row for each partition
    before, start = 0, []
    for p, n in counts:
        start.append((p, before))
        before += n
    base = df.sparkSession.createDataFrame(start, "__p int, __s long")
    return indexed.join(F.broadcast(base), "__p").withColumn(name, F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__s") + 1 + offset).drop("__p", "__m", "__s")
