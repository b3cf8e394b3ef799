"""Extensions beyond bounded batches: event-time windows and running accumulators over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, ts: str, size: str, slide: str | None = None, keys: tuple[str, ...] = (), value: str = "value", late: str | None = None) -> DataFrame:
    """Counts and sums by tumbling (or sliding) window and keys; on a stream ``late`` bounds how long state is kept."""
    e = events.withWatermark(ts, late) if late and events.isStreaming else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return e.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """Counts by session of each key; a session ends after ``gap`` without events."""
    e = events.withWatermark(ts, late) if late and events.isStreaming else events
    return e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def accumulate_stream(triplets: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Sums of a stream of triplets by feature: every micro-batch appends its partial sums under its own id (so a repeated batch replaces itself), read back by partial_sums()."""

    def step(batch: DataFrame, batch_id: int) -> None:
        part = batch.groupBy("col_id").agg(F.sum("value").alias("sum"), F.sum(F.col("value") * F.col("value")).alias("sumsq"), F.count("*").alias("nnz"))
        part.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return triplets.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def partial_sums(df: DataFrame) -> DataFrame:
    return df.groupBy("col_id").agg(F.sum("sum").alias("sum"), F.sum("sumsq").alias("sumsq"), F.sum("nnz").alias("nnz"))
