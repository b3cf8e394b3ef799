"""Tables written to cut lineage, in the folder that all executors share."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Frees what was shuffled for an action once the action is over.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writing: dict[int, list] = {}  # session: how many writes are under way, and the setting before the first


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, one below the warehouse, which is then the checkpoint folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside go at once; the session's setting for that is put back when the last of several concurrent uses ends."""
    conf, key = spark.conf, id(spark._jsparkSession)
    with _lock:
        held = _writing.setdefault(key, [0, conf.get(CLEAN_UP, None)])
        held[0] += 1
        conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                del _writing[key]
                conf.set(CLEAN_UP, held[1]) if held[1] is not None else conf.unset(CLEAN_UP)


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes the rows to a Parquet table in the shared folder and reads them back.

    The table goes with forget(), or when the driver's JVM ends. The shuffle files behind it go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    at, fs = _path(spark, path)
    with cleaned_up(spark):
        df.select("*").write.parquet(path)
        fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what written() stored, once nothing reads it any more."""
    path = getattr(df, "_written_path", None)
    if path:
        at, fs = _path(df.sparkSession, path)
        fs.delete(at, True)
        fs.cancelDeleteOnExit(at)
