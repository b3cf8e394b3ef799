"""Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellquarry.plans.store import forget, shared_dir, written  # noqa: F401


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string), whatever other columns there are."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def fresh(name: str, taken: list[str]) -> str:
    """A column name that is not taken, whatever its case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(col.cast("string").cast("binary")) % n


def hash_sample(df: DataFrame, cols: str | list[str], rows: int, total: int, seed: int = 17) -> DataFrame:
    """About ``rows`` of ``total`` rows, chosen by the hash of ``cols`` alone; all of them if there are fewer."""
    if total <= rows:
        return df
    slots = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *([cols] if isinstance(cols, str) else cols)), F.lit(slots)) < int(slots * rows / total))


def pieces_of(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    return [t or "" for t in batch.column(text).to_pylist()]
