"""Line dedup by overlapping three-line windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellquarry.llm.common import pieces_of, texts_of, written


def window_hashes(text: str, size: int) -> tuple[list[int], list[bytes]]:
    """Positions and 128-bit hashes of the runs of ``size`` lines, runs of blank lines left out."""
    lines = text.split("\n")
    blank = [not x.strip(" \t\r") for x in lines]
    at = [i for i in range(len(lines) - size + 1) if not all(blank[i : i + size])]
    return at, [hashlib.md5("\n".join(lines[i : i + size]).encode(), usedforsecurity=False).digest() for i in at]


def covered(n: int, positions: np.ndarray, size: int) -> np.ndarray:
    """Which of n lines lie in a window that starts at one of the positions."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, positions, 1)
    np.add.at(step, np.minimum(positions + size, n), -1)
    return np.cumsum(step[:n]) > 0


def repeated_positions(docs: DataFrame, size: int) -> DataFrame:
    """(id, mark, positions): starts of the windows of ``docs`` (id, mark, text) that stand earlier in some document or line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch):
                found = [window_hashes(t, size) for t in texts_of(part)]
                row = pa.array(np.repeat(np.arange(len(found)), [len(p) for p, _ in found]))
                pos = pa.array([x for p, _ in found for x in p], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("id").take(row), part.column("mark").take(row), pos, pa.array([x for _, h in found for x in h], pa.binary())], ["id", "mark", "pos", "h"])

    windows = docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, mark long, pos int, h binary")
    first = windows.groupBy("h").agg(F.min(F.struct("id", "mark", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first")
    first = written(first)  # the join below then has exchanges of its own, so hot windows can be split
    later = windows.join(first, "h").where(F.struct("id", "mark", "pos") > F.col("first"))
    return later.groupBy("id", "mark").agg(F.collect_set("pos").alias("positions"))  # rows that repeat give each place once


def dedup_lines(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with repeated passages of ``size`` consecutive lines taken out of the text; other columns and the rows stay.

    A window's first occurrence, by id and then by line, stays; lines covered by any later occurrence
    go, overlapping windows merged. Lines compare exactly; windows of blank lines never count. Texts
    of fewer lines, null texts and rows without an id stay as they are; rows that repeat both id and
    text are one document and change alike. ``n_chars``, if there is one, follows the text. With
    ``counts`` the columns n_lines and n_removed (int) are added.
    """
    names, rest = docs.columns, [c for c in docs.columns if c not in (id_col, text_col)]
    base = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("mark"), docs[text_col].alias("text"), *(docs[c].alias(f"c{i}") for i, c in enumerate(rest)))
    found = repeated_positions(base.where("id is not null and text is not null").select("id", "mark", "text"), size)
    full = base.join(found, ["id", "mark"], "left")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    at = {id_col: "id", text_col: "text"} | {c: f"c{i}" for i, c in enumerate(rest)}
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + (", n_lines int, n_removed int" if counts else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch):
                texts, lines, gone = [], [], []
                for t, p in zip(part.column("text").to_pylist(), part.column("positions").to_pylist(), strict=True):
                    own = [] if t is None else t.split("\n")
                    drop = covered(len(own), np.array(p, np.int64), size) if p else np.zeros(len(own), bool)
                    texts.append("\n".join(x for x, d in zip(own, drop, strict=True) if not d) if drop.any() else t)
                    lines.append(len(own))
                    gone.append(int(drop.sum()))
                col = {c: part.column(a) for c, a in at.items()} | {text_col: pa.array(texts, pa.string())}
                if "n_chars" in rest:
                    now = [old if not g else len(t) for old, t, g in zip(col["n_chars"].to_pylist(), texts, gone, strict=True)]
                    col["n_chars"] = pa.array(now, col["n_chars"].type)
                more = [pa.array(lines, pa.int32()), pa.array(gone, pa.int32())] if counts else []
                yield pa.RecordBatch.from_arrays([*(col[c] for c in names), *more], [*names, *(["n_lines", "n_removed"] if counts else [])])

    return full.mapInArrow(run, schema)


#: DuckDB SQL of the same over ``docs`` (doc_id, text): doc_id, text, n_lines, n_removed.
SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM {docs}),
w AS (SELECT doc_id, pos - 1 AS pos, x[pos] || chr(10) || x[pos + 1] || chr(10) || x[pos + 2] AS h
      FROM (SELECT doc_id, x, unnest(range(1, len(x) - 1)) AS pos FROM l WHERE len(x) >= 3)),
v AS (SELECT * FROM w WHERE length(trim(translate(h, chr(10) || chr(9) || chr(13), ''))) > 0),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS k FROM v),
gone AS (SELECT DISTINCT doc_id, pos + j AS line FROM r, (SELECT unnest([0, 1, 2]) AS j) WHERE k > 1),
lines AS (SELECT doc_id, unnest(x) AS line_text, unnest(range(0, len(x))) AS line FROM l),
kept AS (SELECT doc_id, string_agg(line_text, chr(10) ORDER BY line) AS text FROM lines ANTI JOIN gone USING (doc_id, line) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT l.doc_id, CASE WHEN n.n IS NULL THEN l.text ELSE coalesce(kept.text, '') END AS text,
       CAST(coalesce(len(l.x), 0) AS INTEGER) AS n_lines, CAST(coalesce(n.n, 0) AS INTEGER) AS n_removed
FROM l LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
