"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellquarry.llm.common import crc_mod, hash_sample, pieces_of, texts_of

EDGE = 0x5F  # stands for all that is not a letter


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_codes(text: str, longest: int = 3) -> np.ndarray:
    """Codes of all 1- to ``longest``-grams (3 at most) of the lower-cased words, padded at both ends."""
    point = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    is_letter = letters()[point]
    point = np.concatenate([[EDGE], np.where(is_letter, point, EDGE), [EDGE]])
    gap = point == EDGE
    keep = np.concatenate([[True], ~(gap[1:] & gap[:-1])])
    point, gap = point[keep], gap[keep]
    out = [point[~gap] << 42]
    if longest >= 2 and len(point) > 2:
        out.append((point[:-1] << 42) | (point[1:] << 21))
    if longest >= 3 and len(point) > 2:
        out.append(((point[:-2] << 42) | (point[1:-1] << 21) | point[2:])[~gap[1:-1]])
    return np.concatenate(out)


def top_grams(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties to the smaller code."""
    seen, n = np.unique(codes, return_counts=True)
    if len(seen) > size:
        cut = np.partition(n, len(n) - size)[len(n) - size]
        some = n >= cut
        seen, n = seen[some], n[some]
    return seen[np.argsort(-n, kind="stable")][:size]


class Profiles:
    """Ranks of the learned languages' n-grams."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size, self.names = size, sorted({r[0] for r in rows})
        at = {x: i for i, x in enumerate(self.names)}
        self.codes = np.array(sorted({r[1] for r in rows}), np.int64)
        self.rank = np.full((len(self.names), len(self.codes) + 1), -1, np.int64)  # the last column: n-grams of no profile
        for lang, code, rank in rows:
            self.rank[at[lang], np.searchsorted(self.codes, code)] = rank

    def predict(self, text: str, longest: int) -> tuple[str, float]:
        grams = top_grams(gram_codes(text, longest), self.size)
        if not len(grams) or not self.names:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, grams), len(self.codes) - 1)
        at = np.where(self.codes[at] == grams, at, len(self.codes))
        ranks = self.rank[:, at]
        far = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(grams)))).sum(axis=1)
        best = int(np.argmin(far))
        return self.names[best], float(1 - far[best] / (self.size * len(grams)))


def learn_profiles(rows: DataFrame, size: int = 300, longest: int = 3) -> Profiles:
    """Profiles of ``rows`` (text, lang): the ``size`` most frequent n-grams of each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, most=1 << 22):
                by: dict[str, list[np.ndarray]] = {}
                for t, lang in zip(texts_of(part), part.column("lang").to_pylist(), strict=True):
                    by.setdefault(lang, []).append(gram_codes(t, longest))
                for lang, codes in by.items():
                    seen, n = np.unique(np.concatenate(codes), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(n)], ["lang", "code", "n"])

    w = Window.partitionBy("lang").orderBy(F.col("n").desc(), "code")
    best = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size)
    return Profiles([(r.lang, r.code, r.rank - 1) for r in best.collect()], size)  # languages x size rows


def predict_language(docs: DataFrame, size: int = 300, longest: int = 3, train_rows: int = 60_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row, from its whole text.

    Profiles are fitted on about ``train_rows`` rows (the bound of the classifier's sample, chosen by
    the hash of the id) with a language, an id and crc32(id) mod 5 other than 0. Out-of-place
    distances that tie go to the name that sorts first. A null text or one without a letter is
    ``und`` with score 0, and so is every text if nothing can be learned. A null id is not held out
    and never learned from. Score: 1 - distance / largest possible distance.
    """
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"), (crc_mod(docs[id_col].cast("long"), 5) == 0).alias("held_out"))
    train = d.where("lang is not null and text is not null and not held_out").select("doc_id", "text", "lang")
    total = train.count()
    profiles = learn_profiles(hash_sample(train, "doc_id", train_rows, total).select("text", "lang"), size, longest)
    shared = d.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            for part in pieces_of(batch):
                got = [p.predict(t, longest) for t in texts_of(part)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return d.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
