"""Quality classifier: naive Bayes support vectors.

Indicators of hashed n-grams are scaled by the classes' log-count ratios; a linear hinge-loss model is
then fitted to them by dual coordinate descent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellquarry.llm.common import crc_mod, hash_sample, id_text, pieces_of, texts_of
from cellquarry.llm.textkit import Words, mix

BITS = 18


def run_sizes(most: int) -> list[int]:
    """3 and, from 4 on, four sizes in each doubling, up to ``most``."""
    return [n for n in [3, *(m << j for j in range(max(most, 1).bit_length()) for m in (4, 5, 6, 7))] if n <= most]


def indicators(texts: list[str], bits: int = BITS) -> list[np.ndarray]:
    """Sorted distinct hashed features of each text: words, word pairs, 3-grams of bytes and runs of one word.

    Beside the n-grams proper stand skeleton n-grams, which tell only that words repeat: a text whose longest run of one word has n words has those
    of run_sizes(n) words, whatever the word.
    """
    raw = [t.encode() for t in texts]
    words = Words(raw)
    out, shift = [], np.uint64(64 - bits)
    single = mix(words.hash ^ np.uint64(1)) >> shift
    pair, at = words.shingles(2)
    pair = pair >> shift
    same = np.concatenate([[False], (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])])[: len(words.hash)]
    place = np.arange(len(same))
    length = place - np.maximum.accumulate(np.where(same, 0, place)) + 1 if len(same) else place
    pair_first = np.searchsorted(words.doc[at], np.arange(len(raw) + 1))
    for i, b in enumerate(raw):
        data = np.frombuffer(b, np.uint8).astype(np.uint64)
        tri = mix((data[:-2] << np.uint64(16)) | (data[1:-1] << np.uint64(8)) | data[2:] | np.uint64(1 << 40)) >> shift if len(data) > 2 else data[:0]
        one = single[words.first[i] : words.first[i + 1]]
        most = int(length[words.first[i] : words.first[i + 1]].max(initial=0))
        runs = mix(np.array(run_sizes(most), np.uint64) + np.uint64(1 << 41)) >> shift
        out.append(np.unique(np.concatenate([one, runs, pair[pair_first[i] : pair_first[i + 1]], tri])).astype(np.int32))
    return out


def fit(features: list[np.ndarray], labels: np.ndarray, bits: int = BITS, c: float = 1.0, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights by hashed feature, the last one the intercept, and the squares of the log-count ratios. One class only: an intercept of its sign."""
    size, y = 1 << bits, np.where(labels > 0, 1.0, -1.0)
    weight = np.zeros(size + 1)
    if len(set(y.tolist())) < 2:
        weight[-1] = y[0] if len(y) else 0.0
        return weight, np.zeros(size)
    count = {s: np.ones(size) for s in (1.0, -1.0)}
    for f, s in zip(features, y, strict=True):
        count[s][f] += 1
    ratio = np.log(count[1.0] / count[1.0].sum()) - np.log(count[-1.0] / count[-1.0].sum())
    norms = np.array([max(np.sqrt((ratio[f] ** 2).sum()), 1e-9) for f in features])
    values = [ratio[f] / n for f, n in zip(features, norms, strict=True)]  # unit length
    alpha, bias, rng = np.zeros(len(y)), 0.0, np.random.default_rng(seed)
    w = weight[:size]
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            f, v = features[i], values[i]
            gradient = y[i] * (w[f] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / 2, 0.0), c)  # |x|^2 with the intercept is 2
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    weight[:size] = w * ratio
    weight[-1] = bias
    return weight, ratio**2


def score_texts(texts: list[str], weight: np.ndarray, ratio_norm: np.ndarray, bits: int = BITS) -> list[float]:
    out = []
    for f in indicators(texts, bits):
        n = max(np.sqrt(ratio_norm[f].sum()), 1e-9)
        out.append(float(1 / (1 + np.exp(-2 * (weight[f].sum() / n + weight[-1])))))
    return out


def learn_quality(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, train_bytes: int = 128 << 20, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The model, fitted in one task on labelled rows: ``train_rows`` of them, about, and so many that their features take ``train_bytes`` (the bounds of the classifier's sample).

    Rows are taken by the hash of their id. Rows with a null id or a quality other than 0 and 1 take no part; of several labels of an id the least
    counts, and of several texts the least, so that an id that repeats on and on does not outgrow the bounds.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
    known = known.where(crc_mod(F.col("doc_id"), 3) != 1).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = hash_sample(known, "doc_id", train_rows, known.count())
    own = id_text(docs, id_col, text_col).join(F.broadcast(some), "doc_id")  # about train_rows ids of 12 bytes
    sizes = own.groupBy("doc_id", "quality").agg(F.max(F.least(F.coalesce(F.octet_length("text"), F.lit(0)) * 2, F.lit(1 << bits)) * 4).alias("n"))  # bytes of features, at most
    sized = sizes.orderBy(F.xxhash64(F.lit(23), "doc_id"), "doc_id").collect()  # about train_rows rows
    upto = np.cumsum([r.n for r in sized])
    taken = [(r.doc_id, r.quality) for r, n in zip(sized, upto.tolist(), strict=True) if n <= train_bytes]
    ids = docs.sparkSession.createDataFrame(taken, "doc_id long, quality int")
    rows = id_text(docs, id_col, text_col).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch):
                found = [f.tobytes() for f in indicators(texts_of(part), bits)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(found, pa.binary())], ["doc_id", "y", "f"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, y, f) for b in batches for i, y, f in zip(b.column("doc_id").to_pylist(), b.column("y").to_pylist(), b.column("f").to_pylist(), strict=True))
        weight, squares = fit([np.frombuffer(f, np.int32) for _, _, f in rows], np.array([y for _, y, _ in rows]), bits)
        yield pa.RecordBatch.from_arrays([pa.array([weight.tobytes()], pa.binary()), pa.array([squares.tobytes()], pa.binary())], ["weight", "squares"])

    model = rows.mapInArrow(features, "doc_id long, y int, f binary").repartition(1).mapInArrow(train, "weight binary, squares binary").collect()[0]
    return np.frombuffer(model.weight), np.frombuffer(model.squares)


def score_quality(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row, from its whole text.

    Learns from labelled rows whose crc32(id) mod 3 is not 1 only. A null text counts as empty and gets
    the intercept's score; without labelled rows every score is 0.5. A null id is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn_quality(docs, labels, train_rows, bits=bits, id_col=id_col, text_col=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, squares = shared.value
        for batch in batches:
            for part in pieces_of(batch):
                s = score_texts(texts_of(part), weight, squares, bits)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    d = id_text(docs, id_col, text_col).withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)))
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, train_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose whole text scores ``least`` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(learn_quality(docs, labels, train_rows, id_col=id_col, text_col=text_col))
    schema, text_at = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, squares = shared.value
        for batch in batches:
            for part in pieces_of(batch, text_at):
                yield part.filter(pa.array([s >= least for s in score_texts(texts_of(part, text_at), weight, squares)], pa.bool_()))

    return docs.mapInArrow(run, schema)
