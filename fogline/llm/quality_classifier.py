"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams are scaled by the log ratio of their smoothed counts in good and bad documents, and a linear
hinge-loss model over the scaled indicators is fitted by dual coordinate descent. The counts cover all labelled rows and are
summed by Spark; the descent runs on a bounded sample of them. A score is a logistic function of the margin.

N-grams are hashed into ``BUCKETS`` columns: words and word pairs, byte trigrams, and runs of one to three word shapes (small
letters, capitals, marks, digits, a repeat of the word before).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogline.llm import _text as X

BUCKETS = 1 << 16
#: Labelled rows of each class that the descent sees; the counts see all.
SAMPLE_ROWS = 2000
SMOOTHING, PENALTY, EPOCHS = 1.0, 0.1, 12
U = np.uint64


@dataclass(frozen=True, eq=False)
class Model:
    """Weight of every bucket for documents scaled to unit length, with the log-count ratios folded in."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A small code per word: which kinds of bytes it holds, and whether it repeats the word before."""
    kind = np.zeros(256, dtype=np.uint8)
    kind[ord("a") : ord("z") + 1] = 1
    kind[128:] = 1
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 4
    kind[[ord(c) for c in ".,;:'\"()-?"]] = 8
    kind[(kind == 0)] = 16
    flags = np.bitwise_or.reduceat(kind[data], np.minimum(np.stack([starts, ends], 1).ravel(), len(data) - 1))[::2] if len(starts) else np.zeros(0, dtype=np.uint8)
    if len(starts) and ends[-1] == len(data):  # the last segment ran to the end already
        flags[-1] = np.bitwise_or.reduce(kind[data[starts[-1] :]])
    again = np.zeros(len(starts), dtype=np.uint8)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    return (flags & 31) | (again << 5)


def features(chunk: X.Chunk, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each document, one after another, and their number per document."""
    starts, ends, counts = chunk.words()
    docs = len(chunk)
    owner = np.repeat(np.arange(docs), counts)
    hashes = X.span_hashes(X.lower_ascii(chunk.data), starts, ends)
    shape = X.mix(_shapes(chunk.data, starts, ends, hashes, owner).astype(U) + U(977))
    size = np.diff(chunk.offsets)
    byte_owner = np.repeat(np.arange(docs), size)
    found = []

    def add(values: np.ndarray, own: np.ndarray) -> None:
        found.append(own.astype(U) * U(buckets) + values % U(buckets))

    def run(values: np.ndarray, own: np.ndarray, n: int, salt: int) -> None:
        if len(values) < n:
            return
        m = len(values) - n + 1
        acc = np.full(m, salt, dtype=U)
        for j in range(n):
            acc = X.mix(acc * U(0x9E3779B97F4A7C15) + values[j : j + m])
        same = own[:m] == own[n - 1 :]
        add(acc[same], own[:m][same])

    run(hashes, owner, 1, 11)
    run(hashes, owner, 2, 12)
    for n in (1, 2, 3):
        run(shape, owner, n, 20 + n)
    if len(chunk.data) >= 3:
        d = chunk.data.astype(np.uint32)
        tri = d[:-2] | (d[1:-1] << np.uint32(8)) | (d[2:] << np.uint32(16))
        same = byte_owner[:-2] == byte_owner[2:]
        pairs = X.distinct((byte_owner[:-2][same].astype(U) << U(24)) | tri[same].astype(U))
        add(X.mix((pairs & U(0xFFFFFF)) + U(31 << 40)), (pairs >> U(24)).astype(np.int64))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(docs, dtype=np.int64)
    keys = X.distinct(np.concatenate(found))
    return (keys % U(buckets)).astype(np.int64), np.bincount((keys // U(buckets)).astype(np.int64), minlength=docs)


def _count(buckets: int):
    """Per partition: in how many documents of either class each bucket occurs; bucket -1 counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets + 1), dtype=np.int64)
        for batch in batches:
            good = np.asarray(batch.column(1).fill_null(0)).astype(bool)
            for chunk in X.chunks(batch.column(0)):
                keys, per = features(chunk, buckets)
                label = good[chunk.first : chunk.first + len(chunk)]
                flag = np.repeat(label, per)
                for k in (0, 1):
                    total[k, :buckets] += np.bincount(keys[flag == k], minlength=buckets)
                    total[k, buckets] += int((label == k).sum())
        used = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.where(used == buckets, -1, used)), pa.array(total[0, used]), pa.array(total[1, used])], names=["bucket", "bad", "good"])

    return run


def descend(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, buckets: int, penalty: float, epochs: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss with box constraint; returns weights and bias.

    One dual variable per row moves at a time by the exact minimiser of its coordinate, clipped to [0, C]; the bias is the
    weight of a constant column. Rows are visited in a fixed shuffled order. Classes weigh the same.
    """
    w = np.zeros(buckets + 1)
    n = len(rows)
    share = np.bincount((labels > 0).astype(int), minlength=2) / max(1, n)
    box = np.array([penalty * 0.5 / max(share[int(y > 0)], 1e-9) for y in labels])
    norm = np.array([float(v @ v) + 1.0 for v in values])
    alpha = np.zeros(n)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(n):
            keys, x, y = rows[i], values[i], labels[i]
            gradient = y * (w[keys] @ x + w[buckets]) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), box[i])
            if new != alpha[i]:
                w[keys] += (new - alpha[i]) * y * x
                w[buckets] += (new - alpha[i]) * y
                alpha[i] = new
    return w[:buckets], float(w[buckets])


def fit(labelled: DataFrame, label_col: str = "quality", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS, penalty: float = PENALTY) -> Model:
    """Fit on rows whose label is 0 or 1. Null labels teach nothing; a null text is an empty one. Without both classes the
    model knows only the share of good rows and gives every text that score."""
    rows = labelled.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    counts = rows.mapInArrow(_count(buckets), "bucket long, bad long, good long").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    total = np.zeros((2, buckets + 1))
    for r in counts.toPandas().itertuples():  # one row per bucket at most
        total[:, r.bucket] = (r.bad, r.good)
    documents = total[:, buckets]
    if not documents.min():
        share = float((documents[1] + SMOOTHING) / (documents.sum() + 2 * SMOOTHING))
        return Model(np.zeros(buckets), np.zeros(buckets), float(np.log(share / (1 - share))), 1.0)
    rate = (total[:, :buckets] + SMOOTHING) / (documents[:, None] + 2 * SMOOTHING)
    ratios = np.log(rate[1] / rate[0])

    key = F.xxhash64("text")
    texts = rows.select("label", key.alias("key")).distinct()
    first = [texts.where(F.col("label") == k).orderBy("key").limit(sample_rows) for k in (0, 1)]  # top-k, so no task sorts a class
    drawn = F.broadcast(first[0].union(first[1]).select(F.col("label").alias("drawn_label"), F.col("key").alias("drawn_key")))  # at most 2 x sample_rows
    chosen = rows.withColumn("key", key).join(drawn, (F.col("label") == F.col("drawn_label")) & (F.col("key") == F.col("drawn_key"))).dropDuplicates(["label", "key"]).select("text", "label")
    schema = "label int, n long, keys array<int>"

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1)
            for chunk in X.chunks(batch.column(0)):
                keys, per = features(chunk, buckets)
                offsets = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([label.slice(chunk.first, len(chunk)), pa.array(per), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.astype(np.int32)))], names=["label", "n", "keys"])

    sample = chosen.mapInArrow(vectors, schema).toArrow().sort_by([("label", "ascending"), ("n", "ascending")])
    found = [np.asarray(k.values) for k in sample["keys"]]
    y = np.asarray(sample["label"]).astype(float) * 2 - 1
    x = []
    for k in found:
        v = ratios[k]
        x.append(v / max(float(np.sqrt(v @ v)), 1e-9))
    w, bias = descend(found, x, y, buckets, penalty, EPOCHS)
    margins = np.array([float(w[k] @ v) + bias for k, v in zip(found, x, strict=True)])
    spread = float(np.median(np.abs(margins))) or 1.0
    return Model(ratios, w, bias, 3.0 / spread)


def score_batch(model: Model, column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column))
    buckets = len(model.ratios)
    for chunk in X.chunks(column):
        keys, per = features(chunk, buckets)
        owner = np.repeat(np.arange(len(chunk)), per)
        r = model.ratios[keys]
        length = np.sqrt(np.bincount(owner, weights=r * r, minlength=len(chunk)))
        dot = np.bincount(owner, weights=r * model.weights[keys], minlength=len(chunk))
        margin = dot / np.maximum(length, 1e-9) + model.bias
        out[chunk.first : chunk.first + len(chunk)] = 1.0 / (1.0 + np.exp(-np.clip(model.slope * margin, -30, 30)))
    return out


def quality_score(docs: DataFrame, model: Model, text: Column) -> Column:
    """Score of a text column, 0 to 1; a null or empty text gets the score of no evidence."""
    shared = docs.sparkSession.sparkContext.broadcast((model.ratios.astype(np.float32), model.weights.astype(np.float32), model.bias, model.slope))

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        return pa.array(score_batch(Model(*shared.value), column))

    return run(text.cast("string"))


def classify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with score and predicted (1 from 0.5 on); columns of these names are replaced.

    Equal texts get equal scores. An empty table gives an empty result.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")])
    return kept.withColumn("score", quality_score(docs, model, F.col(text_col))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
