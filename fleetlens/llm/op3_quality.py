"""Quality scores: random-indexing word vectors pooled per document, then a two-layer network in numpy whose
probabilities are calibrated by a temperature.

Every word has a fixed sparse random index vector. A word's vector sums the index vectors of its neighbours over
the whole corpus, scaled to unit length, plus its own index vector. Words are hashed to ``BUCKETS`` rows, so the
table has a fixed size whatever the vocabulary. A document is the mean and the spread of its words' vectors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import hashed_sample, held_out, learnable, table, written

BUCKETS = 1 << 13
DIMS = 32
#: Non-zero signs of an index vector.
NON_ZERO = 2
#: Labelled documents per label that the network is fitted on, about; the choice is by a hash of the id.
FITTED = 6000
HIDDEN = 24
EPOCHS = 60
SEED = 7
#: Text code points pooled together.
CHUNK = 2_000_000
#: Parts that a word table is summed in.
SLICES = 16

WORD = re.compile(r"[^\W\d_]+|\d+|\n|[^\w\s]{1,4}|_")
REPEAT, CAPITALS, NUMBER = "<repeat>", "<capitals>", "<number>"


class Buckets(dict):
    """Bucket of a word; capitals and numbers are one word each."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        name = NUMBER if word[0].isdigit() else CAPITALS if len(word) > 1 and word.isupper() else word
        value = self[word] = xxhash.xxh3_64_intdigest(name) % BUCKETS
        return value


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of every bucket's random index vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIMS, (NON_ZERO, BUCKETS)), rng.choice([-1.0, 1.0], (NON_ZERO, BUCKETS))


def word_rows(texts: list[str | None], buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, text after text, and words per text. A word that repeats the one before it is ``REPEAT``."""
    found = [WORD.findall(t) if t else [] for t in texts]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((b for f in found for b in map(buckets.__getitem__, f)), np.int64, int(lengths.sum()))
    if len(flat) > 1:
        same = np.r_[False, flat[1:] == flat[:-1]]
        same[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
        flat = np.where(same, buckets[REPEAT], flat)
    return flat, lengths


def context_sums(flat: np.ndarray, lengths: np.ndarray, place: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """BUCKETS x DIMS sums of the neighbours' index vectors."""
    out = np.zeros(BUCKETS * DIMS)
    text = np.repeat(np.arange(len(lengths)), lengths)
    near = text[1:] == text[:-1]
    left, right = flat[:-1][near], flat[1:][near]
    for word, other in ((left, right), (right, left)):
        for j in range(NON_ZERO):
            out += np.bincount(word * DIMS + place[j][other], sign[j][other], minlength=BUCKETS * DIMS)
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        texts, at = batch.column(batch.schema.get_field_index("text")).to_pylist(), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < CHUNK):
                size += len(texts[end] or "")
                end += 1
            yield batch.slice(at, end - at), texts[at:end]
            at = end


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    buckets, (place, sign), total = Buckets(), index_vectors(), np.zeros(BUCKETS * DIMS)
    for _, texts in _texts(batches):
        total += context_sums(*word_rows(texts, buckets), place, sign)
    part = TaskContext.get().partitionId()
    cut = np.split(total, SLICES)
    yield pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array([part] * SLICES, pa.int64()), pa.array([x.tobytes() for x in cut])],
                          names=["slice", "part", "sums"])


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.float64) for x in pdf["sums"])
    return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "part": [pdf["part"].iloc[0]], "sums": [total.tobytes()]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIMS word vectors learned from the texts of all rows."""
    kind = "slice int, part long, sums binary"
    sums = docs.select("text").mapInArrow(_partial_sums, kind)
    # two rounds of sums, each over about the square root of the number of tasks
    width = max(1, int(docs.rdd.getNumPartitions() ** 0.5))
    sums = sums.groupBy("slice", F.pmod("part", F.lit(width)).alias("_p")).applyInPandas(_add, kind)
    sums = sums.groupBy("slice").applyInPandas(_add, kind).collect()  # SLICES rows of a table of fixed size
    context = np.concatenate([np.frombuffer(r["sums"], np.float64) for r in sorted(sums, key=lambda r: r["slice"])] or [np.zeros(BUCKETS * DIMS)])
    context = context.reshape(BUCKETS, DIMS)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    vectors = np.divide(context, norm, out=np.zeros_like(context), where=norm > 0)
    place, sign = index_vectors()
    for j in range(NON_ZERO):
        vectors[np.arange(BUCKETS), place[j]] += sign[j]
    return vectors.astype(np.float32)


def pooled(flat: np.ndarray, lengths: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of each text's word vectors; zeros for texts without words."""
    out = np.zeros((len(lengths), 2 * DIMS), np.float32)
    some = np.flatnonzero(lengths)
    if len(some):
        start = (np.cumsum(lengths) - lengths)[some]
        n = lengths[some, None]
        rows = vectors[flat]
        mean = np.add.reduceat(rows, start, axis=0) / n
        square = np.add.reduceat(rows * rows, start, axis=0) / n
        out[some] = np.hstack([mean, np.sqrt(np.maximum(0, square - mean * mean))])
    return out


def document_vectors(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, features) for every row: packed float32 pools of word vectors."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS x DIMS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch, texts in _texts(batches):
            rows = pooled(*word_rows(texts, buckets), shared.value)
            yield pa.record_batch([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("features", T.BinaryType())]))


class Network:
    """Standardised inputs, one hidden layer of rectified units, one logistic output divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.temperature, self.constant = 1.0, None
        if len(y) < 10 or y.min() == y.max():  # nothing to separate
            self.constant = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
            return
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.std
        order = rng.permutation(len(y))
        check, fit = order[: len(y) // 5], order[len(y) // 5 :]
        self.w1 = rng.standard_normal((x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1])
        self.b1, self.w2, self.b2 = np.zeros(HIDDEN), rng.standard_normal(HIDDEN) * np.sqrt(1 / HIDDEN), np.zeros(1)
        weights = [self.w1, self.b1, self.w2, self.b2]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(EPOCHS):
            rng.shuffle(fit)
            for at in range(0, len(fit), 256):
                part = fit[at : at + 256]
                hidden = np.maximum(0, x[part] @ self.w1 + self.b1)
                slope = (1 / (1 + np.exp(-(hidden @ self.w2 + self.b2))) - y[part]) / len(part)
                back = np.outer(slope, self.w2) * (hidden > 0)
                grads = [x[part].T @ back + 1e-4 * self.w1, back.sum(axis=0), hidden.T @ slope, np.array([slope.sum()])]
                step += 1
                for w, g, m, v in zip(weights, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.temperature = self._calibrated(x[check], y[check])

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, x @ self.w1 + self.b1) @ self.w2 + self.b2

    def _calibrated(self, x: np.ndarray, y: np.ndarray) -> float:
        """The temperature of least log loss on rows that were not fitted."""
        logits, grid = self._logits(x), np.exp(np.linspace(np.log(0.5), np.log(20), 60))
        loss = [np.logaddexp(0, np.where(y == 1, -1, 1) * logits / t).mean() for t in grid]
        return float(grid[int(np.argmin(loss))])

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._logits((x - self.mean) / self.std) / self.temperature, -50, 50)))


def fit(features: DataFrame, labels: DataFrame, per_label: int = FITTED) -> Network:
    """A network from about ``per_label`` learnable documents of each label (doc_id, label 0 or 1)."""
    known = labels.filter(learnable(F.col("doc_id")) & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.filter(hashed_sample(known, "doc_id", "label", per_label))
    rows = features.join(chosen, "doc_id").orderBy("doc_id", "features").limit(4 * per_label).toPandas()
    x = np.array([np.frombuffer(b, np.float32) for b in rows["features"]], np.float64).reshape(len(rows), 2 * DIMS)
    return Network(x, rows["label"].to_numpy(np.float64))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs`` (doc_id, text); ``labels`` is (doc_id, label).

    score is the calibrated probability of label 1. Null texts are scored as empty ones. Labels other than 0 and 1
    and null ids teach nothing; of several labels of an id, 1 counts. With fewer than ten labelled documents or
    one label only, every score is that label's rate, or 0.5 without labels. Rows that repeat get equal scores.
    """
    features = written(document_vectors(docs, word_vectors(docs)), "features")
    network = docs.sparkSession.sparkContext.broadcast(fit(features, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(len(batch), 2 * DIMS)
            p = network.value.probability(x.astype(np.float64))
            yield pa.record_batch([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    schema = T.StructType([features.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return features.mapInArrow(run, schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    scored = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
