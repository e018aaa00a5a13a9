"""Quality classifier on supervised subword embeddings.

Every word and every run of three or four bytes inside a word (with the blanks at its ends) is
hashed to one of 2**17 learned vectors, as is every word that repeats the one up to eight words before; a document is the mean of the vectors of all its
features, and a softmax over two classes reads that mean.  Vectors and softmax are
trained by stochastic gradient descent in numpy on a bounded sample of labelled rows.  As
the output is linear in the mean, a trained model is one number for each bucket, and a
score is the logistic function of their mean over the whole text.

Edge cases: null and empty texts have no features and score by the bias alone; rows with a null
label are not learned from; labels of one class only give that class's share as every score,
no labels 0.5; an empty table gives no rows; other columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versify.llm.common import doc_bytes, span_hashes, table, word_spans

BITS = 17
DIM = 12
EPOCHS = 8
RATE = 0.02
#: Distances at which a repeated word counts as a feature of its own.
REPEATS = tuple(range(1, 9))
#: At most so many labelled rows of each class are learned from (those with the smallest hashed id).
SAMPLE_PER_CLASS = 2_000
CUT = 0.7
#: Bytes of text whose features are held at once (or one longer text).
SLICE = 1 << 18


@dataclass
class Model:
    """A number for each feature bucket, and the bias."""

    weight: np.ndarray
    bias: float


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features in a slice of texts, and the text each belongs to."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    starts, ends, _ = word_spans(data, offsets)
    word, of_word = span_hashes(data, starts, ends), doc[starts]
    found, owner = [(word >> np.uint64(64 - BITS)).astype(np.uint32)], [of_word]
    for back in REPEATS:  # the same word again: one feature for all words, as no single pair would tell
        at = np.flatnonzero((word[back:] == word[:-back]) & (of_word[back:] == of_word[:-back])) + back
        found.append(np.full(len(at), back, np.uint32))
        owner.append(of_word[at])
    padded = np.full(len(data) + n + 1, 32, np.uint32)  # a blank before, between and after the texts
    padded[np.arange(len(data)) + doc + 1] = np.where((data >= 9) & (data <= 13), 32, data)
    of = np.full(len(padded), -1, np.int32)
    of[np.arange(len(data)) + doc + 1] = doc
    inner = padded != 32
    gram = padded[:-2] | padded[1:-1] << np.uint32(8) | padded[2:] << np.uint32(16)
    at = np.flatnonzero(inner[1:-1])
    found.append(gram[at] * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS))
    owner.append(of[at + 1])
    at = np.flatnonzero(inner[1:-2] & inner[2:-1])
    wide = gram[at] | padded[at + 3] << np.uint32(24)
    found.append((wide ^ wide >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS))
    owner.append(of[at + 1])
    return np.concatenate(found), np.concatenate(owner)


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability of label 1 for each text."""
    out = np.zeros(len(texts))
    for first, last, data, offsets in doc_bytes(texts, SLICE):
        bucket, doc = features(data, offsets)
        total = np.bincount(doc, weights=model.weight[bucket], minlength=last - first)
        out[first:last] = total / np.maximum(np.bincount(doc, minlength=last - first), 1)
        del bucket, doc
    return 1 / (1 + np.exp(-(out + model.bias)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], share: float, seed: int = 7) -> Model:
    """rows: distinct buckets of a document, their counts, the label.  ``share``: of label 1 among all
    labelled rows, which the sample doesn't follow."""
    weight = np.zeros(1 << BITS, np.float32)
    prior = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if len({y for _, _, y in rows}) < 2:
        return Model(weight, prior if rows else 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, step = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            bucket, count, label = rows[k]
            rate = RATE * (1 - step / steps)
            step += 1
            part = (count / count.sum()).astype(np.float32)
            own = vectors[bucket]
            mean = part @ own
            logit = out @ mean + bias
            p = np.exp(logit - logit.max())
            error = p / p.sum()
            error[label] -= 1
            vectors[bucket] = own - (rate * len(part)) * part[:, None] * (error @ out)
            out -= rate * error[:, None] * mean
            bias -= rate * error
    weight = (vectors @ (out[1] - out[0])).astype(np.float32)
    if not np.isfinite(weight).all():
        raise FloatingPointError("the training diverged; lower RATE")
    sampled = sum(y for _, _, y in rows) / len(rows)
    return Model(weight, float(bias[1] - bias[0]) + prior - float(np.log(sampled / (1 - sampled))))


def learn_fold(id_col: Column) -> Column:
    """False for held-out rows: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 != 2


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from labelled rows outside the held-out fold: at most ``per_class`` of each label."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & learn_fold(F.col("_id")))
    sizes = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    if not sizes:
        return train([], 0.5)
    share = sizes.get(1, 0) / sum(sizes.values())
    picked = [known.where(F.col("_y") == y).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(per_class) for y in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * per_class rows of two numbers
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(sample, "_id").select("_text", "_y")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_pylist()
            for first, last, data, offsets in doc_bytes(batch.column(0), SLICE):
                bucket, doc = features(data, offsets)
                key, count = np.unique(doc.astype(np.int64) << BITS | bucket, return_counts=True)
                edge = np.searchsorted(key >> BITS, np.arange(last - first + 1))
                pieces = [(edge[i], edge[i + 1], label[first + i]) for i in range(last - first) if edge[i] < edge[i + 1]]
                yield pa.RecordBatch.from_pydict({
                    "b": pa.array([(key[s:e] & ((1 << BITS) - 1)).astype(np.int32).tobytes() for s, e, _ in pieces], pa.binary()),
                    "c": pa.array([count[s:e].astype(np.int32).tobytes() for s, e, _ in pieces], pa.binary()),
                    "y": pa.array([y for *_, y in pieces], pa.int32()),
                })

    held = texts.mapInArrow(counted, "b binary, c binary, y int").toArrow().to_pydict()
    order = sorted(range(len(held["y"])), key=lambda i: (held["b"][i], held["y"][i]))  # tasks end in any order
    rows = [(np.frombuffer(held["b"][i], np.int32), np.frombuffer(held["c"][i], np.int32), held["y"][i]) for i in order]
    return train(rows, share)


def score_documents(docs: DataFrame, model: Model, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(model, batch.column(1)))], schema.names)

    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scored, schema)
    return out.select("doc_id", (~learn_fold(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: Model, cut: float = CUT, text_col: str = "text") -> DataFrame:
    """The rows that the classifier accepts, with all their columns."""
    at = docs.columns.index(text_col)

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(model, batch.column(at)) >= cut))

    return docs.mapInArrow(accepted, docs.schema)


def op5_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op5_subword_quality": op5_subword_quality}
