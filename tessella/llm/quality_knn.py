"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

Terms of a text are its byte trigrams and, as two further terms, words that repeat the word before
them and lines that repeat an earlier line; trigrams are hashed to TERMS buckets.  A text's vector is
the square root of its term shares times the inverse document frequency, projected on the leading
singular vectors of the labelled sample and scaled to length one.  The labelled vectors are broadcast;
the cosines of every document with all of them are exact products, a block of documents at a time, and
the NEIGHBOURS largest vote with their labels, weighted by similarity.

The fit sees at most SAMPLE labelled texts (half of each label if there are as many), taken in the
order of a hash of their ids, from rows outside the held-out fold only.  Their number bounds the
broadcast: SAMPLE x RANK and TERMS x RANK floats.

Defined cases: a null or empty text, or one without any term of the fit, has the score EMPTY; with
labels of one kind only every score is that label's; without labels every score is EMPTY; ids that
repeat in labels count once each, with their least label, and of an id that repeats in docs the fit takes the least text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fresh, map_arrow, named, text_of

TERMS, RANK, SAMPLE, NEIGHBOURS = 4096, 48, 4000, 15
#: The power of the similarity in a vote.
SHARP = 12
EMPTY = 0.5
#: A score from which a text counts as good.
THRESHOLD = 0.7
#: Documents of one block of products.
BLOCK = 256


def terms(text: str) -> np.ndarray:
    """The counts of all terms of a text."""
    raw = text.encode()
    counts = np.zeros(TERMS + 2, np.float32)
    a = np.frombuffer(raw, np.uint8)
    # A long text goes through in pieces, so that memory is bounded by its own bytes.
    for at in range(0, len(a) - 2, 1 << 20):
        x = a[at : at + (1 << 20) + 2].astype(np.uint32)
        code = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
        code *= np.uint32(0x27D4EB2F)
        counts[:TERMS] += np.bincount(code >> 20, minlength=TERMS)
    words = raw.split()
    counts[TERMS] = sum(map(bytes.__eq__, words, words[1:]))
    lines = raw.split(b"\n")
    counts[TERMS + 1] = len(lines) - len(set(lines))
    total = counts[:TERMS].sum()
    if words:
        counts[TERMS] *= total / len(words)
        counts[TERMS + 1] *= total / len(lines)
    return counts


@dataclass
class Model:
    idf: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors of rows of counts; zero for a text without terms."""
        total = counts.sum(1, keepdims=True)
        x = np.sqrt(counts / np.maximum(total, 1)) * self.idf
        v = x @ self.project
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), EMPTY)
        v = self.embed(counts)
        near = v @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** SHARP
        votes = (weight * self.labels[top]).sum(1)
        total = weight.sum(1)
        out = np.where(total > 0, votes / np.maximum(total, 1e-300), EMPTY)
        out[counts.sum(1) == 0] = EMPTY
        return np.clip(out, 0.0, 1.0)


def fitted(counts: np.ndarray, labels: np.ndarray) -> Model:
    """The model of labelled rows of counts."""
    n, width = counts.shape
    if not n:
        return Model(np.zeros(width, np.float32), np.zeros((width, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    idf = np.log((1 + n) / (1 + (counts > 0).sum(0))).astype(np.float32) + np.float32(1)
    x = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)) * idf
    # Randomised range finder (Halko et al. 2011), then an exact SVD of the small matrix.
    rank = min(RANK, n, width)
    sketch = x @ np.random.default_rng(7).standard_normal((width, min(width, rank + 16))).astype(np.float32)
    for _ in range(3):
        sketch = x @ (x.T @ np.linalg.qr(sketch)[0])
    basis = np.linalg.qr(sketch)[0]
    project = np.linalg.svd(basis.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32)
    model = Model(idf, project, np.zeros((0, rank), np.float32), labels)
    model.vectors = model.embed(counts).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counted(texts: DataFrame, keep: list[str]) -> DataFrame:
    """keep, and the terms of text as sparse arrays."""
    schema = T.StructType([*(texts.schema[c] for c in keep), *T.StructType.fromDDL("at array<int>, n array<float>").fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = [], []
            for text in batch.column(len(keep)):
                c = terms(text.as_py())
                where = np.flatnonzero(c)
                at.append(where.astype(np.int32))
                n.append(c[where])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))], schema.names)

    return texts.select(*keep, "text").mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` labelled rows outside the held-out fold."""
    bounded_batches(docs.sparkSession)
    known = labels.where(~held_out(F.col("doc_id")) & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    order = F.xxhash64("doc_id", F.lit(11))
    halves = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(sample // 2) for y in (0, 1)]
    chosen = halves[0].unionByName(halves[1])
    # At most ``sample`` rows of two numbers.
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    # Of an id that repeats, the text that is least: the fit depends on the tables alone.
    texts = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = _counted(texts, ["doc_id", "y"]).orderBy("doc_id").toArrow()
    counts = np.zeros((rows.num_rows, TERMS + 2), np.float32)
    for i, (at, n) in enumerate(zip(rows.column("at"), rows.column("n"), strict=True)):
        counts[i, at.values.to_numpy()] = n.values.to_numpy()
    return fitted(counts, rows.column("y").to_numpy().astype(np.float64))


def score_column(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a score; a column of that name is replaced."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(name, T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept))
            scores: list[np.ndarray] = []
            for a in range(0, len(texts), BLOCK):
                counts = np.stack([terms(t.as_py()) for t in texts.slice(a, BLOCK)])
                scores.append(shared.value.scores(counts))
            made = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.float64())], schema.names)

    return map_arrow(docs.select(*named(kept), text_of().alias(fresh(docs, "text"))), run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score_column(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, learn: DataFrame | None = None) -> DataFrame:
    """The documents that the model does not reject, with their columns: all if there are no labels.  learn: where the
    labelled texts are, docs by default."""
    model = fit(docs if learn is None else learn, labels)
    if not len(model.labels):
        return docs
    score = "score"
    while score in {c.lower() for c in docs.columns}:
        score += "_"
    scored = score_column(docs, model, score)
    return scored.where(F.col(score) >= THRESHOLD).select(*named(docs.columns))
