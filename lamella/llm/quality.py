"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Fit: a bounded sample of labelled documents (``per_class`` of each class, those of the
smallest id hashes) gives term vectors; inverse document frequencies and the leading
singular vectors of the sample's term matrix define the latent space. Predict: the
labelled vectors are broadcast (their number is bounded), every document's
cosine with each of them is computed in blocks, and the ``neighbours`` nearest vote,
weighted by a power of similarity and by how the sample's class shares differ
from those of all training labels.

Edge cases: null and empty texts are scored like any other text; rows of equal id
are each scored, one of them (that of the least term vector) trains; a document with contradictory labels, a null id or a null label trains
nothing; without labels of one class the score is the other class's, without any
it is 0.5; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm import features
from lamella.llm.common import batch, chunks, crc32, filtered, keyed

FOLDS = 5
_ROWS = 512


@dataclass
class Model:
    weights: np.ndarray  # term -> weight
    space: np.ndarray  # term x dimension
    vectors: np.ndarray  # labelled document x dimension
    labels: np.ndarray
    votes: np.ndarray  # vote of each labelled document, so that class shares are those of all labels
    neighbours: int
    power: float

    def project(self, rows: np.ndarray) -> np.ndarray:
        out = (rows * self.weights) @ self.space
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def score(self, rows: np.ndarray) -> np.ndarray:
        close = self.project(rows) @ self.vectors.T
        k = min(self.neighbours, close.shape[1])
        near = np.argpartition(-close, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(close, near, 1), 1e-3).astype(np.float64) ** self.power * self.votes[near]
        return (weight * self.labels[near]).sum(1) / weight.sum(1)


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("row_id", pa.int64()), ("label", pa.int32()), ("terms", pa.binary())])
    for b in batches:
        for row, stop, data, offsets in chunks(b.column(2), rows=_ROWS):
            rows = features.terms(data, offsets)
            yield batch(schema, b.column(0).slice(row, stop - row), b.column(1).slice(row, stop - row), pa.array([x.tobytes() for x in rows], pa.binary()))


def training_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(row_id, label) of the training folds: the remainder of crc32(id as text) by FOLDS is not 0."""
    own = labels.select(F.col(id_col).cast("long").alias("row_id"), F.col(label_col).cast("int").alias("label")).where("row_id is not null and label in (0, 1)")
    own = own.where(F.pmod(crc32(F.col("row_id")), F.lit(FOLDS)) != 0)
    return own.groupBy("row_id").agg(F.min("label").alias("label"), F.max("label").alias("high")).where("label = high").select("row_id", "label")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, dimensions: int = 48, neighbours: int = 15, power: float = 8.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | float:
    """The model; a number where the labels have one class at most."""
    rows = keyed(docs, id_col, text_col).select("row_id", "text")
    known = training_labels(labels, id_col, label_col)
    share = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(share) < 2:
        return float(next(iter(share))) if share else 0.5
    order = F.xxhash64("row_id")
    some = [known.where(F.col("label") == c).orderBy(order, "row_id").limit(per_class) for c in (0, 1)]
    picked = rows.join(F.broadcast(some[0].unionAll(some[1])), "row_id").select("row_id", "label", "text")  # 2 * per_class rows at most are broadcast
    # Of rows of one id the least vector of terms counts, whichever row comes first.
    vectors = picked.mapInArrow(_term_rows, "row_id long, label int, terms binary").groupBy("row_id").agg(F.min(F.struct("label", "terms")).alias("of")).select("row_id", "of.*")
    # The driver holds the terms once, each row put in its place as it comes; what is computed from them goes by blocks of rows.
    matrix, ids, labelled = np.empty((sum(min(n, per_class) for n in share.values()), features.N_TERMS), np.float32), [], []
    for r in vectors.toLocalIterator():
        matrix[len(ids)] = np.frombuffer(r.terms, np.float32)
        ids.append(r.row_id)
        labelled.append(r.label)
    matrix, order = matrix[: len(ids)], np.argsort(np.array(ids, np.int64))
    label = np.array(labelled, np.float64)[order]
    if len(set(label.tolist())) < 2:
        return float(label[0]) if len(label) else 0.5
    for c in range(0, features.N_TERMS, 64):
        matrix[:, c : c + 64] = matrix[order, c : c + 64]
    weights = (np.log(len(matrix) / (1 + sum((x > 0).sum(0) for x in _blocks(matrix)))) + 1).astype(np.float32)
    total = sum(share.values())
    votes = np.where(label == 1, share[1] / total / label.mean(), share[0] / total / (1 - label.mean()))
    model = Model(weights, _space(matrix, weights, dimensions), np.zeros(0), label, votes, neighbours, power)
    model.vectors = np.concatenate([model.project(x) for x in _blocks(matrix)])
    return model


def _blocks(matrix: np.ndarray) -> Iterator[np.ndarray]:
    return (matrix[i : i + _ROWS] for i in range(0, len(matrix), _ROWS))


def _space(matrix: np.ndarray, weights: np.ndarray, dimensions: int) -> np.ndarray:
    """The leading right singular vectors of the weighted rows, each of length 1, by subspace iteration from a fixed start."""

    def weighted() -> Iterator[np.ndarray]:
        for x in _blocks(matrix):
            x = x * weights
            yield (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float64)

    space = np.random.default_rng(0).standard_normal((matrix.shape[1], min(dimensions + 8, *matrix.shape)))
    for _ in range(12):
        space, _ = np.linalg.qr(sum(x.T @ (x @ space) for x in weighted()))
    _, _, turn = np.linalg.svd(np.concatenate([x @ space for x in weighted()]), full_matrices=False)
    return (space @ turn.T)[:, :dimensions].astype(np.float32)


def _score(model: Model | float, texts: pa.Array) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(texts), model)
    found = [np.clip(model.score(features.terms(data, offsets)), 0, 1) for _, _, data, offsets in chunks(texts, rows=_ROWS)]
    return np.concatenate(found) if found else np.zeros(0)


def _scores(box) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row_id", pa.int64()), ("score", pa.float64())])
        for b in batches:
            yield batch(schema, b.column(0), _score(box.value, b.column(1)))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns as they are."""
    box = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col, **parameters))
    return filtered(docs, text_col, lambda: lambda texts: _score(box.value, texts) >= threshold)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """(doc_id, held_out, score, predicted); ``parameters`` go to ``fit``."""
    box = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col, **parameters))
    done = keyed(docs, id_col, text_col).select("row_id", "text").mapInArrow(_scores(box), "row_id long, score double")
    held_out = F.coalesce(F.pmod(crc32(F.col("row_id")), F.lit(FOLDS)) == 0, F.lit(False))
    return done.select(F.col("row_id").alias(id_col), held_out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
