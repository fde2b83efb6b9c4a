"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.common import pieces_of, texts_of
from fleetfold.llm.examples import held_out, monotone, sample
from fleetfold.llm.quality_rules import SYMBOLS
from fleetfold.sources.scratch import materialize

#: Bounds of what is sent to every task: examples per class and latent dimensions.
PER_CLASS, DIMENSIONS = 2000, 48
NEIGHBOURS = 21
#: Hashed byte pairs, then the shape of the text in tenths.
PAIRS, TENTHS = 1024, 11
SHAPES = ("different words", "symbols", "capitals", "word length", "words in a line")
FEATURES = PAIRS + TENTHS * len(SHAPES)
SHAPE_COUNT = 8.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list((SYMBOLS + "!").encode())] = True


def features(texts: list[bytes]) -> np.ndarray:
    """Occurrences of each feature in each text, as rows."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for row, text in zip(out, texts):
        b = np.frombuffer(text, np.uint8)
        if len(b) > 1:
            pair = (b[:-1].astype(np.uint32) * 256 + b[1:]) * np.uint32(2654435761) >> np.uint32(22)
            row[:PAIRS] = np.bincount(pair, minlength=PAIRS)
        words = text.split()
        if words:
            letters = np.count_nonzero((b >= 65) & (b <= 90)), np.count_nonzero((b >= 97) & (b <= 122))
            shape = (
                len(set(words)) / len(words),
                min(np.count_nonzero(_SYMBOL[b]) / len(words), 1.0) if len(b) else 0.0,
                letters[0] / max(sum(letters), 1),
                min(sum(map(len, words)) / len(words) / 20, 1.0),
                min(len(words) / (text.count(b"\n") + 1) / 200, 1.0),
            )
            for i, value in enumerate(shape):
                row[PAIRS + TENTHS * i + int(value * (TENTHS - 1))] = SHAPE_COUNT
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one; an empty text stays zero."""
    rows = np.log1p(counts) * idf
    norm = np.sqrt((rows ** 2).sum(axis=1, keepdims=True))
    return rows / np.where(norm > 0, norm, 1)


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows ** 2).sum(axis=1, keepdims=True))
    return rows / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    class_weight: np.ndarray
    empty_score: float
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return _unit(weighted(counts, self.idf) @ self.axes).astype(np.float32)

    def votes(self, latent: np.ndarray, k: int = NEIGHBOURS, own: bool = False) -> np.ndarray:
        """Similarity-weighted share of label 1 among the ``k`` nearest examples, by full products."""
        similar = latent @ self.vectors.T
        if own:  # the rows are the examples: none is its own neighbour
            np.fill_diagonal(similar, -2)
        k = min(k, similar.shape[1])
        near = np.argpartition(-similar, k - 1, axis=1)[:, :k]
        w = np.exp(8 * (np.take_along_axis(similar, near, axis=1) - 1)) * self.class_weight[self.labels[near]]
        return (w * self.labels[near]).sum(axis=1) / w.sum(axis=1)

    def scores(self, counts: np.ndarray, block: int = 512) -> np.ndarray:
        out = np.full(len(counts), self.empty_score)
        for a in range(0, len(counts), block):
            part = counts[a:a + block]
            full = np.flatnonzero(part.any(axis=1))
            if len(full) and len(self.vectors):
                at, p = self.steps
                vote = self.votes(self.latent(part[full]))
                out[a + full] = p[np.clip(np.searchsorted(at, vote, side="right") - 1, 0, len(p) - 1)]
        return out


def fit(counts: np.ndarray, labels: np.ndarray, idf: np.ndarray, sizes: dict[int, int], dimensions: int = DIMENSIONS) -> Model:
    """Latent axes by singular vectors of the examples, and scores calibrated by leaving each out."""
    full = np.flatnonzero(counts.any(axis=1))
    total = sum(sizes.values())
    prior = (sizes.get(1, 0) + 0.5) / (total + 1)
    n = [max(int((labels[full] == y).sum()), 1) for y in (0, 1)]
    weight = np.array([sizes.get(y, 0) / n[y] for y in (0, 1)])
    empty = labels[~counts.any(axis=1)]
    score = (weight[1] * (empty == 1).sum() + prior) / (weight[0] * (empty == 0).sum() + weight[1] * (empty == 1).sum() + 1)
    if len(full) < 2:
        return Model(idf, np.zeros((FEATURES, 1)), np.zeros((0, 1), np.float32), np.zeros(0, int), weight, float(prior))
    rows = weighted(counts[full], idf).astype(np.float64)
    # the small square of features has the right singular vectors of the rows
    _, axes = np.linalg.eigh(rows.T @ rows)
    axes = np.ascontiguousarray(axes[:, ::-1][:, :dimensions]).astype(np.float32)
    model = Model(idf, axes, _unit(rows @ axes).astype(np.float32), labels[full], weight, float(score))
    model.steps = monotone(np.round(model.votes(model.vectors, own=True), 6), model.labels.astype(float), weight[model.labels])
    return model


def document_frequency(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents in all, and those that have each feature; every task sends its sums only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(FEATURES, np.int64)
        for batch in pieces_of(batches, "text"):
            counts = features(texts_of(batch))
            n += len(counts)
            df += (counts > 0).sum(axis=0)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *held.tolist()], pa.int32()), pa.array([n, *df[held].tolist()], pa.int64())], ["f", "n"])

    summed = docs.select("text").mapInArrow(run, "f int, n bigint").groupBy("f").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(FEATURES)
    n = 0
    for r in summed:
        if r["f"] < 0:
            n = r["n"]
        else:
            df[r["f"]] = r["n"]
    return n, df


def quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, dimensions: int = DIMENSIONS,
    threshold: float = 0.3,
) -> DataFrame:
    """doc_id, held_out, score (label 1) and predicted of every row.

    Vectors come from at most ``per_class`` labelled rows per class outside the
    held-out fold; feature frequencies count all documents. An empty text (null
    too) has the score of such examples, or the share of label 1 if there are none; a text of
    white space only has features of its own and is scored by them.
    Repeated rows give a row each; without labels every score is 0.5.
    """
    examples, sizes = sample(docs, labels, label, per_class)
    n, df = document_frequency(docs)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def example_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            rows = features(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["y", "f"])

    # at most 2 * per_class rows, in the order of a hash, so that the sums do not depend on tasks
    got = examples.select(F.col("y").cast("int").alias("y"), "text").mapInArrow(example_features, "y int, f binary")
    got = got.orderBy(F.xxhash64("f"), "y").collect()
    counts = np.array([np.frombuffer(r["f"], np.float32) for r in got], np.float32).reshape(len(got), FEATURES)
    model = fit(counts, np.array([r["y"] for r in got], int), idf, sizes, dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            scores = model.scores(features(texts_of(batch)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
