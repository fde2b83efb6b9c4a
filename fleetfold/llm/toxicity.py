"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.common import pieces_of, texts_of
from fleetfold.llm.examples import held_out, monotone, sample
from fleetfold.sources.scratch import materialize

#: Bound of what is sent to every task: examples per class, and with them their words.
PER_CLASS = 4000
NEIGHBOURS, BLOCK = 15, 64
#: Terms in most examples whose weights are held as a table, example by term.
COMMON = 512
#: Texts scored together, and blocks that each of them takes first.
TOGETHER, FIRST_BLOCKS = 128, 8

_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: bytes) -> list[str]:
    return _WORDS.findall(text.decode("utf-8", "replace").lower())


def _example_words(examples: DataFrame) -> DataFrame:
    """doc_id, y and each different word of the examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            for i, text in enumerate(texts_of(batch)):
                found = sorted(set(words_of(text)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(2)[i].as_py()] * len(found), pa.int32()), pa.array(found, pa.string())], ["y", "word"]
                )

    return examples.select("doc_id", "text", F.col("y").cast("int").alias("y")).mapInArrow(run, "y int, word string")


def vocabulary(examples: DataFrame) -> list[str]:
    """All different words of the examples, in order; bounded by the examples."""
    return _example_words(examples).select("word").distinct().orderBy("word").toArrow().column(0).to_pylist()


def term_vectors(docs: DataFrame, terms: list[str], more: list[str] = []) -> DataFrame:
    """doc_id, ``more``, and the terms of each text: numbers and occurrences."""
    number = {w: i for i, w in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            ids, counts = [], []
            for text in texts_of(batch):
                held = Counter(number[w] for w in words_of(text) if w in number)
                ids.append(sorted(held))
                counts.append([held[t] for t in ids[-1]])
            keep = [i for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                [*(batch.schema.names[i] for i in keep), "terms", "counts"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in more], "text")
    fields = ["doc_id bigint", *(f"{c} int" for c in more), "terms array<int>", "counts array<int>"]
    return rows.mapInArrow(run, ", ".join(fields))


def _ragged(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the lists of a column, from 0, and their values in a row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


@dataclass
class Index:
    """Postings of the rare terms, a table of the common ones, and the largest weights of each block of examples."""

    idf: np.ndarray
    labels: np.ndarray
    doc_ids: np.ndarray
    offsets: np.ndarray   # [term]: where the postings of a rare term begin; those of a common one are empty
    examples: np.ndarray
    weights: np.ndarray
    place: np.ndarray     # [term]: its column in the table, -1 for a rare one
    table: np.ndarray     # [example, common term]: weight
    largest: np.ndarray   # [block, common term]: largest weight
    class_weight: np.ndarray
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))
    empty_score: float = 0.0

    def queries(self, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weights of the terms of several texts, each text of length 1."""
        weights = (1 + np.log(counts)) * self.idf[terms]
        norms = np.sqrt(np.add.reduceat(np.append(weights ** 2, 0), ends[:-1])) if len(ends) > 1 else np.zeros(0)
        return weights / np.repeat(norms, np.diff(ends))

    def nearest(
        self, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray, k: int, without: np.ndarray | None = None
    ) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """Numbers and cosines of the ``k`` nearest examples of each text, exactly, and how many blocks were scored.

        The rare terms are summed from their postings. What the common ones can add is
        bounded by the largest weights of each block: a text takes the blocks with the
        highest bounds first, and a block whose bound is below its k-th best cosine so
        far cannot hold a nearer example and is skipped. No text may be empty; equal
        cosines are taken by number; ``without`` names an example that each text leaves out.
        """
        texts, examples = len(ends) - 1, len(self.labels)
        blocks = len(self.largest)
        weights = self.queries(ends, terms, counts)
        owner = np.repeat(np.arange(texts), np.diff(ends))
        # rare terms: all their postings in one sum
        begin, size = self.offsets[terms], self.offsets[terms + 1] - self.offsets[terms]
        at = np.repeat(begin - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        rare = np.bincount(
            np.repeat(owner, size) * examples + self.examples[at], np.repeat(weights, size) * self.weights[at], texts * examples
        ).astype(np.float64).reshape(texts, examples)
        if without is not None:
            rare[np.arange(texts), without] = -np.inf
        common = np.zeros((texts, self.table.shape[1]), np.float32)
        seen = self.place[terms] >= 0
        common[owner[seen], self.place[terms[seen]]] = weights[seen]
        padded = np.full((texts, blocks * BLOCK), -np.inf)
        padded[:, :examples] = rare
        bound = padded.reshape(texts, blocks, BLOCK).max(axis=2) + common @ self.largest.T + 1e-5
        score = np.full((texts, blocks * BLOCK), -np.inf)
        done = np.zeros((texts, blocks), bool)

        def take(wanted: np.ndarray) -> None:
            for block in np.flatnonzero(wanted.any(axis=0)).tolist():
                who = np.flatnonzero(wanted[:, block])
                own = slice(block * BLOCK, min((block + 1) * BLOCK, examples))
                score[who, own] = rare[who, own] + common[who] @ self.table[own].T
            done[wanted] = True

        first = np.argpartition(-bound, min(FIRST_BLOCKS, blocks) - 1, axis=1)[:, :FIRST_BLOCKS]
        wanted = np.zeros((texts, blocks), bool)
        wanted[np.arange(texts)[:, None], first] = True
        take(wanted)
        kth = np.partition(score, -min(k, score.shape[1]), axis=1)[:, -min(k, score.shape[1])]
        take(~done & (bound >= kth[:, None] - 1e-6) & (bound > 0))
        found = []
        for row in score:
            number = np.flatnonzero(row > 1e-7)
            if len(number) > k:  # ties with the last one are sorted out below
                least = np.partition(row[number], -k)[-k]
                number = number[row[number] >= least - 1e-6]
            top = np.lexsort((number, -np.round(row[number], 6)))[:k]
            found.append((number[top], row[number[top]]))
        return found, int(done.sum())

    def vote(self, number: np.ndarray, cosine: np.ndarray) -> float:
        """Share of label 1 among the neighbours, each weighted by nearness and its class."""
        nearness = 1 / (1.05 - np.minimum(cosine, 1.0))
        w = nearness * self.class_weight[self.labels[number]]
        return float((w * self.labels[number]).sum() / w.sum())

    def score(self, vote: float) -> float:
        at, p = self.steps
        return float(p[np.clip(np.searchsorted(at, vote, side="right") - 1, 0, len(p) - 1)])


def build_index(
    doc_ids: np.ndarray, labels: np.ndarray, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray,
    idf: np.ndarray, sizes: dict[int, int],
) -> Index:
    """Index over examples with terms; ``calibrated`` gives it its steps.

    Examples are ordered by label and then by their rarest terms, so those that share
    words stand together and the bounds of their blocks are tighter.
    """
    n0, n1 = int((labels == 0).sum()), int((labels == 1).sum())
    class_weight = np.array([sizes.get(0, n0) / max(n0, 1), sizes.get(1, n1) / max(n1, 1)])
    length = np.diff(ends)
    empty = length == 0
    df = np.bincount(terms, minlength=len(idf))
    rarest = [tuple(sorted(terms[a:b].tolist(), key=lambda t: (df[t] < 2, df[t]))[:4]) for a, b in zip(ends, ends[1:])]
    order = sorted(np.flatnonzero(~empty).tolist(), key=lambda i: (labels[i], rarest[i], doc_ids[i]))
    at = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in order]) if order else np.zeros(0, np.int64)
    example = np.repeat(np.arange(len(order)), length[order])
    term = terms[at]
    weight = (1 + np.log(counts[at])) * idf[term]
    norms = np.sqrt(np.bincount(example, weight ** 2, len(order)))
    weight = weight / norms[example]
    by_df = np.argsort(-df, kind="stable")[:COMMON]
    place = np.full(len(idf), -1)
    place[by_df] = np.arange(len(by_df))
    is_common = place[term] >= 0
    table = np.zeros((len(order), len(by_df)), np.float32)
    table[example[is_common], place[term[is_common]]] = weight[is_common]
    blocks = max(-(-len(order) // BLOCK), 1)
    largest = np.zeros((blocks, len(by_df)), np.float32)
    for block in range(blocks):
        own = table[block * BLOCK:(block + 1) * BLOCK]
        if len(own):
            largest[block] = own.max(axis=0)
    rare = np.flatnonzero(~is_common)
    rare = rare[np.argsort(term[rare], kind="stable")]
    offsets = np.searchsorted(term[rare], np.arange(len(idf) + 1))
    index = Index(
        idf, labels[order], doc_ids[order], offsets, example[rare].astype(np.int32), weight[rare].astype(np.float32),
        place, table, largest, class_weight,
    )
    w0, w1 = (class_weight * [int((empty & (labels == y)).sum()) for y in (0, 1)]).tolist()
    prior = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    index.empty_score = (w1 + prior) / (w0 + w1 + 1)
    index.steps = (np.zeros(1), np.array([index.empty_score]))
    return index


def together(
    index: Index, batch_ends: np.ndarray, terms: np.ndarray, counts: np.ndarray, k: int, without: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The nearest examples of many texts, some at a time; a text without terms has none."""
    none = (np.zeros(0, np.int64), np.zeros(0))
    for a in range(0, len(batch_ends) - 1, TOGETHER):
        ends = batch_ends[a:a + TOGETHER + 1]
        full = np.flatnonzero(np.diff(ends))
        if not len(full) or not len(index.labels):
            yield from (none for _ in range(len(ends) - 1))
            continue
        own = slice(ends[0], ends[-1])
        short = np.concatenate([[0], np.cumsum(np.diff(ends)[full])])
        left_out = None if without is None else without[a:a + TOGETHER][full]
        found, _ = index.nearest(short, terms[own], counts[own], k, left_out)
        of = dict(zip(full.tolist(), found))
        yield from (of.get(i, none) for i in range(len(ends) - 1))


def calibrated(index: Index, examples: DataFrame, neighbours: int) -> Index:
    """The index with its steps: each example's vote without itself, found where the examples are."""
    position = {d: i for i, d in enumerate(index.doc_ids.tolist())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, terms = _ragged(batch.column("terms"))
            _, counts = _ragged(batch.column("counts"))
            number = np.array([position.get(d, -1) for d in batch.column("doc_id").to_pylist()])
            # an example without terms is nowhere in the index and takes part in no sum
            votes = []
            for i, (near, cosine) in enumerate(together(index, ends, terms, counts, neighbours, np.maximum(number, 0))):
                votes.append(index.vote(near, cosine) if len(near) else index.empty_score)
            keep = np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_arrays([pa.array(number[keep]), pa.array(np.array(votes)[keep])], ["number", "vote"])

    votes = examples.repartition(16).mapInArrow(run, "number bigint, vote double").toArrow()
    if votes.num_rows:
        number = votes.column(0).to_numpy()
        label = index.labels[number]
        index.steps = monotone(votes.column(1).to_numpy(), label.astype(float), index.class_weight[label])
    return index


def toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS,
    neighbours: int = NEIGHBOURS, threshold: float = 0.5,
) -> DataFrame:
    """doc_id, held_out, score, predicted, and as evidence the nearest examples and their cosines.

    Examples are at most ``per_class`` labelled rows per class outside the held-out
    fold, and terms are all their words; document frequencies count all documents.
    Words that no example has are in no cosine. A text
    without a known term (null and empty ones too) has the score of such examples,
    and no evidence. Without any label, every score is 0.5's prior of an empty sample, 0.
    Repeated rows give a row each.
    """
    examples, sizes = sample(docs, labels, label, per_class)
    chosen = vocabulary(examples) or ["\0"]
    vectors = materialize(term_vectors(docs, chosen), "term-vectors")
    counted = vectors.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()  # a row per word of the examples at most
    n = vectors.count()
    df = np.zeros(len(chosen))
    df[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    idf = np.log((1 + n) / (1 + df)) + 1
    stored = materialize(term_vectors(examples, chosen, ["y"]), "example-vectors")
    learned = stored.toArrow()  # at most 2 * per_class rows
    ends, terms = _ragged(learned.column("terms"))
    index = build_index(
        learned.column("doc_id").to_numpy(), learned.column("y").to_numpy(), ends, terms, _ragged(learned.column("counts"))[1], idf, sizes
    )
    del learned
    index = calibrated(index, stored, neighbours)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, terms = _ragged(batch.column("terms"))
            _, counts = _ragged(batch.column("counts"))
            scores, near_ids, near = [], [], []
            for number, cosine in together(index, ends, terms, counts, neighbours):
                scores.append(index.score(index.vote(number, cosine)) if len(number) else index.empty_score)
                near_ids.append(index.doc_ids[number[:3]])
                near.append(cosine[:3])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(near_ids, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.float64()))],
                ["doc_id", "score", "nearest_ids", "nearest_cosines"],
            )

    scored = vectors.mapInArrow(run, "doc_id bigint, score double, nearest_ids array<bigint>, nearest_cosines array<double>")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
        "nearest_ids", "nearest_cosines",
    )
