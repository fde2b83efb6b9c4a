"""Labelled examples: the part that may be learned from, and a bounded sample of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.sources.scratch import materialize

FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's label is kept for testing; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text and y of at most ``per_class`` learnable documents per class, and all learnable labels per class.

    The bound is what makes the examples small enough to send to every task. Which
    rows are taken is set by a hash, so the sample does not depend on their order.
    Rows without a label or without a document are left out; a document with several
    labels counts by the largest.
    """
    known = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    known = materialize(known, "labels")
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = materialize(chosen, "sample")
    # bounded by per_class, so it may be sent to every task
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    return materialize(rows, "examples"), sizes


def monotone(scores, labels, weights):
    """Pool adjacent violators: (score, probability) steps that rise with the score."""
    import numpy as np

    order = np.argsort(scores, kind="stable")
    at, first = np.unique(scores[order], return_index=True)
    w = np.add.reduceat(weights[order], first)
    p = np.add.reduceat((weights * labels)[order], first) / w
    pools: list[list[float]] = []  # [probability, weight, number of scores]
    for value, weight in zip(p.tolist(), w.tolist()):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            total = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return at, np.repeat([q[0] for q in pools], [int(q[2]) for q in pools])
