"""Packing by concatenate and cut: two-pass prefix sums give every token its global place."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.common import pieces_of
from fleetfold.llm.token_files import part_offsets
from fleetfold.llm.tokens import SLICE, encoder, with_end
from fleetfold.sources.scratch import materialize

LENGTH, END = 1024, 0

PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")


def encoded(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """First pass, written once: ids of each document and its place inside its part.

    A part is what one task reads. ``before`` counts the part's tokens ahead of the
    document, so the second pass needs no order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in pieces_of(batches, "text", SLICE):
            ids, lengths = with_end(*encoder(tokenizer, False).encode(batch.column(1)), end)
            ends = np.cumsum(lengths)
            starts = (ends - lengths).tolist()
            raw = memoryview(ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes())
            size = len(raw) // len(ids)
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * len(lengths), pa.int32()), batch.column(0), pa.array(before + ends - lengths),
                pa.array(lengths), pa.array([raw[a * size:b * size] for a, b in zip(starts, ends.tolist())], pa.binary()),
            ], ["part", "doc_id", "before", "doc_tokens", "ids"])
            before += int(ends[-1])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return materialize(
        rows.mapInArrow(run, "part int, doc_id bigint, before bigint, doc_tokens bigint, ids binary"), "encoded"
    )


def pieces(stored: DataFrame, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Second pass: every document cut where the fixed windows of the whole stream are.

    One row per piece; the pieces of a sequence are its boundary records. With
    ``with_ids`` the rows also carry the piece's ids (little-endian 32 bits).
    """
    placed = stored.join(materialize(part_offsets(stored, "part", "doc_tokens"), "part-offsets"), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, before, n, raw, base in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "before", "doc_tokens", "ids", "base"))):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                at = base + before
                cuts = [0, *range(length - at % length, n, length), n]
                for a, b in zip(cuts, cuts[1:]):
                    part = ids[a:b].tobytes()
                    out.append((doc_id, a, b - a, zlib.crc32(part), n, (at + a) // length, (at + a) % length, *([part] if with_ids else [])))
            columns = [*PIECES.replace(" bigint", "").split(", "), *(["ids"] if with_ids else [])]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.binary() if name == "ids" else pa.int64()) for name, c in zip(columns, zip(*out))], columns
                )

    return placed.select("doc_id", "before", "doc_tokens", "ids", "base").mapInArrow(
        run, PIECES + (", ids binary" if with_ids else "")
    )


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    All sequences are full but the last, so nothing else is padded. Documents follow
    each other as the input is read. Null text has the end id only; repeated rows are
    packed each; no documents give no rows.
    """
    return pieces(encoded(docs, tokenizer, end), length, with_ids)
