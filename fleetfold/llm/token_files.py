"""Token files: ids of documents in doc_id order, packed by Simple-8b into 64-bit words.

A file is written by Spark, so it can lie in any store, and is committed whole. Each
of its rows is a block of whole documents:

    part, block       place: parts in order of doc_id, blocks in order inside a part
    before            ids of the part before this block
    doc_ids, lengths  the documents in order and the ids of each (with the end id)
    frames            word offset of each frame; a frame is FRAME ids and begins a word
    words             little-endian 64-bit words: selector in the top 4 bits, slots below
    escapes           the ids that fit no slot, in order, as little-endian 64-bit numbers
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetfold.llm.common import pieces_of
from fleetfold.llm.tokens import SLICE, encoder, with_end
from fleetfold.sources.scratch import materialize, scratch_dir

#: Slots per word and bits per slot, by selector. Fixed values of the format.
SLOTS = [60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
WIDTHS = [60 // n for n in SLOTS]
#: A word with this selector stands for one id that is too wide for a slot.
ESCAPE = 15
FRAME, BLOCK = 4096, 1 << 16
END = 2

FILE = ("part int, block int, before bigint, n_ids bigint, doc_ids array<bigint>, lengths array<int>, "
        "frames array<int>, words binary, escapes binary")


def pack(ids: np.ndarray, frame: int = FRAME) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words, word offset of each frame, escapes.

    Each word takes the most ids that fit, and never reaches into the next frame. How
    far each slot width reaches from each position is found for all positions at
    once; only the walk from word to word is a loop.
    """
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    widths = np.maximum(np.frexp(ids.astype(np.float64))[1], 1).astype(np.uint8)
    at = np.arange(n, dtype=np.int32)
    left = np.minimum(frame - at % frame, n - at)
    take = np.ones(n, np.int32)
    select = np.full(n, ESCAPE, np.uint8)
    for selector in range(len(SLOTS) - 1, -1, -1):
        slots, width = SLOTS[selector], WIDTHS[selector]
        fits = widths <= width
        if slots > 1:
            wide = np.flatnonzero(~fits)
            longest = n if not len(wide) else max(int(wide[0]), int(np.diff(wide, append=n).max()) - 1)
            if longest < slots:  # no such word, or only a short one that a wider slot can hold
                continue
            stop = np.where(fits, np.int32(n), at)
            reach = np.minimum.accumulate(stop[::-1])[::-1] - at
            want = np.minimum(left, slots)
            fits = reach >= want
            take[fits] = want[fits]
        select[fits] = selector
    step = (at + take).tolist()
    starts, p = [], 0
    while p < n:
        starts.append(p)
        p = step[p]
    starts = np.array(starts, np.int64)
    chosen, taken = select[starts], take[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector, (slots, width) in enumerate(zip(SLOTS, WIDTHS)):
        own = np.flatnonzero(chosen == selector)
        if len(own):
            slot = np.arange(slots)
            values = ids[np.minimum(starts[own][:, None] + slot, n - 1)]
            values[slot[None, :] >= taken[own][:, None]] = 0
            words[own] |= np.bitwise_or.reduce(values << (slot * width).astype(np.uint64), axis=1)
    frames = np.searchsorted(starts, np.arange(0, n, frame))
    return words, frames, ids[starts[chosen == ESCAPE]]


def unpack(words: np.ndarray, n: int, frames: np.ndarray, escapes: np.ndarray, frame: int = FRAME) -> np.ndarray:
    """The ids again: all words of a selector are unpacked in one step."""
    select = (words >> np.uint64(60)).astype(np.int64)
    slots = np.array([*SLOTS, 1, 1])[select]
    # the last word of a frame may hold fewer ids than slots
    first = np.zeros(len(words), np.int64)
    ends = np.cumsum(slots)
    base = (ends - slots)[frames] if len(frames) else np.zeros(0, np.int64)
    owner = np.searchsorted(frames, np.arange(len(words)), side="right") - 1
    first = ends - slots - base[owner] + owner * frame
    limit = np.minimum((owner + 1) * frame, n)
    out = np.zeros(n, np.uint64)
    for selector, (count, width) in enumerate(zip(SLOTS, WIDTHS)):
        own = np.flatnonzero(select == selector)
        if len(own):
            slot = np.arange(count)
            to = first[own][:, None] + slot
            values = (words[own][:, None] >> (slot * width).astype(np.uint64)) & np.uint64((1 << width) - 1)
            good = to < limit[own][:, None]
            out[to[good]] = values[good]
    out[first[select == ESCAPE]] = escapes
    return out


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = END, block: int = BLOCK) -> None:
    """Encode ``docs`` (doc_id, text) and write them below ``path`` in ascending doc_id order."""
    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        n = 0
        for batch in pieces_of(batches, "text", SLICE):
            ids, lengths = with_end(*encoder(tokenizer, True).encode(batch.column(1)), end)
            doc_ids, cuts = batch.column(0).to_pylist(), np.cumsum(lengths)
            start = 0
            # a block closes behind the document that fills it
            while start < len(doc_ids):
                base = int(cuts[start - 1]) if start else 0
                stop = min(int(np.searchsorted(cuts, base + block - n)) + 1, len(doc_ids))
                held.append((doc_ids[start:stop], lengths[start:stop], ids[base:int(cuts[stop - 1])]))
                n += int(cuts[stop - 1]) - base
                start = stop
                if n >= block:
                    yield _block(part, number, before, held)
                    number, before, held, n = number + 1, before + n, [], 0
        if held:
            yield _block(part, number, before, held)

    ordered.mapInArrow(run, FILE).write.parquet(path)


def _block(part: int, number: int, before: int, held: list[tuple]) -> pa.RecordBatch:
    ids = np.concatenate([h[2] for h in held])
    words, frames, escapes = pack(ids)
    values = {
        "part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int32()),
        "before": pa.array([before], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()),
        "doc_ids": pa.array([[d for h in held for d in h[0]]], pa.list_(pa.int64())),
        "lengths": pa.array([np.concatenate([h[1] for h in held]).tolist()], pa.list_(pa.int32())),
        "frames": pa.array([frames.tolist()], pa.list_(pa.int32())),
        "words": pa.array([words.astype("<u8").tobytes()], pa.binary()),
        "escapes": pa.array([escapes.astype("<u8").tobytes()], pa.binary()),
    }
    return pa.RecordBatch.from_arrays(list(values.values()), list(values))


def documents_of(batch: pa.RecordBatch, row: int) -> tuple[list, list[int], np.ndarray]:
    """doc_ids, lengths and ids of one block."""
    value = {name: batch.column(name)[row] for name in ("doc_ids", "lengths", "frames", "n_ids", "words", "escapes")}
    ids = unpack(
        np.frombuffer(value["words"].as_py(), "<u8"), value["n_ids"].as_py(),
        np.array(value["frames"].as_py(), np.int64), np.frombuffer(value["escapes"].as_py(), "<u8"),
    )
    return value["doc_ids"].as_py(), value["lengths"].as_py(), ids.astype("<u4")


def part_offsets(blocks: DataFrame, part: str, size: str) -> DataFrame:
    """part and base: the ids of all parts before it. One row per written part."""
    totals = blocks.groupBy(part).agg(F.sum(size).alias("_n"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("base"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    blocks = spark.read.schema(FILE).parquet(path)
    placed = blocks.join(materialize(part_offsets(blocks, "part", "n_ids"), "part-offsets"), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, lengths, ids = documents_of(batch, row)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                first = batch.column("base")[row].as_py() + batch.column("before")[row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts + first), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_digest(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Write the token files of ``docs`` and return what is read back from them.

    Null text has the end id only. Rows that repeat a doc_id each have their ids, in
    order of their texts; null doc_ids come first. No documents give no rows.
    """
    path = scratch_dir(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end)
    return read_token_files(docs.sparkSession, path)
