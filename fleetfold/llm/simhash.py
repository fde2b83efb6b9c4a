"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfold.llm.common import pieces_of, texts_of
from fleetfold.llm.components import components
from fleetfold.sources.scratch import materialize

SHINGLE, SEED, BITS, DISTANCE = 4, 42, 64, 4
#: Fingerprints at most DISTANCE bits apart agree on BLOCKS - DISTANCE blocks at least.
BLOCKS = 7
#: Members of one block value that one task compares with each other.
TILE = 2048


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """64-bit SimHash of a UTF-8 text's word shingles; zero for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist())], dtype="<u8"
    )
    bits = np.packbits(bit_counts(hashes) * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set; sums of 255 rows fit a byte."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 255 * 64):
        part = hashes[i:i + 255 * 64]
        rows = np.zeros((-(-len(part) // 255) * 255, BITS), np.uint8)
        rows[:len(part)] = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(rows.reshape(-1, 255, BITS), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return counts


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            fps = np.array([fingerprint(t, width) for t in texts_of(batch)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """For each choice of ``blocks - distance`` of the blocks, the bits in it."""
    edges = [i * BITS // blocks for i in range(blocks + 1)]
    bits = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(bits[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _shared_blocks(fps: DataFrame, masks: list[int], tile: int) -> DataFrame:
    """Fingerprints by block value, only where two or more share one: mask, value, i, j, fp.

    A value with more than ``tile`` fingerprints is cut into tiles, and each pair of
    tiles (i, j) becomes a group of its own, so no task holds a whole hot value.
    """
    numbered = F.array(*[F.lit(signed(m)) for m in masks])
    blocks = fps.select("fp", F.posexplode(numbered).alias("mask", "bits")).select(
        "fp", "mask", F.col("fp").bitwiseAND(F.col("bits")).alias("value")
    )
    shared = materialize(
        blocks.groupBy("mask", "value").agg(F.count("*").alias("n")).filter("n > 1"), "shared-blocks"
    )
    tiles = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    return (
        blocks.join(shared, ["mask", "value"])
        .withColumn("tiles", tiles)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("mask", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )


def spanning_links(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Pairs that connect whatever links of at most ``distance`` bits connect; fewer than members."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
    label = np.arange(len(fps))
    while True:
        lower = np.where(near, label[None, :], len(fps)).min(axis=1)
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    held = np.flatnonzero(label != np.arange(len(fps)))
    signed_fps = fps.view(np.int64)
    return list(zip(signed_fps[held].tolist(), signed_fps[label[held]].tolist()))


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """a, b: links between different fingerprints, enough of them to connect every linked pair."""
    groups = (
        _shared_blocks(fps, block_masks(blocks, distance), tile)
        .repartition("mask", "value", "i", "j")
        .sortWithinPartitions("mask", "value", "i", "j")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        found: list[tuple[int, int]] = []

        def close() -> None:
            if last is not None:
                group = np.concatenate(held)
                if len(group) == 2:
                    if int(group[0] ^ group[1]).bit_count() <= distance:
                        found.append((signed(int(group[0])), signed(int(group[1]))))
                elif len(group) > 2:
                    found.extend(spanning_links(np.unique(group), distance))

        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in range(4)]
            fp = batch.column(4).to_numpy().view(np.uint64)
            if not len(fp):
                continue
            changed = np.zeros(len(fp) - 1, bool)
            for k in keys:
                changed |= k[1:] != k[:-1]
            cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), len(fp)]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(int(k[a]) for k in keys)
                if key != last:
                    close()
                    last, held = key, []
                held.append(fp[a:b])
            if found:
                yield _links_batch(found)
                found = []
        close()
        if found:
            yield _links_batch(found)

    return groups.mapInArrow(run, "a bigint, b bigint").distinct()


def _links_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def simhash_groups(
    docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE, blocks: int = BLOCKS, tile: int = TILE
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable by links.

    Words are lower-cased in A-Z only. A text with fewer words than a shingle is one
    shingle, a text without words (or null) has the fingerprint zero, which is linked
    like any other. Every row gives one row, repeated ones too. Equal fingerprints
    are one node, so copies never meet in pairs. A null doc_id never is a component's
    id unless all of it is null. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, width), "fingerprints")
    distinct = materialize(prints.select("fp").distinct(), "distinct-fingerprints")
    roots = components(links(distinct, distance, blocks, tile))
    placed = materialize(
        prints.join(roots, prints["fp"] == roots["node"], "left")
        .select("doc_id", "fp", F.coalesce("root", "fp").alias("root")),
        "roots",
    )
    ids = materialize(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")), "components")
    return placed.join(ids, "root").select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


def hex_of(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


_KEY = ["none", "id", "ta", "tb"]


def _keyed_fingerprints(rows: DataFrame, width: int) -> DataFrame:
    """The key of each row and fp, its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            fps = np.array([fingerprint(t, width) for t in texts_of(batch)], dtype=np.uint64)
            keys = [batch.column(i) for i in range(len(_KEY))]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(fps.view(np.int64))], [*_KEY, "fp"])

    return rows.select(*_KEY, "text").mapInArrow(run, "none boolean, id bigint, ta bigint, tb bigint, fp bigint")


def keep_one(
    docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE, blocks: int = BLOCKS, tile: int = TILE
) -> DataFrame:
    """One row of ``docs`` of each component, the one with the smallest doc_id, all columns as they are.

    Who stays is settled on narrow rows (doc_id and 128 bits of the text), so whole texts
    move once. A null doc_id is larger than any other, and a component with null ids
    only keeps one row too; of rows with the same id that of the smallest text key
    stays, of rows alike in both one. ``docs`` may have columns of any name.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"),
        F.xxhash64(text).alias("ta"), F.xxhash64(F.lit(1), text).alias("tb"), "text",
    )
    prints = materialize(_keyed_fingerprints(rows, width), "fingerprints")
    distinct = materialize(prints.select("fp").distinct(), "distinct-fingerprints")
    roots = components(links(distinct, distance, blocks, tile))
    placed = prints.join(roots, prints["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    stay = placed.groupBy("root").agg(F.min(F.struct(*_KEY)).alias("s")).select("s.*")
    kept = rows.drop("text").join(materialize(stay, "stay"), _KEY, "left_semi")
    # the join has dealt out and sorted the rows by their key already
    first = F.row_number().over(Window.partitionBy(*_KEY).orderBy("tb"))
    return kept.withColumn("at", first).filter("at = 1").select("row.*")
