"""MinHash near-duplicates: documents posted by signature coordinate, collisions counted, links verified on full sets.

A signature has COORDINATES least hashes. A document is posted under its pairs of
coordinate and value, and two documents are a candidate when MATCHES of their
coordinates agree. Of two that share so many, both have one of the shared pairs in a
short prefix of their postings, rarest first, so only prefixes become lists
(prefix merging); the long lists behind them are never walked, a pair found in a
prefix looks its other coordinates up in the signatures (skip merging).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.common import pieces_of, texts_of, whole_text
from fleetfold.llm.components import components
from fleetfold.sources.scratch import materialize

#: Words of a shingle, and the least similarity of a link in percent.
WIDTH, PERCENT, SEED = 4, 80, 42
#: A pair at similarity 0.8 agrees in fewer than 38 of 64 coordinates with a chance of 4e-5;
#: the chance falls fast above it.
COORDINATES, MATCHES = 64, 38
#: Members of a list that one task compares with each other, and shingles of them all.
TILE, TILE_SHINGLES = 1024, 1 << 20
#: Pairs of one hub that meet its set in one task.
HUB_PAIRS = 4096

_RANDOM = np.random.default_rng(SEED)
_FLIP = _RANDOM.integers(0, 1 << 64, COORDINATES, np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 64, COORDINATES, np.uint64) | np.uint64(1)
_PLACE = _RANDOM.integers(0, 1 << 64, COORDINATES, np.uint64)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The different hashes, in order, of a UTF-8 text's word shingles; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    ends = ends[min(width, len(words)) - 1:].tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """One number per coordinate that stands for the coordinate and its least hash."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[i:i + 2048, None] ^ _FLIP) * _TIMES).min(axis=0))
    return (least ^ _PLACE).view(np.int64)


def _text_key() -> list[Column]:
    return [F.xxhash64(whole_text()).alias("ta"), F.xxhash64(F.lit(1), whole_text()).alias("tb")]


_PRINTS = "row bigint, doc_id bigint, ta bigint, tb bigint, n bigint, hi bigint, lo bigint, sig array<bigint>"


def _prints(docs: DataFrame, width: int) -> DataFrame:
    """A number, doc_id, text key, set size, 128 bits that stand for the set, and the signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in pieces_of(batches, "text"):
            sets = [shingles(t, width) for t in texts_of(batch)]
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(sets))), batch.column(0), batch.column(1), batch.column(2),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                 pa.array([signature(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))],
                ["row", "doc_id", "ta", "tb", "n", "hi", "lo", "sig"],
            )
            row += len(sets)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *_text_key(), "text")
    return rows.mapInArrow(run, _PRINTS)


def _posted(reps: DataFrame) -> DataFrame:
    """key, node, n: the prefix of every set's postings that a partner must share."""
    postings = reps.select("node", "n", F.explode("sig").alias("key"))
    shared = materialize(postings.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "near-shared")
    # coordinates of one set alone come first in every prefix and need no list
    found = postings.join(shared, "key").groupBy("node").agg(
        F.max("n").alias("n"), F.collect_list(F.struct("members", "key")).alias("held")
    ).filter(F.size("held") >= MATCHES)
    prefix = F.slice(F.array_sort("held"), F.lit(1), F.size("held") - F.lit(MATCHES - 1))
    return found.select("node", "n", F.explode(prefix).alias("p")).select("p.key", "node", "n")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _matches(a: str, b: str) -> Column:
    """In how many coordinates two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, n and hashes of the wanted sets (doc_id, ta, tb, node); a node may come twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in pieces_of(batches, "text"):
            nodes, sets = [], []
            for node, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                if node != last:  # repeated rows stand together
                    nodes.append(node)
                    sets.append(shingles(text, width))
                    last = node
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "n", "hashes"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("_id"), *_text_key(), "text")
    found = rows.join(wanted, ["ta", "tb"]).filter(F.col("_id").eqNullSafe(F.col("doc_id")))
    return found.select("node", "text").mapInArrow(run, "node bigint, n bigint, hashes array<bigint>")


def _hub_links(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that agree in enough coordinates and whose sets are similar.

    b may be the hub of very many pairs; its row is repeated in proportion to them.
    """
    hubs = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(HUB_PAIRS)).cast("int").alias("slots"))
    hubs = materialize(hubs, "near-hubs")
    dealt = pairs.join(hubs, "b").withColumn("slot", F.pmod(F.xxhash64("a"), F.col("slots")).cast("int")).drop("slots")

    def both(left: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
        hub = table.join(hubs, table["node"] == hubs["b"]).select(
            "b", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), *[F.col(c).alias(f"_b_{c}") for c in columns]
        )
        own = table.select(F.col("node").alias("a"), *[F.col(c).alias(f"_a_{c}") for c in columns])
        return left.join(hub, ["b", "slot"]).join(own, "a")

    counted = both(dealt, reps, ["sig"]).filter(_matches("_a_sig", "_b_sig") >= MATCHES).select("a", "b", "slot")
    counted = materialize(counted, "near-candidates")
    common = F.size(F.array_intersect("_a_hashes", "_b_hashes"))
    return both(counted, sets, ["n", "hashes"]).select(
        "a", "b", common.alias("common"), (F.col("_a_n") + F.col("_b_n")).alias("sizes")
    ).filter(F.col("common") * 100 >= (F.col("sizes") - F.col("common")) * percent).select("a", "b")


def _rest(posted: DataFrame, lists: DataFrame, found: DataFrame) -> DataFrame:
    """Lists whose members are still apart, in tiles: key, i, j, node, n, root, hub.

    A list with more members or shingles than a tile is cut into tiles, and each pair
    of tiles is a group of its own, so no task holds a whole hot list.
    """
    placed = posted.join(lists.filter("members > 2"), "key").join(components(found), "node", "left").select(
        "key", "hub", "node", "n", F.coalesce("root", "node").alias("root")
    )
    placed = materialize(placed, "near-placed")
    apart = placed.groupBy("key").agg(
        F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("members"), F.sum("n").alias("shingles")
    ).filter("least <> most")
    tiles = F.ceil(F.greatest(F.col("members") / F.lit(TILE), F.col("shingles") / F.lit(TILE_SHINGLES))).cast("int")
    apart = materialize(apart.select("key", tiles.alias("tiles")), "near-apart")
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    return placed.join(apart, "key").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    ).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "n", "root", "hub")


_GROUP = ["key", "i", "j"]


def _by_group(rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch], ddl: str) -> DataFrame:
    """``work`` on each (key, i, j) group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in range(3)]
            changed = np.zeros(batch.num_rows - 1, bool)
            for k in keys:
                changed |= k[1:] != k[:-1]
            cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(int(k[a]) for k in keys)
                if key != last and held:
                    yield work(pa.Table.from_batches(held))
                    held = []
                last = key
                held.append(batch.slice(a, b - a))
        if held:
            yield work(pa.Table.from_batches(held))

    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(run, ddl)


def _numbers(group: pa.Table, column: str) -> np.ndarray:
    return group[column].combine_chunks().to_numpy(zero_copy_only=False)


def _matrix(group: pa.Table, column: str) -> np.ndarray:
    return group[column].combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)


def _open_pairs(node: np.ndarray, n: np.ndarray, root: np.ndarray, hub: int, percent: int) -> np.ndarray:
    """Which members of a list are still to be compared: other roots, sizes that fit, not tested with the hub."""
    ahead = (node != hub)[:, None] & (node != hub)[None, :]
    fit = np.minimum(n[:, None], n[None, :]) * 100 >= np.maximum(n[:, None], n[None, :]) * percent
    return (root[:, None] != root[None, :]) & ahead & fit


def _candidates(percent: int) -> Callable[[pa.Table], pa.RecordBatch]:
    """The members of a group that agree with another open one in enough coordinates."""

    def work(group: pa.Table) -> pa.RecordBatch:
        node, n, root, hub = (_numbers(group, c) for c in ("node", "n", "root", "hub"))
        pairs = _open_pairs(node, n, root, hub[0], percent)
        if pairs.any():
            sig = _matrix(group, "sig")
            count = np.zeros(pairs.shape, np.uint8)
            for c in range(COORDINATES):
                count += sig[:, c, None] == sig[None, :, c]
            pairs &= count >= MATCHES
        rows = group.drop_columns(["sig"]).take(pa.array(np.flatnonzero(pairs.any(axis=1))))
        return rows.combine_chunks().to_batches(max_chunksize=None)[0] if rows.num_rows else pa.RecordBatch.from_pylist([], rows.schema)

    return work


def overlaps(hashes: np.ndarray, owner: np.ndarray, members: int, columns: int = 4096) -> np.ndarray:
    """How many hashes each two members share, by products of blocks of the incidence matrix."""
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    number = np.cumsum(first) - 1
    several = np.bincount(number)[number] > 1
    number, owner = number[several], owner[several]
    _, number = np.unique(number, return_inverse=True)
    total = np.zeros((members, members), np.int64)
    edges = np.searchsorted(number, np.arange(0, (number[-1] + 1 if len(number) else 0) + columns, columns))
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        block = np.zeros((members, columns), np.float32)
        block[owner[a:b], number[a:b] - k * columns] = 1
        total += (block @ block.T).astype(np.int64)  # at most 4,096, exact
    return total


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Positions of links that connect whatever ``near`` connects; fewer than members."""
    label = np.arange(len(near))
    found: list[tuple[int, int]] = []
    while True:
        cross = near & (label[:, None] != label[None, :])
        rows = np.flatnonzero(cross.any(axis=1))
        if not len(rows):
            return found
        for a, b in zip(rows.tolist(), cross[rows].argmax(axis=1).tolist()):
            x, y = label[a], label[b]
            if x != y:
                found.append((a, b))
                label[label == max(x, y)] = min(x, y)


def _verified(percent: int) -> Callable[[pa.Table], pa.RecordBatch]:
    """Links between open members of a group, enough to connect all that are similar."""

    def work(group: pa.Table) -> pa.RecordBatch:
        node, n, root, hub = (_numbers(group, c) for c in ("node", "n", "root", "hub"))
        _, at = np.unique(node, return_index=True)
        if len(at) < len(node):
            group = group.take(pa.array(at))
            node, n, root = node[at], n[at], root[at]
        lists = group["hashes"].combine_chunks()
        common = overlaps(lists.flatten().to_numpy(), np.repeat(np.arange(len(node)), lists.value_lengths().to_numpy()), len(node))
        near = _open_pairs(node, n, root, hub[0], percent)
        near &= common * 100 >= (n[:, None] + n[None, :] - common) * percent
        links = spanning(near)
        a, b = (np.array([node[x[k]] for x in links], np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return work


def links(docs: DataFrame, reps: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """a, b: verified links between sets, enough of them to connect every linked pair of candidates.

    First every member of a list is compared with the list's least node, its hub. Where
    that leaves members apart, their signatures are compared tile by tile, and those
    that agree with another open member meet with their full sets. A group sends links
    that connect it, never its pairs.
    """
    posted = materialize(_posted(reps), "near-posted")
    lists = materialize(
        posted.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("members")).filter("members > 1"),
        "near-lists",
    )
    met = posted.join(lists, "key")
    hub_sizes = reps.select(F.col("node").alias("b"), F.col("n").alias("_n"))
    first = met.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"), "n").distinct()
    first = first.join(hub_sizes, "b").filter(_sizes_fit(F.col("n"), F.col("_n"), percent)).select("a", "b")
    first = materialize(first, "near-pairs")
    wanted = reps.join(met.select("node").distinct(), "node", "left_semi").select("doc_id", "ta", "tb", "node")
    sets = materialize(_sets(docs, wanted, width), "near-sets")
    found = materialize(_hub_links(first, reps, sets, percent), "near-links")
    rest = _rest(posted, lists, found)
    ddl = "key bigint, i int, j int, node bigint, n bigint, root bigint, hub bigint"
    signed = rest.join(reps.select("node", "sig"), "node").select(*_GROUP, "node", "n", "root", "hub", "sig")
    open_rows = materialize(_by_group(signed, _candidates(percent), ddl), "near-open")
    full = open_rows.join(sets.select("node", "hashes"), "node").select(*_GROUP, "node", "n", "root", "hub", "hashes")
    more = materialize(_by_group(full, _verified(percent), "a bigint, b bigint"), "near-links")
    return found.union(more)


def near_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept of every row.

    Two texts are linked when the Jaccard similarity of their sets of ``width``-word
    shingles is at least ``percent``. Words are lower-cased in A-Z only; a text with
    fewer words is one shingle; a text without words (or null) is linked with nothing,
    not even its own copies. Shingles are compared by 64-bit hash. Texts with the same set
    are one node, so copies never meet in pairs. Every row gives one row, repeated ones too.
    A null doc_id is larger than any other; in a component without any id the
    component_id is null and its rows are kept. Other columns are not read. An empty table
    gives no rows.
    """
    prints = materialize(_prints(docs, width), "near-prints")
    groups = materialize(
        prints.filter("n > 0").groupBy("hi", "lo").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "near-groups"
    )
    reps = prints.join(groups.select(F.col("node").alias("row")), "row", "left_semi")
    reps = materialize(reps.select(F.col("row").alias("node"), "doc_id", "ta", "tb", "n", "sig"), "near-nodes")
    roots = components(links(docs, reps, width, percent))
    placed = materialize(
        groups.join(roots, "node", "left").select("hi", "lo", "least", F.coalesce("root", "node").alias("root")), "near-roots"
    )
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = materialize(placed.join(least, "root").select("hi", "lo", "component_id", F.lit(True).alias("linked")), "near-components")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id"))
    return prints.select("doc_id", "n", "hi", "lo").join(of_set, ["hi", "lo"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
