"""Collocations: frequent phrases, counted level by level in tries of word ids.

A phrase of k words can only be frequent when its first and its last k - 1 words are.
So texts are coded once as numbers of frequent words in blocks, and each level counts
only stretches whose shorter phrases are all frequent. The counts of a block grow in
a trie that spills sorted runs; runs meet by prefix partition, are merged and
added there, and what proved frequent goes back to the blocks it came from.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfold.llm.common import pieces_of, texts_of
from fleetfold.sources.scratch import materialize

#: Words of the longest phrase, least occurrences, rows per language.
LONGEST, LEAST, TOP = 4, 30, 2000
#: A longer candidate takes the place of a phrase with this share (in percent) of its occurrences.
INSIDE_PERCENT, SCALE = 80, 2_000_000

#: What ends a piece, and the other white space between words.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_BREAK = b"\xff"  # in no UTF-8 text
_FLAT = bytes.maketrans(BREAKS + b"\t", _BREAK * len(BREAKS) + b" ")

#: Tokens of a block; tokens held by all open blocks of a task.
BLOCK, HELD = 1 << 20, 4 << 20
#: A container with more keys bursts; a trie with more keys spills.
CONTAINER, TRIE = 1 << 16, 1 << 20
#: Occurrences for one prefix partition; a prefix with more is dealt to several.
PARTITION = 2 << 20


def tokens_of(texts: list[bytes]) -> list[bytes]:
    """Words of the texts in order, with a mark where a piece ends."""
    data = _BREAK.join(texts).lower().translate(_FLAT)
    return data.replace(_BREAK, b" " + _BREAK + b" ").split()


class _Block:
    """Tokens of one language as numbers in order of first sight; 0 is the end of a piece."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[_BREAK]
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list[bytes]) -> None:
        tokens = tokens_of(texts)
        self.parts.append(np.fromiter(map(self.ids.__getitem__, tokens), np.uint32, len(tokens)))
        self.parts.append(np.zeros(1, np.uint32))
        self.size += len(tokens)

    def row(self, number: int, lang: str) -> dict:
        tokens = np.concatenate(self.parts)
        counts = np.bincount(tokens, minlength=len(self.ids))[1:]
        return {
            "block": number, "lang": lang, "n": int(counts.sum()), "words": list(self.ids)[1:],
            "counts": counts, "length": len(tokens), "tokens": _pack(tokens),
        }


_BLOCKS = pa.schema([
    ("block", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.list_(pa.binary())),
    ("counts", pa.list_(pa.int64())), ("length", pa.int64()), ("tokens", pa.binary()),
])


def blocks_of(docs: DataFrame) -> DataFrame:
    """Blocks of about BLOCK tokens of one language, each with its own words and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        opened: dict[str, _Block] = {}

        def close(langs: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for lang in langs:
                yield pa.RecordBatch.from_pylist([opened.pop(lang).row(number, lang)], _BLOCKS)
                number += 1

        for batch in pieces_of(batches, "text"):
            by_lang: dict[str, list[bytes]] = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                by_lang[lang].append(text)
            for lang, texts in by_lang.items():
                opened.setdefault(lang, _Block()).add(texts)
            yield from close([x for x, b in opened.items() if b.size >= BLOCK])
            if sum(b.size for b in opened.values()) > HELD:
                yield from close(list(opened))
        yield from close(list(opened))

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return rows.mapInArrow(
        run, "block bigint, lang string, n bigint, words array<binary>, counts array<bigint>, length bigint, tokens binary"
    )


# --- numbers in rows -------------------------------------------------------------------


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, the bytes of equal weight side by side, compressed."""
    table = np.stack(columns).astype("<i8")
    planes = np.ascontiguousarray(table.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1))
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, columns: int, rows: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, columns * rows * 8, "zstd"), np.uint8).reshape(columns, 8, rows)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8").reshape(columns, rows)


def _mix(numbers: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit hashes of 64-bit numbers."""
    x = numbers.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_partition(prefix: np.ndarray, count: np.ndarray, word: np.ndarray, partitions: int, most: int) -> np.ndarray:
    """Where a prefix's subtree is merged; that of a prefix with over ``most`` occurrences bursts by its next word."""
    parts = count // most + 1
    sub = _mix(word) % parts.astype(np.uint64)
    return (_mix(_mix(prefix) + sub) % np.uint64(partitions)).astype(np.int64)


# --- the trie of a task ----------------------------------------------------------------


class Trie:
    """Counts by key: hash containers below nodes of four bits of the prefix partition.

    A container that grows beyond ``container`` keys bursts into a node with 16 of
    them. When the trie holds more than ``limit`` keys, its fullest subtree is spilled.
    """

    def __init__(self, partitions: int, container: int, limit: int) -> None:
        self.depth = max(1, -(-max(1, (partitions - 1).bit_length()) // 4))
        self.container, self.limit = container, limit
        self.root: Counter | list = Counter()
        self.size = 0

    def add(self, keys: np.ndarray, partition: np.ndarray) -> None:
        self._add(self.root, keys, partition, self.depth - 1)

    def _add(self, node: Counter | list, keys: np.ndarray, partition: np.ndarray, level: int) -> None:
        if isinstance(node, Counter):
            held = len(node)
            node.update(keys.tolist())
            self.size += len(node) - held
            return
        slot = (partition >> (4 * level)) & 15
        order = np.argsort(slot, kind="stable")
        edges = np.searchsorted(slot[order], np.arange(17))
        for s in range(16):
            part = order[edges[s]:edges[s + 1]]
            if len(part):
                self._add(node[s], keys[part], partition[part], level - 1)

    def burst(self, partition_of) -> None:
        """Burst full containers; ``partition_of`` tells the prefix partitions of keys."""
        self.root = self._burst(self.root, partition_of, self.depth - 1)

    def _burst(self, node: Counter | list, partition_of, level: int) -> Counter | list:
        if isinstance(node, list):
            return [self._burst(child, partition_of, level - 1) for child in node]
        if len(node) <= self.container or level < 0:
            return node
        keys, counts = _items(node)
        slot = (partition_of(keys) >> (4 * level)) & 15
        children = []
        for s in range(16):
            mine = slot == s
            children.append(Counter(dict(zip(keys[mine].tolist(), counts[mine].tolist()))))
        return [self._burst(child, partition_of, level - 1) for child in children]

    def full(self) -> bool:
        return self.size > self.limit

    def spill(self, everything: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Keys, in order, and counts of the fullest subtree, which is emptied."""
        if everything or isinstance(self.root, Counter):
            subtree, self.root = self.root, Counter()
        else:
            at = max(range(16), key=lambda s: _size(self.root[s]))
            subtree, self.root[at] = self.root[at], Counter()
        keys, counts = _items(subtree)
        self.size -= len(keys)
        order = np.argsort(keys)
        return keys[order], counts[order]


def _size(node: Counter | list) -> int:
    return len(node) if isinstance(node, Counter) else sum(map(_size, node))


def _items(node: Counter | list) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(node, Counter):
        return np.fromiter(node.keys(), np.int64, len(node)), np.fromiter(node.values(), np.int64, len(node))
    parts = [_items(child) for child in node]
    return np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])


# --- coded blocks -----------------------------------------------------------------------

_CODED = "block bigint, length bigint, n_words bigint, n_grams bigint, places binary, word_ids binary, gram_ids binary"


class Coded:
    """A block as numbers of its frequent words and of the frequent phrases that start at each word.

    ``words`` and ``grams`` are 0 where there is none, else one more than the place in
    ``word_ids`` and ``gram_ids`` (both ordered). While phrases are single words they are the same.
    """

    def __init__(self, block, words, grams, word_ids, gram_ids, gram_counts) -> None:
        self.block, self.words, self.grams = block, words, grams
        self.word_ids, self.gram_ids, self.gram_counts = word_ids, gram_ids, gram_counts

    def batch(self) -> pa.RecordBatch:
        places = [self.words] if self.grams is self.words else [self.words, self.grams]
        return pa.RecordBatch.from_arrays(
            [*[pa.array([x], pa.int64()) for x in (self.block, len(self.words), len(self.word_ids), len(self.gram_ids))],
             *[pa.array([x], pa.binary()) for x in (_pack(*places), _pack(self.word_ids), _pack(self.gram_ids, self.gram_counts))]],
            ["block", "length", "n_words", "n_grams", "places", "word_ids", "gram_ids"],
        )

    @classmethod
    def rows(cls, batch: pa.RecordBatch, single: bool) -> Iterator[tuple[int, Coded]]:
        """The blocks of a batch; ``single``: phrases are single words."""
        for i in range(batch.num_rows):
            block, length, n_words, n_grams, places, word_ids, gram_ids = (
                batch.column(c)[i].as_py() for c in ("block", "length", "n_words", "n_grams", "places", "word_ids", "gram_ids")
            )
            placed = _unpack(places, 1 if single else 2, length)
            yield i, cls(block, placed[0], placed[-1], _unpack(word_ids, 1, n_words)[0], *_unpack(gram_ids, 2, n_grams))

    def keys(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a phrase of ``width`` words may be frequent, and its key in the block."""
        last = len(self.words) - width + 1
        if last <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, word = self.grams[:last], self.words[width - 1:]
        # the phrase without its first word starts one further on
        at = np.flatnonzero((first > 0) & (word > 0) & (self.grams[1:last + 1] > 0))
        return at, (first[at] - 1) * len(self.word_ids) + word[at] - 1

    def pairs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``gram_ids`` and ``word_ids`` of keys."""
        return keys // len(self.word_ids), keys % len(self.word_ids)


def _first_codes(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """Blocks in numbers of their frequent words (known: block, held)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                size, length, tokens = (batch.column(c)[i].as_py() for c in ("size", "length", "tokens"))
                held = batch.column("held")[i].values
                place, ids, counts = (held.field(c).to_numpy() for c in ("place", "id", "f"))
                order = np.argsort(ids)
                code = np.zeros(size + 1, np.int64)
                code[place[order] + 1] = np.arange(1, len(ids) + 1)
                words = code[_unpack(tokens, 1, length)[0]]
                yield Coded(batch.column("block")[i].as_py(), words, words, ids[order], ids[order], counts[order]).batch()

    rows = blocks.select("block", F.size("words").cast("bigint").alias("size"), "length", "tokens").join(known, "block")
    return rows.mapInArrow(run, _CODED)


def _runs(coded: DataFrame, width: int, partitions: int) -> DataFrame:
    """Sorted runs of the counts of ``width``-word phrases, a row for each block and prefix partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, block in Coded.rows(batch, width == 2):
                at, keys = block.keys(width)

                def partition_of(k: np.ndarray) -> np.ndarray:
                    g, w = block.pairs(k)
                    return prefix_partition(block.gram_ids[g], block.gram_counts[g], block.word_ids[w], partitions, PARTITION)

                trie = Trie(partitions, CONTAINER, TRIE)
                for a in range(0, len(keys), CONTAINER):
                    part = keys[a:a + CONTAINER]
                    trie.add(part, partition_of(part))
                    trie.burst(partition_of)
                    while trie.full():
                        yield from _run_rows(block, partition_of, *trie.spill())
                if trie.size:
                    yield from _run_rows(block, partition_of, *trie.spill(everything=True))

    return coded.mapInArrow(run, "p bigint, block bigint, size bigint, run binary")


def _run_rows(block: Coded, partition_of, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    partition = partition_of(keys)
    order = np.argsort(partition, kind="stable")
    keys, counts, partition = keys[order], counts[order], partition[order]
    starts = np.flatnonzero(np.append(True, partition[1:] != partition[:-1]))
    g, w = block.pairs(keys)
    prefix, word = block.gram_ids[g], block.word_ids[w]
    edges = [*starts.tolist(), len(keys)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(partition[starts]), pa.array(np.full(len(starts), block.block)), pa.array(np.diff(edges)),
         pa.array([_pack(prefix[a:b], word[a:b], counts[a:b]) for a, b in zip(edges, edges[1:])], pa.binary())],
        ["p", "block", "size", "run"],
    )


_GRAMS = "block bigint, prefix array<bigint>, word array<bigint>, id array<bigint>, f array<bigint>, size bigint, run binary"


def _merged(runs: DataFrame, least: int) -> DataFrame:
    """Frequent phrases of each prefix partition (block -1), and those of each block that has them."""

    def merge(p: int, held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        table = np.concatenate([r for _, r in held], axis=1)
        source = np.repeat(np.arange(len(held)), [r.shape[1] for _, r in held])
        prefixes, a = np.unique(table[0], return_inverse=True)
        words, b = np.unique(table[1], return_inverse=True)
        key = a * len(words) + b
        order = np.argsort(key, kind="stable")  # merges the runs
        starts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        total = np.add.reduceat(table[2][order], starts)
        frequent = total >= least
        ids = np.where(frequent, (p << 32) + np.cumsum(frequent) - 1, -1)
        which = np.empty(len(key), np.int64)
        which[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
        whole = order[starts[frequent]]
        out = [(-1, table[0][whole], table[1][whole], ids[frequent], total[frequent])]
        hit = np.flatnonzero(frequent[which])
        edges = np.searchsorted(source[hit], np.arange(len(held) + 1))
        for (block, _), x, y in zip(held, edges, edges[1:]):
            if y > x:
                mine = hit[x:y]
                out.append((block, table[0][mine], table[1][mine], ids[which[mine]], total[which[mine]]))
        whole = [[out[0][i], *[None] * (len(out) - 1)] for i in range(1, 5)]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int64()), *[pa.array(c, pa.list_(pa.int64())) for c in whole],
             pa.array([len(r[1]) for r in out], pa.int64()), pa.array([None, *[_pack(*r[1:]) for r in out[1:]]], pa.binary())],
            ["block", "prefix", "word", "id", "f", "size", "run"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            for p, block, size, data in zip(*[batch.column(c).to_pylist() for c in ("p", "block", "size", "run")]):
                if p != last and held:
                    yield merge(last, held)
                    held = []
                last = p
                held.append((block, _unpack(data, 3, size)))
        if held:
            yield merge(last, held)

    return runs.repartition("p").sortWithinPartitions("p").mapInArrow(run, _GRAMS)


def _next_codes(coded: DataFrame, back: DataFrame, width: int) -> DataFrame:
    """Blocks with their frequent phrases of ``width`` words, cut down to what may hold longer ones."""

    def recode(block: Coded, held: pa.StructArray) -> Coded | None:
        prefix, word, ids, counts = np.concatenate(
            [_unpack(run, 4, size) for size, run in zip(held.field("size").to_pylist(), held.field("run").to_pylist())], axis=1
        )
        ids, first = np.unique(ids, return_index=True)  # a phrase of several runs of the block
        prefix, word, counts = prefix[first], word[first], counts[first]
        g = np.searchsorted(block.gram_ids, prefix)
        known = g * len(block.word_ids) + np.searchsorted(block.word_ids, word)
        order = np.argsort(known)
        at, keys = block.keys(width)
        place = np.searchsorted(known[order], keys)
        place[place == len(known)] = 0
        hit = known[order][place] == keys
        grams = np.zeros(len(block.words), np.int64)
        grams[at[hit]] = order[place[hit]] + 1
        # only neighbours can be parts of a longer phrase
        starts = grams > 0
        near = starts.copy()
        near[:-1] &= starts[1:]
        near[-1] = False
        near[1:] |= starts[1:] & starts[:-1]
        grams[~near] = 0
        covered = np.zeros(len(grams), bool)
        for i in range(width):
            covered[i:] |= near[:len(near) - i]
        keep = covered.copy()
        keep[1:] |= covered[:-1]  # one break behind each stretch
        words = np.where(covered, block.words, 0)[keep]
        return Coded(block.block, words, grams[keep], block.word_ids, ids, counts) if len(words) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in Coded.rows(batch, width == 2):
                new = recode(block, batch.column("held")[i].values)
                if new is not None:
                    yield new.batch()

    return coded.join(back, "block").mapInArrow(run, _CODED)


# --- phrases ----------------------------------------------------------------------------


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, size and f of every frequent phrase, and lang, n: all word occurrences."""
    blocks = materialize(blocks_of(docs), "phrase-blocks")
    totals = materialize(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    partitions = -(-(totals.agg(F.sum("n")).first()[0] or 1) // PARTITION)
    seen = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select(
        "block", "lang", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("c")
    )
    words = materialize(
        seen.groupBy("lang", "word").agg(F.sum("c").alias("f")).filter(F.col("f") >= least)
        .withColumn("id", F.monotonically_increasing_id()), "phrase-words",
    )
    known = seen.select("block", "lang", "place", "word").join(words, ["lang", "word"]).groupBy("block").agg(
        F.collect_list(F.struct("place", "id", "f")).alias("held")
    )
    coded = materialize(_first_codes(blocks, known), "phrase-codes")
    names = words.select("id", "lang", F.col("word").cast("string").alias("phrase"), F.lit(1).alias("size"), "f")
    by_word = names.select(F.col("id").alias("word"), F.col("phrase").alias("last"))
    parts, before = [names], names
    for width in range(2, longest + 1):
        merged = materialize(_merged(_runs(coded, width, partitions), least), "phrase-merged")
        grams = merged.filter("block = -1").select(F.explode(F.arrays_zip("prefix", "word", "id", "f")).alias("g")).select("g.*")
        named = grams.join(before.select(F.col("id").alias("prefix"), "lang", "phrase"), "prefix").join(by_word, "word")
        before = materialize(
            named.select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), F.lit(width).alias("size"), "f"),
            "phrases",
        )
        parts.append(before)
        if width < longest:
            back = merged.filter("block >= 0").groupBy("block").agg(
                F.collect_list(F.struct("size", "run")).alias("held")
            )
            coded = materialize(_next_codes(coded, back, width), "phrase-codes")
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    return counts.select("lang", "phrase", "size", "f"), totals


def _words(first: Column, count: Column) -> Column:
    return F.array_join(F.slice("words", first, count), " ")


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the strongest phrases of each language.

    Words are lower-cased in A-Z only; phrases do not cross ``. , ; : ! ?`` or the ends
    of lines and texts. A candidate has 2 to ``longest`` words and ``least`` occurrences or
    more; its score is that of its weakest cut. A candidate inside a longer one with
    four fifths of its occurrences is dropped. A null language is ``und``; null and empty
    texts have no words; repeated rows count each time; other columns are not read.
    A language without candidates and an empty table give no rows.
    """
    counts, totals = phrase_counts(docs, least, longest)
    counts = materialize(counts, "phrase-counts")
    candidates = counts.filter("size > 1").select(
        "lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words")
    )
    single = counts.select("lang", F.col("phrase").alias("part"), F.col("f"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "k", _words(F.lit(1), F.col("k")).alias("head"),
        _words(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"),
    )
    cuts = cuts.join(single.withColumnsRenamed({"part": "head", "f": "l"}), ["lang", "head"])
    cuts = cuts.join(single.withColumnsRenamed({"part": "tail", "f": "r"}), ["lang", "tail"])
    # 2,000,000 * a may pass 64 bits
    score = F.expr(f"(cast({SCALE} as decimal(10, 0)) * cast(a as decimal(20, 0))) div cast(l + r as decimal(20, 0))")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("w")
    )
    inner = candidates.filter("size > 2").withColumn("len", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("len") + 1)))
    longer = inner.select("lang", _words(F.col("at"), F.col("len")).alias("phrase"), "a").groupBy("lang", "phrase").agg(
        F.max("a").alias("_longer")
    )
    left = weakest.join(longer, ["lang", "phrase"], "left").filter(
        F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * INSIDE_PERCENT)
    ).select("lang", "phrase", "a", "w.l", "w.r", "w.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language may hold most candidates: its slots are cut first, each by itself
    slots = F.pmod(F.xxhash64("phrase"), F.lit(64))
    cut = left.withColumn("_slot", slots)
    cut = cut.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_slot").orderBy(*order))).filter(F.col("_rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    ranked = cut.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), p AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), i AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w
), g AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT *, unnest([1, 2, 3, 4]) AS size FROM i) WHERE i + size - 1 <= len(w)
), n AS (
  SELECT lang, count(*) AS n FROM i GROUP BY 1
), f AS (
  SELECT lang, phrase, any_value(size) AS size, count(*) AS f FROM g GROUP BY 1, 2 HAVING count(*) >= 30
), c AS (
  SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1
), k AS (
  SELECT *, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:size], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)
), s AS (
  SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, (2000000::HUGEINT * k.a // (x.f + y.f))::BIGINT AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.head JOIN f y ON y.lang = k.lang AND y.phrase = k.tail
), lowest AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, array_to_string(w[b:b + m - 1], ' ') AS phrase, max(a) AS a
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS b FROM (SELECT *, unnest(range(2, size)) AS m FROM c)) GROUP BY 1, 2
), kept AS (
  SELECT s.* FROM lowest s LEFT JOIN longer ON longer.lang = s.lang AND longer.phrase = s.phrase
  WHERE longer.a IS NULL OR 100 * longer.a < 80 * s.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT ranked.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n::BIGINT AS n, score
FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""
