"""Filter interaction audit: what each filter takes in every order, from counters that a stream retracts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetfold.llm.common import pieces_of, texts_of
from fleetfold.sources.scratch import scratch_dir

FILTERS = "ABCDE"
BIT = {letter: 1 << i for i, letter in enumerate(FILTERS)}
ALL = (1 << len(FILTERS)) - 1
COPY = BIT["E"]

#: Conditions of A to D.
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, SYMBOLS = 50, 65, 5, b"#$%&*|"
_UPPER, _FOLLOWING = bytes(range(0x41, 0x5B)), bytes(range(0x80, 0xC0))

#: A null doc_id counts as the largest number, so any other id is smaller.
NO_ID = (1 << 63) - 1
#: Rows of one task that are combined before they are sent on; input bytes for one bucket of the text state.
COMBINED, BUCKET_BYTES = 100_000, 32 << 20
#: The input is dealt to about so many micro-batches, of so many bytes at least.
ROUNDS, ROUND_BYTES = 8, 16 << 20

_SENT = "bucket bigint, h1 bigint, h2 bigint, id bigint, part string, mask int, n bigint"
_DELTA = "doc_id bigint, part string, mask int, delta bigint"


def failed(text: bytes) -> int:
    """The filters A to D that a UTF-8 text fails, as bits."""
    words = text.split()
    points = len(text.translate(None, _FOLLOWING))
    upper = len(text) - len(text.translate(None, _UPPER))
    return (
        BIT["A"] * (len(words) < LEAST_WORDS)
        | BIT["B"] * (100 * len(set(words)) < LEAST_DISTINCT * len(words))
        | BIT["C"] * (100 * upper > MOST_UPPER * points)
        | BIT["D"] * (len(text.translate(None, SYMBOLS)) < len(text))
    )


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by the keys, and where in that order a new key begins."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def _combined(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for rows alike in text, id and part, with the sum of ``n``."""
    order, starts = _runs(*[rows[c].to_numpy() for c in ("h1", "h2", "id")], pd.factorize(rows["part"])[0])
    out = rows.iloc[order[starts]].copy()
    out["n"] = np.add.reduceat(rows["n"].to_numpy()[order], starts) if len(starts) else []
    return out


def _is_least(rows: pd.DataFrame) -> np.ndarray:
    """Whether a row has the least id of its text."""
    h1, h2, ident = (rows[c].to_numpy() for c in ("h1", "h2", "id"))
    order, _ = _runs(h1, h2, ident)
    _, starts = _runs(h1, h2)
    first = np.zeros(len(rows), np.int64)
    first[starts] = 1
    least = np.empty(len(rows), bool)
    least[order] = ident[order] == ident[order][starts][np.cumsum(first) - 1]
    return least


def marked(docs: DataFrame, buckets: int) -> DataFrame:
    """The rows sent to the text state: digest, id, part, failed filters and number of rows.

    A task combines its rows first: only those with the least id of their text go to
    the state of the text; the others are copies whatever comes later and pass by it,
    dealt out by id (a negative bucket). So a text with a third of all rows sends one
    row per task to its state.
    """

    def send(held: list[tuple]) -> pa.RecordBatch:
        rows = pd.DataFrame(held, columns=["digest", "id", "part", "mask"])
        digests = np.frombuffer(b"".join(rows.pop("digest")), "<i8").reshape(-1, 2)
        rows = _combined(rows.assign(h1=digests[:, 0], h2=digests[:, 1], n=1))
        least = _is_least(rows)
        h1, ident = rows["h1"].to_numpy(), rows["id"].to_numpy()
        rows["bucket"] = np.where(least, h1 % buckets, -1 - ident % buckets)
        return pa.RecordBatch.from_pydict({
            "bucket": rows["bucket"].to_numpy(), "h1": h1, "h2": rows["h2"].to_numpy(), "id": ident,
            "part": pa.array(rows["part"], pa.string()), "mask": rows["mask"].to_numpy(np.int32),
            "n": rows["n"].to_numpy(np.int64),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in pieces_of(batches, "text"):
            digests, masks = [], []
            for text in texts_of(batch):
                digests.append(hashlib.blake2b(text, digest_size=16).digest())
                masks.append(failed(text))
            held.extend(zip(digests, batch.column(0).to_pylist(), batch.column(1).to_pylist(), masks))
            if len(held) >= COMBINED:
                yield send(held)
                held = []
        if held:
            yield send(held)

    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text",
    )
    return rows.mapInArrow(run, _SENT)


def _packed(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows[["h1", "h2", "id", "part", "mask", "n"]], preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


def _deltas(rows: pd.DataFrame, extra: int, sign: int = 1) -> pd.DataFrame:
    return pd.DataFrame({
        "doc_id": rows["id"].to_numpy(), "part": rows["part"].to_numpy(),
        "mask": (rows["mask"].to_numpy() | extra).astype(np.int32), "delta": sign * rows["n"].to_numpy(),
    })


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Least ids of a bucket of texts, and what changes in the counters when a smaller one arrives."""
    new = pd.concat(list(frames), ignore_index=True)
    if key[0] < 0:
        yield _deltas(new, COPY)
        return
    new = new.drop(columns="bucket").assign(old=False)
    held = [_unpacked(state.get[0]).assign(old=True)] if state.exists else []
    rows = pd.concat([*held, new], ignore_index=True)
    least, old = _is_least(rows), rows["old"].to_numpy()
    state.update((_packed(_combined(rows[least].drop(columns="old"))),))
    yield _deltas(rows[~old & least], 0)
    yield _deltas(rows[~old & ~least], COPY)
    yield _deltas(rows[old & ~least], 0, -1)
    yield _deltas(rows[old & ~least], COPY)


def start_audit(docs: DataFrame, path: str, checkpoint: str, buckets: int, **trigger) -> StreamingQuery:
    """Write the changes of the counters of a stream of documents, a folder for each micro-batch.

    ``docs`` has doc_id, text and source. The state of a bucket holds the least id of
    each of its texts with the part and the filters its row fails. When a smaller id
    arrives, the row that held the place is taken back and counted again as a copy,
    so the sums of the changes are right after each micro-batch.
    """
    changes = marked(docs, buckets).groupBy("bucket").applyInPandasWithState(
        _update, _DELTA, "held binary", "append", GroupStateTimeout.NoTimeout
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    docs.sparkSession.createDataFrame([], _DELTA).write.mode("overwrite").parquet(f"{path}/batch=-1")
    return (
        changes.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


def counters(deltas: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (the filters failed), good, toxic and n, from the written changes."""
    one = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        *[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]
    )
    # retractions cancel here, before the join
    net = deltas.groupBy("doc_id", "part", "mask").agg(F.sum("delta").alias("n")).filter("n <> 0")
    rows = net.join(one, "doc_id", "left").fillna(0, ["good", "toxic"])
    return rows.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def orders(counted: DataFrame) -> DataFrame:
    """The audit of all orders: part, filter_order, step and the counts of that step.

    All counts follow from how many rows of a part fail none of a set of filters, so
    a part needs 32 sums, whatever the number of its rows.
    """
    subsets = counted.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(ALL)))).filter("mask & s = 0")
    sums = subsets.groupBy("part", "s").agg(
        F.sum("n").alias("k"), F.sum(F.col("n") * F.col("good")).alias("g"), F.sum(F.col("n") * F.col("toxic")).alias("t")
    )
    # a part in which no row passes everything lacks some sets; its rows still count
    every = counted.select("part").distinct()
    held = sums.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("s", F.struct("k", "g", "t")))).alias("m"))
    passing = every.join(held, "part", "left").select(
        "part", *[F.expr(f"transform(sequence(0, {ALL}), s -> coalesce(try_element_at(m, s).{c}, 0L))").alias(c) for c in "kgt"]
    )
    shapley = ", ".join(_shapley_sum(BIT[letter]) for letter in FILTERS)
    rows = passing.withColumn("shapleys", F.expr(f"array({shapley})")).select("*", F.inline(F.from_json(F.lit(_steps()), _STEPS)))
    after = "before | bit"
    removed = f"k[before] - k[{after}]"
    return rows.select(
        "part", "filter_order", "step",
        F.expr(f"k[{after}]").alias("kept"),
        F.expr(removed).alias("removed"),
        F.expr(f"k[0] - k[bit] - ({removed})").alias("redundant"),
        F.expr(f"k[{ALL} ^ bit] - k[{ALL}]").alias("unique_fails"),
        F.expr(f"g[before] - g[{after}]").alias("good_lost"),
        F.expr(f"t[before] - t[{after}]").alias("toxic_lost"),
        F.expr("shapleys[letter]").alias("shapley"),
    )


def _shapley_sum(bit: int) -> str:
    """SQL for what a filter removes, summed over all orders."""
    terms = []
    for s in (s for s in range(ALL + 1) if not s & bit):
        weight = factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())
        terms.append(f"{weight} * (k[{s}] - k[{s | bit}])")
    return " + ".join(terms)


_STEPS = "array<struct<filter_order: string, step: int, before: int, bit: int, letter: int>>"


def _steps() -> str:
    """Every step of every order, with the filters before it, as JSON."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for i, letter in enumerate(order):
            steps.append({"filter_order": "".join(order), "step": i + 1, "before": before,
                          "bit": BIT[letter], "letter": FILTERS.index(letter)})
            before |= BIT[letter]
    return json.dumps(steps)


def stream_of(spark: SparkSession, files: str, rounds: int = ROUNDS) -> tuple[DataFrame, int]:
    """Parquet files as a stream of about ``rounds`` micro-batches, and the buckets for its state."""
    table = spark.read.parquet(files)
    total = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    stream = spark.readStream.schema(table.schema).option("maxBytesPerTrigger", max(ROUND_BYTES, -(-total // rounds)))
    return stream.parquet(files), max(1, -(-total // BUCKET_BYTES))


def filter_audit(spark: SparkSession, files: str, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The audit of the Parquet files of a documents table (a path or pattern).

    Five filters: A under 50 words, B under 65 % different words, C over 5 % capital
    letters A-Z, D a symbol, E identical to a text with a smaller doc_id anywhere in
    the table. A null text is empty, a null source the part ``""``, a null doc_id the
    largest number. Rows that repeat a doc_id and its text are no copies of each
    other. Of several labels of a doc_id any 1 counts; rows without labels lose
    nothing. Other columns are not read. An empty table gives no rows.
    """
    out = scratch_dir(spark, "filter-audit")
    stream, buckets = stream_of(spark, files, rounds)
    start_audit(stream, f"{out}/changes", f"{out}/progress", buckets).awaitTermination()
    deltas = spark.read.schema(_DELTA).parquet(f"{out}/changes")
    return orders(counters(deltas, labels))


_LETTERS = ", ".join(f"('{letter}', {bit})" for letter, bit in BIT.items())

SQL = rf"""
WITH d AS (SELECT coalesce(doc_id, {NO_ID}) AS doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
f AS (SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
  CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, mask, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT * FROM (VALUES {_LETTERS}) AS v(letter, bit)),
o AS (SELECT concat(a.letter, b.letter, c.letter, d.letter, e.letter) AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM x a, x b, x c, x d, x e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = {ALL}),
s AS (SELECT filter_order, CAST(i AS INT) AS step, bits[i] AS bit, CAST(coalesce(list_sum(bits[1:i-1]), 0) AS INT) AS before
  FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS i FROM o)),
r AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n * good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
