"""The audit of all filter orders, over several micro-batches, against plain loops."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from fleetfold.llm import filter_audit as A

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, mask int"
LABELS = "doc_id bigint, quality int, toxic int"

GOOD = " ".join(f"word{i}" for i in range(60))
SHORT = "just a few words"
SAME = "again " * 70
LOUD = " ".join("LOUD%d" % i for i in range(55))
MARKED = GOOD + " 100% #1"
LONG = " ".join(f"w{i % 40000}x{i}" for i in range(60000))
UMLAUTS = " ".join("ÄÖÜ%d" % i for i in range(60))


def brute(rows, labels):
    docs = [(A.NO_ID if i is None else i, t or "", s or "") for i, t, s in rows]
    facts = []
    for i, text, part in docs:
        words = text.replace("\xa0", "_").split()
        bad = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": any(j < i and u == text for j, u, _ in docs),
        }
        mine = [(q, x) for k, q, x in labels if k == i]
        facts.append((part, bad, any(q == 1 for q, _ in mine), any(x == 1 for _, x in mine)))
    out = {}
    for part in {f[0] for f in facts}:
        rows = [f for f in facts if f[0] == part]
        taken = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if f[1][letter]]
                before, left = left, [f for f in left if not f[1][letter]]
                taken[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f[1][letter] for f in rows) - len(gone),
                    sum(f[1][letter] and sum(f[1].values()) == 1 for f in rows),
                    sum(f[2] for f in gone), sum(f[3] for f in gone),
                ]
                assert len(before) == len(left) + len(gone)
        for (p, order, step), values in out.items():
            if p == part:
                values.append(taken[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def result(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    assert len(rows) == len({(r.part, r.filter_order, r.step) for r in rows})
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in rows}


ROWS = [
    (9, GOOD, "a"), (7, GOOD, "b"), (3, GOOD, "a"), (3, GOOD, "c"), (3, GOOD, "a"), (5, SHORT, "a"), (4, SHORT, None),
    (8, SAME, "b"), (2, LOUD, "b"), (1, MARKED, "b"), (6, None, "a"), (10, "", "a"), (None, GOOD, "b"), (None, "", "d"),
    (None, "", "d"), (11, LONG, "d"), (12, UMLAUTS, "d"), (0, SAME, "b"), (13, None, ""), (14, LONG, "a"), (15, " \n\t", "d"),
]
LABELED = [(9, 1, 0), (3, 1, 1), (2, 0, 1), (2, None, None), (None, 1, 1), (6, 1, 0), (8, 1, 1), (99, 1, 1), (0, None, 1)]


@pytest.mark.parametrize("turned", [False, True])
def test_every_order_over_many_micro_batches(spark, tmp_path, turned):
    rows = ROWS[::-1] if turned else ROWS
    where = str(tmp_path / "documents.parquet")
    for i in range(0, len(rows), 3):
        part = [(d, t, "en", s, 1, "mine", 5) for d, t, s in rows[i:i + 3]]
        spark.createDataFrame(part, DOCS).coalesce(1).write.mode("append").parquet(where)
    labels = spark.createDataFrame(LABELED, LABELS)
    stream = spark.readStream.schema(spark.read.parquet(where).schema).option("maxFilesPerTrigger", 1).parquet(where)
    out = str(tmp_path / "out")
    query = A.start_audit(stream, out, str(tmp_path / "progress"), buckets=3)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 7
    deltas = spark.read.schema(A._DELTA).parquet(out)
    # a smaller id that comes later takes the earlier row's mark back
    assert deltas.filter(F.col("delta") < 0).count() > 0
    assert result(A.orders(A.counters(deltas, labels))) == brute(rows, LABELED)


def test_a_table_at_once_and_an_empty_one(spark, tmp_path):
    where = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(d, t, "en", s, 1, "mine", 5) for d, t, s in ROWS], DOCS).write.parquet(where)
    labels = spark.createDataFrame(LABELED, LABELS)
    assert result(A.filter_audit(spark, where, labels)) == brute(ROWS, LABELED)
    empty = str(tmp_path / "empty.parquet")
    spark.createDataFrame([], DOCS).write.parquet(empty)
    assert A.filter_audit(spark, empty, labels.limit(0)).collect() == []


def test_copies_are_combined_in_the_task(spark):
    """A text with most of the rows sends one row per task to its state."""
    rows = [(i, GOOD, "", "a", 1, "", 0) for i in range(5000)]
    sent = A.marked(spark.createDataFrame(rows, DOCS).coalesce(2), buckets=4)
    assert sent.filter("bucket >= 0").count() <= 2
    assert sent.agg(F.sum("n")).first()[0] == 5000
