"""The pipeline's near-duplicate stage against brute force."""

import random
from itertools import combinations

import corpus_pipeline
from fleetfold.llm import simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, id int, at int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", 1, "mine", 7, 8) for r in rows], SCHEMA).repartition(3)


def slow_kept(rows):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    return sorted((min(g, key=lambda d: (d is None, d or 0)) for g in groups.values()), key=str)


def test_near_stage_keeps_one_of_each_group(spark):
    rng = random.Random(5)
    rows = []
    for base in range(30):
        words = [f"b{base}x{rng.randrange(500)}" for _ in range(rng.choice((40, 400, 4000)))]
        rows.append((len(rows), " ".join(words)))
        for changes in (1, 1, 2, 3):
            other = list(words)
            for _ in range(changes):
                other[rng.randrange(len(other))] = f"new{rng.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(other)))
    rows += [(900, "a b"), (901, "A  b"), (902, None), (903, " "), (None, " \n"), (None, rows[0][1]), (904, "x" * 3_000_000)]
    docs = frame(spark, rows)
    got = corpus_pipeline.near(spark, docs, "")
    assert got.columns == docs.columns
    kept = got.collect()
    assert sorted((r.doc_id for r in kept), key=str) == slow_kept(rows)
    assert {(r.row, r.id, r.at) for r in kept} == {("mine", 7, 8)}


def test_near_stage_with_null_and_repeated_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(None, a), (None, a), (None, a.replace(" ", "  ")), (1, b), (1, b), (1, "another text of its own"), (None, b), (2, b)]
    got = corpus_pipeline.near(spark, frame(spark, rows), "").collect()
    assert sorted((r.doc_id or 0, r.text[:2]) for r in got) == [(0, "a0"), (1, "an"), (1, "b0")]
    assert simhash.keep_one(frame(spark, [])).count() == 0
