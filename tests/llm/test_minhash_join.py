"""MinHash near-duplicates against all pairs of full sets."""

import random
from itertools import combinations

import numpy as np
import pytest

from fleetfold.llm import minhash_join as M

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, hi int, n int, kept int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", 1, "mine", 7, 8, 9) for r in rows], SCHEMA).repartition(5)


def slow_set(text):
    words = (text or "").encode().lower().split()
    width = min(4, len(words))
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute(rows):
    sets = [slow_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and both * 100 >= (len(sets[i]) + len(sets[j]) - both) * 80:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        component = least.get(find(i))
        out.append((d, len(sets[i]), component, d == component))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, df.collect()), key=str)


def edited(rng, words, changes, tag):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"{tag}{rng.randrange(10 ** 6)}"
    return " ".join(out)


def families(rng, sizes):
    rows = []
    for base, size in enumerate(sizes):
        words = [f"b{base}x{rng.randrange(900)}" for _ in range(rng.choice((60, 150, 500)))]
        rows.append(" ".join(words))
        for _ in range(size):
            # from far above the least similarity to far below it
            rows.append(edited(rng, words, rng.randrange(0, max(2, len(words) // 12)), f"e{base}y"))
    return rows


@pytest.mark.parametrize("tile", [M.TILE, 7])
def test_components_match_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(M, "TILE", tile)
    rng = random.Random(11)
    texts = families(rng, [0, 1, 2, 5, 12, 40, 60])
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(0, texts[-1]), (2, texts[-1].upper()), (5000, None), (5001, " \n"), (5001, " \n"), (5002, "a b"), (5003, "A  B"),
             (5004, "a"), (5005, "one Ärger TWO"), (5006, "one ärger two"), (None, "a b"), (None, "lone text of a null id"),
             (None, None), (7, "a second text of an id that is used"), (5007, "x" * 2_000_000),
             (5008, " ".join(f"w{i % 30011}" for i in range(120_000))), (5009, " ".join(f"w{i % 30011}" for i in range(120_007)))]
    assert got(M.near_groups(frame(spark, rows))) == brute(rows)


def test_an_empty_table(spark):
    assert M.near_groups(frame(spark, [])).collect() == []


def test_lists_grow_with_the_rows(spark):
    """Many texts that share most of a template, none like another, send no pairs."""

    def rows(n):
        rng = random.Random(3)
        template = [f"t{i}" for i in range(140)]
        # each has two thirds of its shingles from the template: candidates, but no links
        return [(i, " ".join(template + [f"own{i}z{rng.randrange(10 ** 9)}" for _ in range(45)])) for i in range(n)]

    sizes = []
    for n in (100, 200):
        docs = frame(spark, rows(n))
        prints = M.materialize(M._prints(docs, 4), "p")
        reps = prints.selectExpr("row as node", "doc_id", "ta", "tb", "n", "sig")
        found = M.links(docs, reps).count()
        sizes.append(found)
        assert {r.component_id for r in M.near_groups(docs).collect()} == set(range(n))
    assert sizes == [0, 0]


def test_a_pair_at_the_least_similarity_is_a_candidate():
    """How often two sets of similarity 0.8 agree in too few coordinates."""
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(3000):
        common = rng.integers(0, 1 << 64, 320, np.uint64)
        a, b = (M.signature(np.concatenate([common, rng.integers(0, 1 << 64, 40, np.uint64)])) for _ in range(2))
        missed += (a == b).sum() < M.MATCHES
    assert missed <= 3


def test_overlaps_and_spanning_links():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.int64)) for _ in range(25)]
    owner = np.repeat(np.arange(25), [len(s) for s in sets])
    total = M.overlaps(np.concatenate(sets), owner, 25, columns=16)
    for i, j in combinations(range(25), 2):
        assert total[i, j] == total[j, i] == len(np.intersect1d(sets[i], sets[j]))
    near = np.zeros((6, 6), bool)
    for a, b in ((0, 3), (3, 5), (1, 2)):
        near[a, b] = near[b, a] = True
    assert len(M.spanning(near)) == 3
