"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from fleetfold.llm import phrases as P

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, phrase string, f int, word string, id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, "s", 1, "mine", 7, "w", 8) for i, (x, t) in enumerate(rows)], SCHEMA).repartition(4)


def brute(rows, least, longest=4, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    out = []
    candidates = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= least}
    inside = Counter()
    for (lang, words), c in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                key = (lang, words[i:i + k])
                inside[key] = max(inside[key], c)
    for (lang, words), a in candidates.items():
        if 100 * inside[lang, words] >= 80 * a:
            continue
        score, k = min((2000000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words)))
        out.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i, *r[1:]) for i, r in enumerate(mine[:top], 1)]
    return sorted(ranked)


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


def sample(rng):
    rows = []
    stock = ["machine learning", "New York City", "in the middle of", "Ärger mit", "a", "the", "of", "x\ty z", "no.way", "\xa0odd space"]
    for i in range(160):
        parts = []
        for _ in range(rng.randrange(0, 120)):
            parts.append(rng.choice(stock) if rng.random() < 0.6 else f"w{int(rng.expovariate(0.1))}")
            if rng.random() < 0.1:
                parts.append(rng.choice([".", ",", "\n", " ; ", "!?", "\r\n", "\x0b"]))
        rows.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), " ".join(parts)))
    return rows + [("en", None), ("fr", ""), ("fr", "one word"), ("it", ". , ;"), ("en", "The THE the " * 3000), ("de", "the long run " * 20000)]


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 500, "HELD": 900, "CONTAINER": 8, "TRIE": 30, "PARTITION": 40}])
def test_phrases_match_plain_counts(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(P, name, value)
    rows = sample(random.Random(4))
    assert got(P.phrases(frame(spark, rows), least=5)) == brute(rows, 5)


def test_first_rows_of_each_language_and_ties(spark):
    rows = [("en", f"p{i:03d} q{i:03d} . p{i:03d} q{i:03d}") for i in range(60)]
    result = got(P.phrases(frame(spark, rows), least=2, top=25))
    assert result == brute(rows, 2, top=25) and [r[1] for r in result] == list(range(1, 26))
    assert result[0][2] == "p000 q000"


def test_without_candidates(spark):
    assert P.phrases(frame(spark, [])).collect() == []
    assert P.phrases(frame(spark, [("en", "some words that stand once"), (None, None)])).collect() == []


def test_trie_bursts_spills_and_counts():
    rng = np.random.default_rng(1)
    keys = rng.zipf(1.2, 20000).astype(np.int64) % 5000

    def partition_of(k):
        return k % 200

    trie, total = P.Trie(200, container=50, limit=400), Counter()
    runs = 0
    for a in range(0, len(keys), 500):
        trie.add(keys[a:a + 500], partition_of(keys[a:a + 500]))
        trie.burst(partition_of)
        while trie.full():
            k, c = trie.spill()
            assert (np.diff(k) > 0).all()
            total.update(dict(zip(k.tolist(), c.tolist())))
            runs += 1
    k, c = trie.spill(everything=True)
    total.update(dict(zip(k.tolist(), c.tolist())))
    assert runs > 5 and trie.size == 0 and total == Counter(keys.tolist())


def test_packed_numbers_come_back():
    rng = np.random.default_rng(3)
    columns = rng.integers(-(1 << 62), 1 << 62, (3, 77))
    assert (P._unpack(P._pack(*columns), 3, 77) == columns).all()
