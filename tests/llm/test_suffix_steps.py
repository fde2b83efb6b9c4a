"""The steps of the suffix merge: hashed in blocks, one pass over what was sent."""

import random

import numpy as np

from fleetfold.llm import suffix_dedup as S


def run(seed: int) -> S.Run:
    rnd = random.Random(seed)
    passages = [bytes(rnd.choices(b"abcd ", k=90)) for _ in range(4)]
    docs = [b"".join(rnd.choices(passages, k=rnd.randint(0, 3))) + bytes(rnd.choices(b"xyz", k=rnd.choice([0, 3, 70]))) for _ in range(30)]
    return S.Run([rnd.choice([None, *range(20)]) for _ in docs], [len(d) for d in docs], S.squeeze(b"".join(docs)))


def test_blocks_give_the_hashes_of_the_whole(monkeypatch):
    text = np.frombuffer(bytes(random.Random(1).choices(range(256), k=5000)), np.uint8)
    whole = S.least_of(S.hashes(text, S.K), S.LEAST - S.K + 1)
    for block in (1, 7, 64, 1 << 14):
        monkeypatch.setattr(S, "BLOCK", block)
        assert np.array_equal(S.least_hashes(text), whole)


def test_stretches_hold_every_window_of_a_document_once():
    for seed in range(20):
        own = run(seed)
        least = S.least_hashes(np.frombuffer(own.text, np.uint8))
        ends = np.cumsum(own.lengths)
        want = [(p, d) for d, (n, e) in enumerate(zip(own.lengths, ends)) for p in range(e - n, e - S.LEAST + 1)]
        got = [(p, d) for a, n, d in zip(own.start, own.windows, own.doc) for p in range(a, a + n)]
        assert got == want
        assert all(len(set(least[a:a + n].tolist())) == 1 for a, n in zip(own.start, own.windows))


def test_a_run_cuts_by_what_it_sent():
    own = run(5)
    flags = np.random.default_rng(5).integers(0, 3, len(own.keys)).astype(np.uint8)
    shared = own.shared(flags)
    masks, bits = {s: 1 for s in shared[0]}, {w: 0 for w in shared[1]}
    assert np.array_equal(own.removed(flags, masks, bits, shared), own.removed(flags, masks, bits))
    dealt = list(S._dealt(shared, 5))
    assert {s: d for _, _, items, ids in dealt for s, d in zip(items, ids)} == shared[0] | shared[1]
    assert all(items == sorted(items) for _, _, items, _ in dealt)
