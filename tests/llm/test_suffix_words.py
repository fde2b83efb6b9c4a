"""The suffix merge on rows of words: as many steps for much text as for little, and the same answers as byte strings."""

import random
import sys

import numpy as np
import pytest

from fleetfold.llm import suffix_dedup as S


def runs(seed: int, n: int, size: int = 30) -> list[S.Run]:
    rnd = random.Random(seed)
    passages = [bytes(rnd.choices(b"ab \0", k=rnd.choice([49, 50, 90, 200]))) for _ in range(5)] + [b"ab" * 60, b"\0" * 70]
    out = []
    for _ in range(n):
        docs = [b"".join(rnd.choices(passages, k=rnd.randint(0, 3))) + bytes(rnd.choices(b"ax\0", k=rnd.choice([0, 3, 70]))) for _ in range(size)]
        out.append(S.Run([rnd.choice([None, *range(50)]) for _ in docs], [len(d) for d in docs], S.squeeze(b"".join(docs))))
    return out


def answered(owns: list[S.Run], flags: list[np.ndarray]) -> list[list[tuple[S.Sent, np.ndarray]]]:
    """What each run sent, with the answers of one task for all of it."""
    sent = [list(own.sent(f)) for own, f in zip(owns, flags)]
    every = [s for parts in sent for s in parts]
    found = S.answers(np.concatenate([s.rows for s in every]), np.concatenate([s.ids for s in every]))
    masks = iter(np.split(found, np.cumsum([len(s.rows) for s in every])[:-1]))
    return [[(s, next(masks)) for s in parts] for parts in sent]


def brute(owns: list[S.Run]) -> list[np.ndarray]:
    least: dict[bytes, int] = {}
    places = []
    for own in owns:
        ends = np.cumsum(own.lengths)
        places.append([(p, own.text[p:p + 50], d) for n, e, d in zip(own.lengths, ends, own.rank_id.tolist()) for p in range(e - n, e - 49)])
        for _, w, d in places[-1]:
            least[w] = min(d, least.get(w, d))
    out = []
    for own, all_of in zip(owns, places):
        gone = np.zeros(len(own.text), bool)
        for p, w, d in all_of:
            if least[w] < d:
                gone[p:p + 50] = True
        out.append(gone)
    return out


def test_slices_of_keys_give_the_answers_of_the_whole(monkeypatch):
    owns = runs(2, 3)
    sent = [next(own.sent(f)) for own, f in zip(owns, some_flags(owns))]
    want = S.answers(np.concatenate([s.rows for s in sent]), np.concatenate([s.ids for s in sent]))
    sides = []
    for s in sent:
        other = np.flatnonzero(np.append(True, s.rows[1:, 0] != s.rows[:-1, 0]))
        sides.append((s.rows[:, 0], s.ids, *S.coded(s.rows[:, 1:], other)[:2]))
    for at_once in (1 << 18, 100, 3):
        monkeypatch.setattr(S, "AT_ONCE", at_once)
        assert np.array_equal(np.concatenate(S.met_strings(*map(list, zip(*sides)))), want)


def some_flags(owns: list[S.Run]) -> list[np.ndarray]:
    """Every anchor shared, one in three hot; the same in all runs."""
    return [(1 + (own.keys % np.uint64(3) == 0)).astype(np.uint8) for own in owns]


@pytest.mark.parametrize("patch", [{}, {"MOST_STRINGS": 40}, {"AT_ONCE": 64}, {"BLOCK": 7}, {"mix": lambda columns: np.zeros(np.shape(columns)[-1], np.uint64)}])
def test_what_goes_is_what_a_smaller_id_has(monkeypatch, patch):
    for name, value in patch.items():
        monkeypatch.setattr(S, name, value)
    owns = runs(1, 4)
    done = answered(owns, some_flags(owns))
    assert any(len(parts) > 1 for parts in done) == ("MOST_STRINGS" in patch)
    for own, parts, want in zip(owns, done, brute(owns)):
        assert np.array_equal(own.gone(parts), want)


def test_no_step_takes_strings_one_by_one():
    def lines(size: int) -> int:
        seen = 0

        def trace(frame, event, _):
            nonlocal seen
            if frame.f_code.co_filename != S.__file__:
                return None
            seen += event == "line"
            return trace

        text = random.Random(3).choices(b"abcd", k=size)
        before = sys.gettrace()
        sys.settrace(trace)
        try:
            own = S.Run([1, 2], [size, size], S.squeeze(bytes(text) + bytes(text[::-1])))
            parts = answered([own, own], [np.ones(len(own.keys), np.uint8)] * 2)[0]
            S.coded(parts[0][0].rows[:, 1:], np.zeros(1, np.int64))
            own.gone(parts)
        finally:
            sys.settrace(before)
        return seen

    # fifty times the text; what still grows are the blocks
    assert lines(100_000) < 3 * lines(2_000)


def test_an_anchor_in_many_runs_is_hot_only_with_many_stretches(spark):
    passage = "a passage of some length, in which one anchor at least is found by all runs"
    rows = [(f"0-{i}", [i], [len(passage)], len(passage), S.squeeze(passage.encode())) for i in range(70)]
    many = " ".join(f"{passage[:40]}{i}" for i in range(40))
    rows += [(f"1-{i}", [100 + i], [len(many)], len(many), S.squeeze(many.encode())) for i in range(2)]
    stored = spark.createDataFrame(rows, S.RUNS)
    flags = {r.run: S._flags_of(r.asDict(recursive=True)) for r in S.anchor_flags(stored, 3).collect()}
    assert all(set(f.tolist()) == {1} for f in flags.values())
    flags = {r.run: S._flags_of(r.asDict(recursive=True)) for r in S.anchor_flags(stored, 3, 75).collect()}
    assert all(set(flags[f"0-{i}"].tolist()) <= {1, 2} for i in range(70)) and 2 in flags["1-0"]


def test_the_tasks_of_much_text_are_few():
    """Pairs of a run and a range at 6 GB of text; each costs some calls however little it holds."""
    assert (6e9 / S.RUN_BYTES) * (6e9 / 16 / S.RANGE_KEYS) < 300_000


def test_rows_are_sorted_and_coded_as_their_strings():
    rnd = random.Random(4)
    for width in (0, 1, 7, 8, 9, 40):
        items = [bytes(rnd.choices(b"\0\0a\xff", k=rnd.randint(0, width))) for _ in range(300)]
        rows = S.words_of(items)
        assert S.strings_of(rows) == items
        if not width:
            continue
        order, opens = S.ordered(rows)
        found = [items[i] for i in order]
        assert found == sorted(items)
        assert opens.tolist() == [i == 0 or a != b for i, (a, b) in enumerate(zip([b"", *found], found))]
        assert S.common_bytes(rows[order])[1:].tolist() == [S.common_prefix(a, b, 0) for a, b in zip(found, found[1:])]
        begins = np.array([0, 5, 6, 250])
        pairs, tails, words = S.coded(rows[order], begins)
        for a, b in ((0, 300), (5, 6), (6, 250), (250, 300)):
            back = S.decoded(pairs[a:b], tails[words[a]:words[b]], np.zeros((b - a, rows.shape[1]), np.uint64))
            assert np.array_equal(back, rows[order[a:b]])


def test_numbers_come_back_from_planes():
    keys = np.unique(np.random.default_rng(5).integers(0, 1 << S.KEY_BITS, 500, dtype=np.uint64))
    assert np.array_equal(S.keys_of(S.gaps_of(keys)), keys)
    for kind in ("<i8", "<u4"):
        numbers = np.array([0, 1, 1 << 31 - 1, 77] * 9, kind)
        assert np.array_equal(S.from_planes(S.planes(numbers), kind), numbers)
    assert len(S.from_planes(S.planes(np.zeros(0, "<i8")), "<i8")) == 0


def test_a_run_without_a_window_sends_nothing():
    own = S.Run([1, 2, 3], [0, 20, 49], S.squeeze(b"x" * 69))
    parts = [(sent, np.zeros(0, np.uint32)) for sent in own.sent(np.zeros(0, np.uint8))]
    assert [len(sent.rows) for sent, _ in parts] == [0]
    assert not own.gone(parts).any()
