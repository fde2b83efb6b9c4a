"""One deterministic automaton for many byte patterns, and its scan over many texts at once.

Patterns become one nondeterministic automaton, subset construction makes it
deterministic, and merging of equal states makes it small. A scan runs all patterns
in one pass over the bytes: a buffer is cut into lanes at places where the state is
known whatever came before, and all lanes take one step together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as ops  # type: ignore[attr-defined]
from re import _parser  # type: ignore[attr-defined]

import numpy as np

LANE = 256


class _Nfa:
    """Thompson automaton: byte edges and empty edges."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, tree, at: int, fold: bool) -> int:
        """Append the parsed pattern behind state ``at``; returns its end."""
        for op, arg in tree:
            if op is ops.LITERAL:
                at = self._step(at, {arg}, fold)
            elif op is ops.IN:
                at = self._step(at, _set_of(arg), fold)
            elif op is ops.SUBPATTERN:
                at = self.add(arg[3], at, fold)
            elif op is ops.BRANCH:
                end = self.state()
                for branch in arg[1]:
                    self.empty[self.add(branch, self._copy(at), fold)].append(end)
                at = end
            elif op is ops.MAX_REPEAT:
                least, most, inner = arg
                for _ in range(least):
                    at = self.add(inner, at, fold)
                if most is ops.MAXREPEAT:
                    loop = self._copy(at)
                    self.empty[self.add(inner, loop, fold)].append(loop)
                    at = self._copy(loop)
                else:
                    end = self.state()
                    for _ in range(most - least):
                        self.empty[at].append(end)
                        at = self.add(inner, at, fold)
                    self.empty[at].append(end)
                    at = end
            else:
                raise ValueError(f"patterns may not use {op}")
        return at

    def _copy(self, at: int) -> int:
        new = self.state()
        self.empty[at].append(new)
        return new

    def _step(self, at: int, letters: set[int], fold: bool) -> int:
        if fold:
            letters = {ord(c) for b in letters for c in (chr(b).lower(), chr(b).upper()) if b < 128} | letters
        to = self.state()
        self.edges[at].append((frozenset(letters), to))
        return to

    def closure(self, states) -> frozenset[int]:
        found, stack = set(states), list(states)
        while stack:
            for t in self.empty[stack.pop()]:
                if t not in found:
                    found.add(t)
                    stack.append(t)
        return frozenset(found)


def _set_of(items) -> set[int]:
    letters: set[int] = set()
    for op, arg in items:
        if op is ops.LITERAL:
            letters.add(arg)
        elif op is ops.RANGE:
            letters.update(range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"sets may not use {op}")
    return letters


@dataclass(frozen=True)
class Automaton:
    """Transition array ``moves[state * 256 + byte]``; states from ``accepting`` on end a pattern."""

    moves: np.ndarray
    accepting: int
    patterns: list[tuple[int, ...]]  # per accepting state, the patterns that end in it
    start: int
    resets: np.ndarray  # bytes behind which every state is the start state
    known: np.ndarray  # [byte, byte]: the state behind byte, space, byte; -1 if it isn't one state


def compile_patterns(patterns: list[tuple[str, bool]]) -> Automaton:
    """Automaton that finds every end of every pattern (text, ignores case) anywhere."""
    nfa = _Nfa()
    root = nfa.state()
    ends: dict[int, int] = {}
    for number, (pattern, fold) in enumerate(patterns):
        ends[nfa.add(_parser.parse(pattern), nfa._copy(root), fold)] = number
    # bytes that no pattern tells apart
    seen: dict[tuple, int] = {}
    sets = sorted({s for e in nfa.edges for s, _ in e}, key=sorted)
    class_of = np.array([seen.setdefault(tuple(b in s for s in sets), len(seen)) for b in range(256)])
    one_of = [int(np.flatnonzero(class_of == c)[0]) for c in range(len(seen))]
    first = nfa.closure([root])
    numbers, rows, queue = {first: 0}, [], [first]
    for subset in queue:
        row = []
        for b in one_of:
            to = nfa.closure([t for s in subset for letters, t in nfa.edges[s] if b in letters] + [root])
            if to not in numbers:
                numbers[to] = len(numbers)
                queue.append(to)
            row.append(numbers[to])
        rows.append(row)
    moves = np.array(rows)
    found = [tuple(sorted({ends[s] for s in subset if s in ends})) for subset in queue]
    kinds: dict[tuple[int, ...], int] = {}
    group = np.array([kinds.setdefault(f, len(kinds)) for f in found])
    while True:  # split groups until all states of one move alike
        again = np.unique(np.column_stack([group, group[moves]]), axis=0, return_inverse=True)[1].reshape(-1)
        if again.max() == group.max():
            break
        group = again
    # states that end something come last, so one comparison tells a match
    member = np.array([int(np.flatnonzero(group == g)[0]) for g in range(group.max() + 1)])
    order = sorted(range(len(member)), key=lambda g: bool(found[member[g]]))
    rank = np.empty(len(order), int)
    rank[order] = np.arange(len(order))
    small = rank[group[moves[member[order]]]][:, class_of]
    start, kind = int(rank[group[0]]), np.uint16 if len(order) < 1 << 16 else np.uint32
    n_open = sum(not found[member[g]] for g in order)
    known = np.full((256, 256), -1, np.int64)
    for a in range(256):
        behind = np.unique(small[np.unique(small[:, a]), 0x20])
        to = small[behind]
        same = (to == to[0]).all(axis=0) & (to[0] < n_open)
        known[a, same] = to[0][same]
    return Automaton(
        np.ascontiguousarray(small, kind).reshape(-1), n_open, [found[member[g]] for g in order[n_open:]], start,
        (small == start).all(axis=0), known,
    )


#: Bytes from which the state is run ahead of a forced cut, bytes between such cuts, and states that may be left there.
WARM, FORCED, LIVE = 192, 4096, 16


def live_states(automaton: Automaton, buffer: np.ndarray, at: np.ndarray, warm: int = WARM) -> list[np.ndarray]:
    """The states that may stand behind each of the bytes ``at``, whatever the state was ``warm`` bytes before.

    All states run side by side over these bytes; in text they soon become a few.
    """
    moves, every = automaton.moves, np.arange(len(automaton.moves) // 256)
    found: list[np.ndarray] = []
    for a in range(0, len(at), 64):
        own = at[a:a + 64]
        first = own - warm + 1
        # a column for each different past, a row for each cut
        states = moves[(every[None, :] << 8) | buffer[first][:, None]].astype(np.int64)
        for step in range(1, warm):
            if step in (4, 16, 64):  # columns that are the same in every row stay so
                states = np.unique(states, axis=1)
            states = moves[(states << 8) | buffer[first + step][:, None]].astype(np.int64)
        found.extend(np.unique(row) for row in states)
    return found


def scan(automaton: Automaton, buffer: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Positions and states where a pattern ends, in no order. ``buffer`` (uint8) begins in the start state.

    The buffer is cut into lanes that step together. Cuts stand where the state is known
    from the bytes before. A long stretch without such a place is cut anyway: its pieces are
    run from every state that may stand there, and then the pieces are chained, each from
    the state in which the one before it ended.
    """
    n = len(buffer)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    state_at = np.full(n, -1, np.int32)
    state_at[automaton.resets[buffer]] = automaton.start
    if n > 2:
        spaces = np.flatnonzero(buffer[1:-1] == 0x20)
        state_at[spaces + 2] = np.maximum(state_at[spaces + 2], automaton.known[buffer[spaces], buffer[spaces + 2]])
    sure = np.flatnonzero(state_at[:-1] >= 0)
    picked = np.searchsorted(sure, np.arange(lane, n, lane))
    cuts = np.unique(sure[picked[picked < len(sure)]])
    begin = [(np.concatenate([[0], cuts + 1]).astype(np.int64), np.concatenate([[automaton.start], state_at[cuts]]).astype(np.int64))]
    gaps = np.concatenate([[-1], cuts, [n - 1]])
    wide = np.flatnonzero(np.diff(gaps) > 2 * FORCED)
    open_starts: set[int] = set()
    if len(wide):
        forced = np.concatenate([np.arange(gaps[i] + FORCED, gaps[i + 1], FORCED) for i in wide])
        for at, live in zip(forced.tolist(), live_states(automaton, buffer, forced)):
            if len(live) <= LIVE:
                begin.append((np.full(len(live), at + 1, np.int64), live))
                if len(live) > 1:
                    open_starts.add(at + 1)
    starts, states = np.concatenate([b for b, _ in begin]), np.concatenate([s for _, s in begin])
    border = np.append(np.unique(starts), n)
    lengths = border[np.searchsorted(border, starts, side="right")] - starts
    order = np.argsort(-lengths, kind="stable")
    starts, states, lengths = starts[order], states[order], lengths[order]
    began, moves, accepting = states.copy(), automaton.moves, automaton.accepting
    live = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # lanes longer than each step
    places, ended, lanes = [], [], []
    for step in range(int(lengths[0])):
        k = int(live[step])
        at = starts[:k] + step
        states[:k] = moves[(states[:k] << 8) | buffer[at]]
        hits = np.flatnonzero(states[:k] >= accepting)
        if len(hits):
            places.append(at[hits])
            ended.append(states[hits])
            lanes.append(hits)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, kinds, lane_of = np.concatenate(places), np.concatenate(ended), np.concatenate(lanes)
    if open_starts:
        taken = _chained(starts, lengths, began, states, open_starts)
        found, kinds = found[taken[lane_of]], kinds[taken[lane_of]]
    return found, kinds


def _chained(
    starts: np.ndarray, lengths: np.ndarray, began: np.ndarray, ended: np.ndarray, open_starts: set[int]
) -> np.ndarray:
    """Which lanes the automaton really takes: of those with one start that whose state the lane before it ended in."""
    taken = np.ones(len(starts), bool)
    of: dict[int, list[int]] = {}
    before: dict[int, list[int]] = {}
    for i in range(len(starts)):
        start = int(starts[i])
        if start in open_starts:
            of.setdefault(start, []).append(i)
        if start + int(lengths[i]) in open_starts:
            before.setdefault(start + int(lengths[i]), []).append(i)
    for start in sorted(open_starts):
        last = next(i for i in before[start] if taken[i])
        for i in of[start]:
            taken[i] = began[i] == ended[last]
    return taken


def exact(pattern: str, fold: bool) -> re.Pattern[bytes]:
    return re.compile(pattern.encode(), re.IGNORECASE if fold else 0)
