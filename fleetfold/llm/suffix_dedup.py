"""Repeated passages by a common-prefix-aware distributed merge sort of suffixes.

A passage of LEAST bytes that also starts in a document with a smaller doc_id is
removed. Sorting every suffix would move each byte fifty times, so suffixes are
sampled by content: every window of LEAST bytes has an anchor, its least hashed
K bytes, and neighbouring windows mostly share theirs. Equal windows have equal
anchors, so

1. each run (a few MB of documents, stored once) sends the sorted hashes of its
   anchors, coded by their gaps; an anchor that occurs once in all runs rules out all
   its windows;
2. for the others, each run sorts the suffixes that begin with the anchor's first
   window (cut behind its last window), front-codes them, and sends them to the task of
   their anchor. There the runs are merged: strings are compared word by word, each only
   where its known common prefix ends and only with those that share that prefix;
   suffixes of one anchor come out together, and their windows get the smallest doc_id.
   An anchor with very many stretches sends its windows one by one instead, to the task
   of each window, so no task holds all contexts of a common passage;
3. each run gets back one bit per window it sent and cuts its documents.

Equal suffixes of a run are sent once, with their smallest doc_id: a passage that a
third of all documents share is as much as its runs, not its documents. Strings are rows
of 64-bit words, first byte highest, so that numbers compare as the bytes do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.common import pieces_of, texts_of
from fleetfold.sources.scratch import materialize

LEAST, K = 50, 20
#: Bytes of text in a run, anchors in a range, and the stretches beyond which an anchor is hot.
RUN_BYTES, RANGE_KEYS, HOT_STRETCHES = 8 << 20, 1 << 20, 1 << 15
#: Bits of an anchor's hash that are compared and sent; more bits only spare work.
KEY_BITS = 44
#: Windows that are hashed, and strings that are compared, at once.
BLOCK = 1 << 15
#: Windows of one suffix; their answers fit a 32-bit mask.
MOST_WINDOWS = 31
#: Words of a suffix's text and of a window, and windows or strings that meet at once (more if an anchor has more).
TEXT_WORDS, WINDOW_WORDS, AT_ONCE = (MOST_WINDOWS + LEAST - 1) // 8, -(-LEAST // 8), 1 << 18
#: Strings that a run sorts at once.
MOST_STRINGS = 3 << 18

_NO_ID = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15


_squeezer, _spreader = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(data: bytes) -> bytes:
    return _squeezer.compress(data)


def spread(data: bytes) -> bytes:
    return _spreader.decompress(data)


def planes(numbers: np.ndarray) -> bytes:
    """Numbers of one width, squeezed byte by byte: high bytes that hardly change cost next to nothing."""
    return squeeze(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes())


def from_planes(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(spread(data), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


# --- strings as rows of words --------------------------------------------------

#: By the bytes that a word has left, the bits that count.
_LEFT = np.array([0, *((1 << 64) - (1 << 64 - 8 * n) for n in range(1, 9))], np.uint64)
_BYTES = np.array([1 << 8 * n for n in range(8)], np.uint64)


def words_at(text: bytes, start: np.ndarray, lengths: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The strings of a text as rows of words and, in the last column, their lengths."""
    width = out.shape[1] - 1
    padded = np.frombuffer(text + bytes(8 * width + 8), np.uint8)
    at_byte = np.lib.stride_tricks.as_strided(padded[:8].view(">u8"), (len(padded) - 7,), (1,))
    least = int(lengths.min()) if len(lengths) else 0
    for c in range(width):
        out[:, c] = at_byte[8 * c:][start]
        if least < 8 * c + 8:
            out[:, c] &= _LEFT[np.clip(lengths - 8 * c, 0, 8)]
    out[:, width] = lengths
    return out


def words_of(items: list[bytes]) -> np.ndarray:
    lengths = np.array([len(s) for s in items], np.int64)
    return words_at(b"".join(items), np.cumsum(lengths) - lengths, lengths,
                    np.empty((len(items), 1 - (-int(lengths.max(initial=0)) // 8)), np.uint64))


def strings_of(rows: np.ndarray) -> list[bytes]:
    data, width = rows[:, :-1].astype(">u8").tobytes(), 8 * (rows.shape[1] - 1)
    return [data[i * width:i * width + n] for i, n in enumerate(rows[:, -1].tolist())]


def ordered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows: their order, and which of them differ from the one before.

    Each round knows one more word of the common prefixes. Only rows that still share
    theirs with others go on to the next word, and those that are equal to the end leave.
    """
    order = np.argsort(rows[:, 0])
    first = rows[order, 0]
    opens = np.ones(len(rows), bool)
    opens[1:] = first[1:] != first[:-1]
    at = np.flatnonzero(~(opens & np.append(opens[1:], True))) if len(rows) else order
    for c in range(1, rows.shape[1]):
        if not len(at):
            break
        now = order[at]
        block = np.cumsum(opens[at]) - 1
        differ = np.empty(len(at) - 1, bool)
        for i in range(0, len(differ), BLOCK):
            tied = rows[now[i:i + BLOCK + 1]]
            differ[i:i + BLOCK] = (tied[1:, c:] != tied[:-1, c:]).any(axis=1)
        differ &= block[1:] == block[:-1]
        mixed = np.zeros(int(block[-1]) + 1, bool)
        mixed[block[1:][differ]] = True
        mixed = mixed[block]
        at, now, block, word = at[mixed], now[mixed], block[mixed].astype(np.uint64), rows[now[mixed], c]
        if not len(at):
            break
        by = np.argsort(word)
        word = word[by]
        rank = np.zeros(len(by), np.uint64)
        np.cumsum(word[1:] != word[:-1], out=rank[1:])
        key = block[by] << np.uint64(32) | rank
        then = np.argsort(key)
        key = key[then]
        order[at] = now[by[then]]
        opens[at[1:]] |= key[1:] != key[:-1]
        begins = np.append(True, key[1:] != key[:-1])
        at = at[~(begins & np.append(begins[1:], True))]
    return order, opens


def common_words(rows: np.ndarray) -> np.ndarray:
    """Whole words that each row's string has in common with the one before."""
    out = np.zeros(len(rows), np.int64)
    width = rows.shape[1] - 1
    if len(rows) > 1 and width:
        differ = rows[1:, :-1] != rows[:-1, :-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        out[1:] = np.minimum(out[1:], np.minimum(rows[1:, -1], rows[:-1, -1]).astype(np.int64) // 8)
    return out


def common_bytes(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row's string has in common with the one before."""
    words = common_words(rows)
    if len(rows) < 2:
        return words
    both = np.minimum(rows[1:, -1], rows[:-1, -1]).astype(np.int64)
    i, c = np.arange(1, len(rows)), np.minimum(words[1:], rows.shape[1] - 2)
    apart = 8 - np.searchsorted(_BYTES, rows[i, c] ^ rows[i - 1, c], side="right")
    return np.append(0, np.minimum(8 * words[1:] + np.where(words[1:] == c, apart, 0), both))


def mix(columns: Iterable[np.ndarray]) -> np.ndarray:
    """A hash of 64 bits of each string in columns of words."""
    out = np.uint64(0)
    for column in columns:
        out = (out ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(32)
    return out


# --- anchors -----------------------------------------------------------------

def hashes(buffer: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the k bytes from each position, by doubling."""
    power = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    span, width, out, at = buffer.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if k & width:
            part = span[at:]
            out = part.copy() if out is None else out[:len(part)] * power(width) + part[:len(out)]
            at += width
        if width * 2 > k:
            break
        span = span[:-width] * power(width) + span[width:]
        width *= 2
    out = out[:len(buffer) - k + 1]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` values in a row, by doubling."""
    n, span, out = len(values) - width + 1, 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[:n], out[width - span:width - span + n])


def least_hashes(buffer: np.ndarray) -> np.ndarray:
    """The least hashed K bytes of each window, block by block, so that a block stays in the cache."""
    out = np.empty(len(buffer) - LEAST + 1, np.uint64)
    for i in range(0, len(out), BLOCK):
        out[i:i + BLOCK] = least_of(hashes(buffer[i:i + BLOCK + LEAST - 1], K), LEAST - K + 1)
    return out


def anchored(buffer: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with one anchor: hash, first window, windows, document.

    ``buffer`` is the documents behind each other; no window crosses two of them.
    """
    none = np.zeros(0, np.int64)
    if len(buffer) < LEAST:
        return np.zeros(0, np.uint64), none, none, none
    n, ends = len(buffer) - LEAST + 1, np.cumsum(lengths)
    begins = (ends - lengths)[lengths >= LEAST]
    firsts, leasts, last = [], [], None
    for i in range(0, n, BLOCK):
        block = least_hashes(buffer[i:i + BLOCK + LEAST - 1])
        opens = np.zeros(len(block), bool)
        opens[1:] = block[1:] != block[:-1]
        opens[0] = last is not None and block[0] != last
        opens[begins[slice(*np.searchsorted(begins, [i, i + len(block)]))] - i] = True
        at, last = np.flatnonzero(opens), block[-1]
        firsts.append(at + i)
        leasts.append(block[at])
    first, least = np.concatenate(firsts), np.concatenate(leasts)
    doc = np.searchsorted(ends, first, side="right")
    # a stretch goes on to the next one or to the last window of its document
    size = np.minimum(np.append(first[1:], n), ends[doc] - LEAST + 1) - first
    inside = size > 0
    first, size, doc, least = first[inside], size[inside], doc[inside], least[inside]
    parts = -(-size // MOST_WINDOWS)
    start = np.repeat(first, parts)
    nth = np.arange(len(start)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = start + nth * MOST_WINDOWS
    windows = np.minimum(np.repeat(size, parts) - nth * MOST_WINDOWS, MOST_WINDOWS)
    # least hashes are small numbers; mixed again they spread evenly over the ranges
    mixed = np.repeat(least, parts)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(30)
    return mixed, start, windows, np.repeat(doc, parts)


class Sent(NamedTuple):
    """Suffixes of shared anchors and windows of hot ones: sorted strings (key, text, length), each once with its smallest
    doc_id, and per stretch, or window, its string.

    The key is the anchor's or that of a hot window itself, so suffixes of one anchor are neighbours. Only bytes
    decide what is equal.
    """

    rows: np.ndarray
    ids: np.ndarray
    item: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    doc_id: np.ndarray
    #: Stretches that are sent whole; the windows come behind them.
    cold: int


def counted(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0 to n - 1 for each n: which n, and the number."""
    each = np.repeat(np.arange(len(n)), n)
    return each, np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)


def full_masks(windows: np.ndarray) -> np.ndarray:
    return ((np.uint64(1) << windows.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)


def in_ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of the ``n`` ranges begins in sorted keys."""
    return np.searchsorted(keys, np.array([i * (1 << KEY_BITS) // n for i in range(n + 1)], np.uint64))


def keyed(rows: np.ndarray) -> np.ndarray:
    """The key as the first eight bytes of the string."""
    return np.column_stack([rows[:, :-1], rows[:, -1] + np.uint64(8)])


class Run:
    """The documents of a stored run and their anchors."""

    def __init__(self, doc_ids: list[int | None], lengths: list[int], text: bytes) -> None:
        self.doc_ids, self.lengths, self.text = doc_ids, np.array(lengths, np.int64), spread(text)
        self.rank_id = np.array([_NO_ID if d is None else d for d in doc_ids], np.int64)
        hashed, self.start, self.windows, self.doc = anchored(np.frombuffer(self.text, np.uint8), self.lengths)
        self.keys, self.inverse = np.unique(hashed >> np.uint64(64 - KEY_BITS), return_inverse=True)

    def in_two_documents(self) -> np.ndarray:
        """Per key, whether two documents of the run have it."""
        ids = self.rank_id[self.doc] if len(self.doc) else np.zeros(0, np.int64)
        low, high = np.full(len(self.keys), _NO_ID), np.full(len(self.keys), -_NO_ID - 1)
        np.minimum.at(low, self.inverse, ids)
        np.maximum.at(high, self.inverse, ids)
        return low < high

    def ranges(self, n: int) -> np.ndarray:
        """Where each of the ``n`` ranges of keys begins."""
        return in_ranges(self.keys, n)

    def _flag(self, flags: np.ndarray) -> np.ndarray:
        return flags[self.inverse] if len(self.inverse) else np.zeros(0, np.uint8)

    def sent(self, flags: np.ndarray) -> Iterator[Sent]:
        """What the run sends, in parts of MOST_STRINGS: most runs have one, those full of hot anchors more."""
        flag = self._flag(flags)
        n = np.where(flag == 2, self.windows, flag > 0)
        at = np.flatnonzero(n)
        part = (np.cumsum(n[at]) - n[at]) // MOST_STRINGS
        for some in np.split(at, np.flatnonzero(part[1:] != part[:-1]) + 1):
            yield self._part(some[flag[some] == 1], some[flag[some] == 2])

    def _part(self, cold: np.ndarray, hot: np.ndarray) -> Sent:
        each, nth = counted(self.windows[hot])
        start = np.concatenate([self.start[cold], self.start[hot][each] + nth])
        windows = np.concatenate([self.windows[cold], np.ones(len(each), np.int64)])
        doc_id = self.rank_id[np.concatenate([self.doc[cold], self.doc[hot][each]])] if len(start) else start
        rows = np.empty((len(start), TEXT_WORDS + 2), np.uint64)
        words_at(self.text, start, windows + (LEAST - 1), rows[:, 1:])
        rows[:len(cold), 0] = self.keys[self.inverse[cold]]
        rows[len(cold):, 0] = mix(rows[len(cold):, 1:WINDOW_WORDS + 1].T) >> np.uint64(64 - KEY_BITS)
        order, opens = ordered(rows)
        rows, item = rows[order[opens]], np.empty(len(order), np.int64)
        item[order] = np.cumsum(opens) - 1
        ids = np.minimum.reduceat(doc_id[order], np.flatnonzero(opens)) if len(order) else doc_id
        return Sent(rows, ids, item, start, windows, doc_id, len(cold))

    def gone(self, answered: Iterable[tuple[Sent, np.ndarray]]) -> np.ndarray:
        """Which bytes go, from what the run sent and a mask for each string."""
        # a byte is in LEAST windows at most
        open_at = np.zeros(len(self.text) + 1, np.int8)
        for sent, masks in answered:
            full = full_masks(sent.windows)
            mask = np.where(sent.doc_id > sent.ids[sent.item], full, masks[sent.item])
            # no two stretches begin or end at one place
            whole = mask == full
            a, n = sent.start[whole], sent.windows[whole]
            open_at[a] += 1
            open_at[a + (n + LEAST - 1)] -= 1
            part = np.flatnonzero(~whole & (mask > 0))
            each, nth = counted(sent.windows[part])
            found = mask[part][each] >> nth.astype(np.uint32) & np.uint32(1) > 0
            a = sent.start[part][each[found]] + nth[found]
            open_at[a] += 1
            open_at[a + LEAST] -= 1
        return np.cumsum(open_at[:-1], dtype=np.int8) > 0

    def shared(self, flags: np.ndarray) -> tuple[dict[bytes, int], dict[bytes, int]]:
        """What the run sends as strings (key and text) with their doc_ids: suffixes, and windows of hot anchors."""
        both: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
        for sent in self.sent(flags):
            hot = np.zeros(len(sent.rows), bool)
            hot[sent.item[sent.cold:]] = True
            for s, d, h in zip(strings_of(keyed(sent.rows)), sent.ids.tolist(), hot.tolist()):
                both[h][s] = min(d, both[h].get(s, d))
        return both

    def removed(
        self, flags: np.ndarray, masks: dict[bytes, int], bits: dict[bytes, bool],
        shared: tuple[dict, dict] | None = None,
    ) -> np.ndarray:
        """Which bytes go, from the answers for strings and what was sent as such."""
        found, ids = masks | bits, {}
        for one in shared or self.shared(flags):
            ids |= one
        parts = []
        for sent in self.sent(flags):
            strings = strings_of(keyed(sent.rows))
            least = np.array([ids[s] for s in strings], np.int64)
            parts.append((sent._replace(ids=least), np.array([found[s] for s in strings], np.uint32)))
        return self.gone(parts)


# --- front coding and the merge -------------------------------------------------

def coded(rows: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted rows, front-coded; those at ``begins`` are whole: (common words, length) pairs, the words behind, words to each row."""
    common = common_words(rows)
    common[begins] = 0
    used = -(-rows[:, -1].astype(np.int64) // 8)
    at = np.arange(rows.shape[1] - 1)
    tails = rows[:, :-1][(at >= common[:, None]) & (at < used[:, None])]
    return np.column_stack([common, rows[:, -1]]).astype(np.uint8), tails.astype(">u8"), np.append(0, np.cumsum(used - common))


def decoded(pairs: np.ndarray, tails: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The rows again, into zeros; each word that is not in the tails is that of the last row that has it."""
    common, used = pairs[:, :1], -(-pairs[:, 1:].astype(np.int64) // 8)
    at = np.arange(out.shape[1] - 1)
    out[:, :-1][(at >= common) & (at < used)] = tails
    out[:, -1] = pairs[:, 1]
    number = np.arange(len(pairs))
    for c in range(int(common.max(initial=0))):
        known = common[:, 0] > c
        has = np.maximum.accumulate(np.where(known, 0, number))
        out[known, c] = out[has[known], c]
    return out


def front_code(items: list[bytes]) -> tuple[bytes, bytes]:
    """Sorted strings as (common prefix in words, length) pairs and the words behind the prefixes."""
    if not items:
        return b"", b""
    pairs, tails, _ = coded(words_of(items), np.zeros(1, np.int64))
    return pairs.tobytes(), tails.tobytes()


def front_decode(pairs: bytes, tails: bytes) -> tuple[list[bytes], list[int]]:
    """The strings again, and their common prefixes with the one before."""
    numbers = np.frombuffer(pairs, np.uint8).reshape(-1, 2)
    rows = decoded(numbers, np.frombuffer(tails, ">u8"),
                   np.zeros((len(numbers), 1 - (-int(numbers[:, 1].max(initial=0)) // 8)), np.uint64))
    return strings_of(rows), common_bytes(rows).tolist()


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differ.bit_length() + 7) // 8


def merge(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Merge sorted runs: (common prefix with the string before, run, place in the run)."""
    rows = words_of([s for strings, _ in runs for s in strings])
    run, place = counted(np.array([len(strings) for strings, _ in runs], np.int64))
    order, _ = ordered(rows)
    yield from zip(common_bytes(rows[order]).tolist(), run[order].tolist(), place[order].tolist())


def windows_of(rows: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Columns of windows: of the words and key of each row (sorted by falling ``count``), the first, the second and so on.

    A window is its words, first bytes highest, the rest zero, and the key of its row.
    """
    text, sizes = np.ascontiguousarray(rows[:, 1:-1].T), np.searchsorted(-count, -np.arange(MOST_WINDOWS))
    out = np.empty((WINDOW_WORDS + 1, int(sizes.sum())), np.uint64)
    end = 0
    for nth, m in enumerate(sizes.tolist()):
        begin, end = end, end + m
        word, left = nth // 8, np.uint64(nth % 8 * 8)
        for j in range(WINDOW_WORDS):
            own = out[j, begin:end]
            np.left_shift(text[word + j, :m], left, out=own)
            if left and word + j + 1 < len(text):
                own |= text[word + j + 1, :m] >> np.uint64(64) - left
        own &= _LEFT[LEAST - 8 * (WINDOW_WORDS - 1)]
        out[-1, begin:end] = rows[:m, 0]
    return out


def equal_windows(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal windows are neighbours, and which of them differ from the one before.

    Windows are sorted by a hash and then compared; if two with one hash differ, all are sorted by their words.
    """
    mixed = mix(columns)
    order = np.argsort(mixed)
    mixed = mixed[order]
    opens, differ = np.ones(len(order), bool), np.zeros(max(0, len(order) - 1), bool)
    opens[1:] = mixed[1:] != mixed[:-1]
    for column in columns:
        column = column[order]
        differ |= column[1:] != column[:-1]
    if (differ & ~opens[1:]).any():
        return ordered(np.ascontiguousarray(columns.T))
    return order, opens


def least_ids(rows: np.ndarray, count: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Per window and row, the smallest doc_id of rows with the key that have the window; _NO_ID behind a row's windows."""
    by = np.argsort(-count)
    falling, id_of = count[by], ids[by]
    sizes = np.searchsorted(-falling, -np.arange(MOST_WINDOWS)).tolist()
    order, opens = equal_windows(windows_of(rows[by], falling))
    each = np.concatenate([id_of[:m] for m in sizes])
    least = np.empty(len(each), np.int64)
    least[order] = np.minimum.reduceat(each[order], np.flatnonzero(opens))[np.cumsum(opens) - 1]
    out, begin = np.full((MOST_WINDOWS, len(rows)), _NO_ID), 0
    for nth, m in enumerate(sizes):
        out[nth, by[:m]] = least[begin:begin + m]
        begin += m
    return out


def answers(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Per string of all runs: a bit per window, set if a smaller doc_id than its own has it."""
    out = np.zeros(len(rows), np.uint32)
    if not len(rows):
        return out
    order, opens = ordered(rows)
    doc_id, at = ids[order], np.flatnonzero(opens)
    least, length = np.minimum.reduceat(doc_id, at), np.diff(np.append(at, len(order)))
    heads = rows[order[at]]
    count = heads[:, -1].astype(np.int64) - (LEAST - 1)
    found = np.where(doc_id > np.repeat(least, length), np.repeat(full_masks(count), length), np.uint32(0))
    # an anchor with one suffix is done; the windows of the others meet
    begins = np.flatnonzero(np.append(True, heads[1:, 0] != heads[:-1, 0]))
    suffixes = np.diff(np.append(begins, len(heads)))
    left = np.flatnonzero(np.repeat(suffixes > 1, suffixes))
    if len(left):
        # whole anchors, about AT_ONCE windows
        group = np.repeat(np.arange(len(begins)), suffixes)[left]
        before = np.cumsum(count[left]) - count[left]
        part = before[np.searchsorted(group, group)] // AT_ONCE
        for some in np.split(left, np.flatnonzero(part[1:] != part[:-1]) + 1):
            smallest = least_ids(heads[some], count[some], least[some])
            high = np.where(np.arange(MOST_WINDOWS)[:, None] < count[some], smallest, -1).max(axis=0)
            which, nth = counted(length[some])
            place = at[some][which] + nth
            d = doc_id[place]
            # most rows lose all windows or none
            mixed = np.flatnonzero((d > smallest.min(axis=0)[which]) & (d <= high[which]))
            found[place] = np.where(d > high[which], full_masks(count[some])[which], np.uint32(0))
            bits, d, which = np.zeros(len(mixed), np.uint32), d[mixed], which[mixed]
            for nth in range(MOST_WINDOWS):
                bits |= (smallest[nth, which] < d).astype(np.uint32) << np.uint32(nth)
            found[place[mixed]] = bits
    out[order] = found
    return out


# --- the three exchanges -------------------------------------------------------

#: A row is megabytes, and the writer looks at its memory every 100 rows unless told otherwise.
RUN_FILES = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
RUNS = "run string, doc_ids array<bigint>, lengths array<bigint>, n_bytes bigint, text binary"


def stored_runs(docs: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """The documents in runs of some MB, written once so that every step sees the same ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple[list, list[bytes]]] = []
        n = 0

        def out() -> pa.RecordBatch:
            texts = [t for _, ts in held for t in ts]
            return pa.RecordBatch.from_arrays([
                pa.array([f"{part}-{number}"]), pa.array([[d for ds, _ in held for d in ds]], pa.list_(pa.int64())),
                pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([n], pa.int64()),
                pa.array([squeeze(b"".join(texts))], pa.binary()),
            ], ["run", "doc_ids", "lengths", "n_bytes", "text"])

        for batch in pieces_of(batches, "text", run_bytes):
            texts = texts_of(batch)
            if held and n + sum(map(len, texts)) > run_bytes:
                yield out()
                number, held, n = number + 1, [], 0
            held.append((batch.column(0).to_pylist(), texts))
            n += sum(map(len, texts))
        if held:
            yield out()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(run, RUNS), "suffix-runs", RUN_FILES)


def _runs_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Run]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(c)[i].as_py() for c, name in enumerate(batch.schema.names)}
            yield row, Run(row["doc_ids"], row["lengths"], row.pop("text"))


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def gaps_of(keys: np.ndarray) -> bytes:
    """Sorted keys, coded by their gaps."""
    return planes(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))


def keys_of(gaps: bytes) -> np.ndarray:
    return np.cumsum(from_planes(gaps, "<u8"), dtype=np.uint64)


def anchor_flags(runs: DataFrame, ranges: int, hot_runs: int = HOT_STRETCHES) -> DataFrame:
    """run, flags: per range, 0/1/2 for each key of the run: alone, shared, hot."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, own in _runs_in(batches):
            cuts, twice = own.ranges(ranges), own.in_two_documents()
            times = np.bincount(own.inverse, minlength=len(own.keys)).astype("<u4")
            rows = []
            for r in range(ranges):
                a, b = cuts[r], cuts[r + 1]
                if a < b:
                    rows.append((r, row["run"], gaps_of(own.keys[a:b]), planes(times[a:b]), np.packbits(twice[a:b]).tobytes()))
            yield _batch(rows, ["range", "run", "gaps", "times", "twice"],
                         [pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [keys_of(gaps) for gaps in rows["gaps"]]
        twice = [np.unpackbits(np.frombuffer(bits, np.uint8))[:len(k)] for bits, k in zip(rows["twice"], keys)]
        joined = np.concatenate(keys)
        order = np.argsort(joined)
        joined = joined[order]
        at = np.flatnonzero(np.append(True, joined[1:] != joined[:-1]))
        counts = np.diff(np.append(at, len(joined)))
        within = np.logical_or.reduceat(np.concatenate(twice)[order], at)
        times = np.add.reduceat(np.concatenate([from_planes(t, "<u4") for t in rows["times"]])[order].astype(np.int64), at)
        shared = (counts > 1) | within
        flag = np.empty(len(order), np.uint8)
        flag[order] = np.repeat(np.where(shared & (times > hot_runs), 2, shared).astype(np.uint8), counts)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        return pd.DataFrame({
            "run": rows["run"], "range": rows["range"],
            "flags": [squeeze(f.tobytes()) for f in np.split(flag, cuts)],
        })

    sent = runs.mapInArrow(send, "range int, run string, gaps binary, times binary, twice binary")
    met = sent.groupBy("range").applyInPandas(meet, "run string, range int, flags binary")
    return met.groupBy("run").agg(F.collect_list(F.struct("range", "flags")).alias("flags"))


def _flags_of(row: dict) -> np.ndarray:
    parts = [spread(f["flags"]) for f in sorted(row["flags"] or [], key=lambda f: f["range"])]
    return np.frombuffer(b"".join(parts), np.uint8)


def _dealt(shared: tuple[dict, dict], ranges: int) -> Iterator[tuple[int, int, list[bytes], list[int]]]:
    """kind, range, sorted strings and their smallest doc_ids of what a run sends."""
    for kind, found in enumerate(shared):
        items = sorted(found)
        cuts = in_ranges(np.array([int.from_bytes(s[:8], "big") for s in items], np.uint64), ranges).tolist()
        for r, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                yield kind, r, items[a:b], [found[s] for s in items[a:b]]


def met_strings(
    keys: list[np.ndarray], ids: list[np.ndarray], pairs: list[np.ndarray], tails: list[np.ndarray],
) -> list[np.ndarray]:
    """The masks of each run's strings in a range, by slices of keys, so that few strings are spread at once."""
    low, high = int(min(k[0] for k in keys)), int(max(k[-1] for k in keys)) + 1
    slices = -(-sum(map(len, keys)) // AT_ONCE)
    bounds = np.array([low + (high - low) * i // slices for i in range(slices + 1)], np.uint64)
    cuts = [np.searchsorted(k, bounds).tolist() for k in keys]
    words = [np.append(0, np.cumsum(-(-p[:, 1].astype(np.int64) // 8) - p[:, 0])) for p in pairs]
    out: list[list[np.ndarray]] = [[] for _ in keys]
    for i in range(slices):
        some = [(n, slice(c[i], c[i + 1]), slice(w[c[i]], w[c[i + 1]])) for n, (c, w) in enumerate(zip(cuts, words)) if c[i] < c[i + 1]]
        if not some:
            continue
        ends = np.cumsum([own.stop - own.start for _, own, _ in some])
        strings = np.zeros((int(ends[-1]), TEXT_WORDS + 2), np.uint64)
        np.concatenate([keys[n][own] for n, own, _ in some], out=strings[:, 0])
        # a key's first string is whole in each run
        decoded(np.concatenate([pairs[n][own] for n, own, _ in some]), np.concatenate([tails[n][w] for n, _, w in some]), strings[:, 1:])
        found = answers(strings, np.concatenate([ids[n][own] for n, own, _ in some]))
        for (n, *_), masks in zip(some, np.split(found, ends[:-1])):
            out[n].append(masks)
    return [np.concatenate(masks) for masks in out]


def window_answers(flagged: DataFrame, ranges: int) -> DataFrame:
    """run, answers: per part and range, a mask for each string that the run sent."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, own in _runs_in(batches):
            for part, (strings, ids, *_) in enumerate(own.sent(_flags_of(row))):
                cuts = in_ranges(strings[:, 0], ranges)
                # strings of two anchors have nothing in common
                other = np.flatnonzero(np.append(True, strings[1:, 0] != strings[:-1, 0])) if len(strings) else cuts[:0]
                pairs, tails, words = coded(strings[:, 1:], other)
                rows = []
                for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                    if a < b:
                        rows.append((r, row["run"], part, gaps_of(strings[a:b, 0]), planes(ids[a:b].astype("<i8")),
                                     squeeze(pairs[a:b].T.tobytes()), squeeze(tails[words[a]:words[b]].tobytes())))
                yield _batch(rows, ["range", "run", "part", "gaps", "ids", "pairs", "tails"],
                             [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        pairs = [np.frombuffer(spread(p), np.uint8).reshape(2, -1).T for p in rows["pairs"]]
        masks = met_strings(
            [keys_of(g) for g in rows["gaps"]], [from_planes(i, "<i8") for i in rows["ids"]], pairs,
            [np.frombuffer(spread(t), ">u8") for t in rows["tails"]],
        )
        return pd.DataFrame({
            "run": rows["run"], "part": rows["part"], "range": rows["range"], "masks": [planes(m.astype("<u4")) for m in masks],
        })

    sent = flagged.mapInArrow(send, "range int, run string, part int, gaps binary, ids binary, pairs binary, tails binary")
    met = sent.groupBy("range").applyInPandas(meet, "run string, part int, range int, masks binary")
    return met.groupBy("run").agg(F.collect_list(F.struct("part", "range", "masks")).alias("answers"))


def cut_documents(answered: DataFrame, with_text: bool) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, ``with_text``, the bytes that stay."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, own in _runs_in(batches):
            got: dict[int, list[np.ndarray]] = {}
            for a in sorted(row["answers"] or [], key=lambda a: a["range"]):
                got.setdefault(a["part"], [np.zeros(0, np.uint32)]).append(from_planes(a["masks"], "<u4"))
            gone = own.gone(
                (sent, np.concatenate(got[part]) if part in got else np.zeros(0, np.uint32))
                for part, sent in enumerate(own.sent(_flags_of(row)))
            )
            text, ends = np.frombuffer(own.text, np.uint8), np.cumsum(own.lengths)
            begins = ends - own.lengths
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            first = begins[own.lengths > 0]
            opens[first] = gone[first]
            sums, counts = np.zeros(len(gone) + 1, np.int32), []
            for x in (gone, opens):
                np.cumsum(x, out=sums[1:])
                counts.append((sums[ends] - sums[begins]).tolist())
            del opens, sums
            rows = []
            for doc_id, a, n, removed, spans in zip(own.doc_ids, begins.tolist(), own.lengths.tolist(), *counts):
                kept = text[a:a + n][~gone[a:a + n]].tobytes() if removed else own.text[a:a + n]
                rows.append((doc_id, n, removed, spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
            yield _batch(rows, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])],
                         [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if with_text else [])])

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return answered.mapInArrow(cut, schema + (", kept binary" if with_text else ""))


def remove_repeats(
    docs: DataFrame, with_text: bool = False, run_bytes: int = RUN_BYTES, hot_runs: int = HOT_STRETCHES, ranges: int | None = None,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the bytes that stay).

    Null text is empty. Rows that repeat a doc_id are judged each; a document never
    counts against one with the same id. A null doc_id counts as the largest.
    Texts shorter than LEAST bytes stay whole. An empty table gives no rows. An anchor
    with more than ``hot_runs`` stretches, summed over all runs, is hot; a run that has it
    counts one at least.
    """
    runs = stored_runs(docs, run_bytes)
    if ranges is None:
        total = runs.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
        ranges = max(48, total // 16 // RANGE_KEYS)
    flags = materialize(anchor_flags(runs, ranges, hot_runs), "anchor-flags")
    flagged = runs.join(flags, "run", "left")
    found = materialize(window_answers(flagged, ranges), "window-answers")
    return cut_documents(flagged.join(found, "run", "left"), with_text)
