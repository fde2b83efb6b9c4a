"""Public tokenizers over Arrow batches, with each different word encoded once per worker."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core

#: Words whose ids a worker keeps: the first ones, among which the frequent ones are.
KEPT_WORDS, KEPT_BYTES = 400_000, 48
#: Bytes of text whose words are encoded together.
SLICE = 4 << 20
#: Stands between words that are encoded together; words that hold it are encoded alone.
MARK = "\x01"
#: How the byte tokenizer writes a space in its tokens, and the word tokenizer the end of a word. Fixed values.
SPACE_SIGN, WORD_END = "\u0120", "</w>"
#: Latin letters that every step before the merges leaves as they are or lower-cases, and marks behind them.
PLAIN = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")
#: Words with which a text is encoded as a whole by the byte tokenizer: empty, or with white space at an end.
ODD = r"^$|^[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]|[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]$"
#: The character by which both tokenizers write a byte: itself if it can be seen, else the next one from 256 on.
SEEN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_SIGNS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - SEEN))}


class WordEncoder:
    """Ids of texts by the tokenizers library.

    Both tokenizers split a text into words before they merge, and never merge across
    a space, so a text's ids are those of its space-separated words in order. The
    word tokenizer drops white space. The byte tokenizer joins one space to the word
    behind it; where white space is anything but single spaces between words, the
    text is encoded as a whole.

    Both split a run of letters from the marks behind it, so the ids of such a word are
    those of the two. Runs of Latin letters go to the library's model without the
    normalising and splitting that would leave them as they are.
    """

    def __init__(self, path: str, drops_space: bool) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space = drops_space
        self.kept: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.merges = Tokenizer.from_file(path)
        if drops_space:
            self.merges.normalizer = None
            (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.merges.pre_tokenizer = CharDelimiterSplit("\n")
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.begins_word = np.array([t.startswith(SPACE_SIGN) for t in tokens])
        self.ends_word = np.array([t.endswith(WORD_END) for t in tokens])
        signs = BYTE_SIGNS | {b: b for b in SEEN} | {ord("\n"): ord("\n")}
        self.signs = np.array([signs[b] for b in range(256)], "<u2")

    def _ids(self, words: list[str]) -> list[bytes]:
        ids = list(map(self.kept.get, words))
        missing = [w for w, b in zip(words, ids) if b is None]
        fresh = self._encoded(missing)
        room = KEPT_WORDS - len(self.kept)
        if room > 0:
            self.kept.update(islice(((w, b) for w, b in fresh.items() if len(w) <= KEPT_BYTES), room))
        return [fresh[w] if b is None else b for w, b in zip(words, ids)]

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word, and of the runs of letters in them."""
        parts, others, match = {}, [], PLAIN.fullmatch
        for w in words:
            found = match(w)
            # the byte tokenizer's runs are told apart by the space they begin with
            if not found or not self.drops_space and w[0] != " ":
                others.append(w)
            else:
                letters, marks = found.groups()
                parts[w] = (letters.lower().lstrip(" ") if self.drops_space else letters, marks)
        kept = self.kept
        out = self._merged(list({letters for letters, _ in parts.values() if letters not in kept}))
        out.update(self._joint(others))
        for w, (letters, marks) in parts.items():
            if w not in out:
                out[w] = (out[letters] if letters in out else kept[letters]) + self._marks(marks)
        return out

    def _marks(self, marks: str) -> bytes:
        if marks not in self.marks:
            ids = np.array(self.tokenizer.encode(marks, add_special_tokens=False).ids, np.uint32).tobytes()
            if len(self.marks) >= KEPT_BYTES * KEPT_BYTES:
                return ids
            self.marks[marks] = ids
        return self.marks[marks]

    def _merged(self, runs: list[str]) -> dict[str, bytes]:
        """The ids of runs of letters, many in one text with a line each."""
        groups = [runs[a:a + 500] for a in range(0, len(runs), 500)]
        out: dict[str, bytes] = {}
        for at in range(0, len(groups), 20):
            part = groups[at:at + 20]
            raw = [np.frombuffer("\n".join(g).encode(), np.uint8) for g in part]
            lines = [self.signs[r].tobytes().decode("utf-16-le") for r in raw]
            for group, encoding in zip(part, self.merges.encode_batch_fast(lines, add_special_tokens=False)):
                ids = np.array(encoding.ids, np.uint32)
                if self.drops_space:
                    ends = np.flatnonzero(self.ends_word[ids]) + 1
                    starts = np.append(0, ends[:-1])
                else:
                    starts = np.flatnonzero(self.begins_word[ids])
                    ends = np.append(starts[1:], len(ids))
                out.update(_cut(group, ids, starts, ends))
        return out

    def _joint(self, words: list[str]) -> dict[str, bytes]:
        """The ids of any words. Many are encoded as one text, which costs less than a call each.

        In such a text the byte tokenizer's words begin with a token that begins with
        a space; for the word tokenizer a mark stands between them.
        """
        joint = [w for w in words if (MARK not in w if self.drops_space else w[:1] == " ")]
        out: dict[str, bytes] = {}
        groups = [joint[a:a + 500] for a in range(0, len(joint), 500)]
        glue = f" {MARK} " if self.drops_space else ""
        for at in range(0, len(groups), 20):
            part = groups[at:at + 20]
            found = self.tokenizer.encode_batch_fast([glue.join(g) for g in part], add_special_tokens=False)
            for group, encoding in zip(part, found):
                ids = np.array(encoding.ids, np.uint32)
                if self.drops_space:
                    marks = np.flatnonzero(ids == self.mark)
                    starts = np.append(0, marks + 1)
                    ends = np.append(marks, len(ids))
                else:
                    starts = np.flatnonzero(self.begins_word[ids])
                    ends = np.append(starts[1:], len(ids))
                out.update(_cut(group, ids, starts, ends))
        for w in words:
            if w not in out:
                out[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32).tobytes()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text. Null is the empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.drops_space:
            texts = pc.replace_substring(texts, "\n", " ")
            # special tokens are told by their case, so a text that may hold one keeps it
            if not pc.any(pc.match_substring(texts, "<|")).as_py():
                texts = pc.ascii_lower(texts)
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy()
        offsets = offsets - offsets[0]
        coded = split.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        words = coded.dictionary
        whole = np.zeros(n, bool)
        if self.drops_space:
            ids = self._ids(_listed(words))
        else:
            first = offsets[:-1]
            odd = pc.match_substring_regex(words, ODD).to_numpy(zero_copy_only=False)
            whole = np.add.reduceat(odd[codes], first, dtype=np.int64) > 0
            inner = np.ones(len(codes), bool)
            inner[first] = False
            # each word counts twice, as the first of a text and behind a space; odd ones are not looked up
            used = np.zeros((2, len(words)), bool)
            used[0, codes[first]] = True
            used[1, codes[inner]] = True
            used &= ~odd
            place = np.cumsum(used).reshape(used.shape) * used
            codes = np.where(inner, place[1][codes], place[0][codes])
            begin, behind = (words.filter(pa.array(u)) for u in used)
            nothing, space = (pa.scalar(t, pa.large_string()) for t in ("", " "))
            ids = [b"", *self._ids(_listed(begin) + _listed(pc.binary_join_element_wise(nothing, behind, space)))]
        taken = pa.array(ids, pa.large_binary()).take(pa.array(codes))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[:len(codes) + 1] // 4
        out = np.frombuffer(taken.buffers()[2], np.uint32)[:ends[-1]]
        bounds = ends[offsets]
        if not whole.any():
            return out, np.diff(bounds)
        parts, sizes = [], np.diff(bounds)
        for i in range(n):
            if whole[i]:
                got = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
                parts.append(got)
                sizes[i] = len(got)
            else:
                parts.append(out[bounds[i]:bounds[i + 1]])
        return np.concatenate(parts), sizes


def _listed(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def _cut(words: list[str], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[str, bytes]]:
    if len(starts) != len(words):
        raise ValueError("a text of words has another number of words")
    raw = ids.tobytes()
    return ((w, raw[4 * a:4 * b]) for w, a, b in zip(words, starts.tolist(), ends.tolist()))


@lru_cache(maxsize=4)
def encoder(path: str, drops_space: bool) -> WordEncoder:
    """One encoder per Python worker, file and kind."""
    return WordEncoder(path, drops_space)


def with_end(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id behind each document."""
    more = lengths + 1
    out = np.full(int(more.sum()), end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(more) - 1] = False
    out[keep] = ids
    return out, more
