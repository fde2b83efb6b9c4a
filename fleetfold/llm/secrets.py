"""Secret scans: all rules in one automaton, one pass over the bytes of each text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.automaton import Automaton, compile_patterns, exact, scan
from fleetfold.llm.common import pieces_of, texts_of


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost, greedily and without overlap; a match whose
    ``group`` is shorter than ``least`` is dropped. ``trigger`` ends inside every kept
    match: the automaton looks for it."""

    kind: str
    pattern: str
    trigger: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False


_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_VALUE = r"[A-Za-z0-9+/_.=-]"

BASE = [
    Rule("assign", f"{_ASSIGN}({_VALUE}+)", f"{_ASSIGN}{_VALUE}{{8}}", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{12}", 0, 16),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{32}", 0, 32),
]
#: Token shapes beside the base rules; they only add spans.
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]{6}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-[A-Za-z0-9]", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]", 0, 30),
    Rule("private_key", r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----", r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----", 0, 1),
]
RULES = BASE + MORE


def compile_rules(rules: list[Rule]) -> Automaton:
    return compile_patterns([(r.trigger, r.ignore_case) for r in rules])


def find_spans(texts: list[bytes], automaton: Automaton, rules: list[Rule]) -> dict[int, list[tuple[int, int, int]]]:
    """Per text with a match: (start, rule number, end) in order, as byte offsets.

    Where the automaton ends a trigger, the exact pattern is matched in the stretch
    around it that no match can leave: up to the next bytes that reset the automaton.
    """
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    places, states = scan(automaton, joined)
    if not len(places):
        return {}
    walls = np.flatnonzero(automaton.resets[joined])
    right = walls[np.searchsorted(walls, places)]
    before = np.searchsorted(walls, places) - 1
    left = np.where(before >= 0, walls[np.maximum(before, 0)] + 1, 0)
    owner = np.searchsorted(ends, places, side="right")
    todo = {
        (int(d), int(a), int(b), number)
        for d, a, b, s in zip(owner, left, right, states)
        for number in automaton.patterns[s - automaton.accepting]
    }
    compiled = [exact(r.pattern, r.ignore_case) for r in rules]
    raw = joined.tobytes()
    found: dict[int, list[tuple[int, int, int]]] = {}
    for d, a, b, number in todo:
        rule, base = rules[number], int(ends[d]) - len(texts[d]) - 1
        for m in compiled[number].finditer(raw[a:b]):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.setdefault(d, []).append((a + m.start() - base, number, a + m.end() - base))
    return {d: sorted(spans) for d, spans in found.items()}


def code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans counted in characters."""
    if text.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[a]), n, int(before[b])) for a, n, b in spans]


def secrets(docs: DataFrame, rules: list[Rule] = RULES, base: int = len(BASE)) -> DataFrame:
    """doc_id, spans (kind, start, end in characters) and their digest, per row of ``docs``.

    ``base_sha256`` covers the first ``base`` rules. Null text counts as empty and has
    no spans; repeated rows give a row each; an empty table gives none; other columns
    are not looked at.
    """
    automaton = compile_rules(rules)
    kinds = [r.kind for r in rules]
    counted = kinds[:base]
    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in counted) + (
        ", base_sha256 string, spans string, found array<struct<kind:string,start:bigint,end:bigint>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            texts = texts_of(batch)
            found = find_spans(texts, automaton, rules)
            counts = np.zeros((base, len(texts)), np.int64)
            digests, listed = [_digest("")] * len(texts), [""] * len(texts)
            rows: list[list[dict]] = [[] for _ in texts]
            for d, spans in found.items():
                spans = code_points(texts[d], spans)
                for _, number, _ in spans:
                    if number < base:
                        counts[number, d] += 1
                digests[d] = _digest(",".join(f"{kinds[n]}:{a}:{b}" for a, n, b in spans if n < base))
                listed[d] = ",".join(f"{kinds[n]}:{a}:{b}" for a, n, b in spans)
                rows[d] = [{"kind": kinds[n], "start": a, "end": b} for a, n, b in spans]
            struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in counts), pa.array(digests), pa.array(listed), pa.array(rows, pa.list_(struct))],
                ["doc_id", *(f"n_{k}" for k in counted), "base_sha256", "spans", "found"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
