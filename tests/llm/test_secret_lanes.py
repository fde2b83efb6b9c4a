"""Texts without white space or other bytes that reset the automaton."""

import base64
import random
import re
import time

import numpy as np

from fleetfold.llm import automaton as A
from fleetfold.llm import secrets as S


def brute(text, rules):
    found = []
    for number, rule in enumerate(rules):
        for m in A.exact(rule.pattern, rule.ignore_case).finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), number, m.end()))
    return sorted(found)


def test_long_stretches_without_resets_are_cut_and_exact():
    rng = random.Random(2)
    machine = S.compile_rules(S.RULES)
    noise = base64.b64encode(rng.randbytes(60_000)).rstrip(b"=")
    parts = [b"password=abcdefgh12", b"AKIA" + b"Z9" * 9, b"0123456789abcdef" * 3, b"ghp_" + b"a1B2" * 10]
    for lane in (64, 300, 4096):
        blob = bytearray(noise)
        for i, p in enumerate(parts * 5):
            at = 2900 * (i + 1) + rng.randrange(400)
            blob[at:at + len(p)] = p
        blob = bytes(blob)
        places, states = A.scan(machine, np.frombuffer(blob + b"\n", np.uint8), lane)
        plain, state = [], machine.start
        for i, b in enumerate(blob + b"\n"):
            state = int(machine.moves[state << 8 | b])
            if state >= machine.accepting:
                plain.append((i, state))
        assert sorted(zip(places.tolist(), states.tolist())) == plain
        assert S.find_spans([blob], machine, S.RULES).get(0, []) == brute(blob, S.RULES)


def test_a_blob_takes_no_call_per_byte():
    machine = S.compile_rules(S.RULES)
    for blob in (base64.b64encode(random.Random(1).randbytes(375_000)), b"a" * 500_000, b"0" * 500_000):
        buffer = np.frombuffer(blob + b"\n", np.uint8)
        A.scan(machine, buffer)
        start = time.process_time()
        A.scan(machine, buffer)
        assert time.process_time() - start < 1.5, blob[:10]


def test_every_rule_resets_between_texts():
    assert S.compile_rules(S.RULES).resets[ord("\n")] and not re.search(rb"\n", b"")
