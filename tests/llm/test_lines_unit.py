"""Edit distance and segment keys of the line join, against plain definitions."""

from __future__ import annotations

import random

import numpy as np

from tracefold.llm.lines import join_entries, within
from tracefold.llm.words import prefix_hashes


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def edited(r: random.Random, text: bytes, n: int) -> bytes:
    s = bytearray(text)
    for _ in range(n):
        at = r.randrange(len(s) + 1)
        kind = r.randrange(3)
        if kind == 0:
            s.insert(at, r.randrange(97, 100))
        elif at < len(s):
            if kind == 1:
                del s[at]
            else:
                s[at] = r.randrange(97, 100)
    return bytes(s)


def test_banded_distance_agrees_with_the_table():
    r = random.Random(5)
    for tau in (0, 1, 2, 3):
        for _ in range(1500):
            a = bytes(r.randrange(97, 100) for _ in range(r.randrange(0, 18)))
            b = edited(r, a, r.randrange(0, 5))
            assert within(a, b, tau) == (distance(a, b) <= tau), (a, b, tau)


def test_lines_within_tau_meet_in_a_key():
    r = random.Random(6)
    for tau in (1, 2):
        for _ in range(400):
            a = bytes(r.randrange(97, 100) for _ in range(r.randrange(8 * (tau + 1), 60)))
            b = edited(r, a, r.randrange(0, tau + 1))
            if a == b:
                continue
            data = np.frombuffer(a + b, np.uint8)
            cut = np.array([0, len(a), len(a) + len(b)])
            entries = join_entries(prefix_hashes(data), cut[:-1], cut[1:], np.array([1, 2]), tau)
            index = {(int(k), int(n)) for k, n in entries if not k & 1}
            probes = {(int(k) - 1, int(n)) for k, n in entries if k & 1}
            assert any((k, 3 - n) in index for k, n in probes), (a, b)
