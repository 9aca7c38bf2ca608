"""Equal strings stay together whatever the residues and the length that a pivot shares with them."""
import collections
import random

import numpy as np

from strata.llm import suffix_dedup


def _check(pieces):
    text = b"".join(pieces)
    a = np.frombuffer(text, np.uint8)
    starts = np.arange(len(text) - suffix_dedup.LENGTH + 1)
    total, head = suffix_dedup.repeated_strings(a, starts, np.ones(len(starts)))
    want = collections.Counter(text[i: i + suffix_dedup.LENGTH] for i in starts)
    assert [want[text[i: i + suffix_dedup.LENGTH]] for i in starts] == total.tolist()
    assert all(text[i: i + suffix_dedup.LENGTH] == text[h: h + suffix_dedup.LENGTH] for i, h in zip(starts, head))


def test_a_pivot_that_agrees_on_cover_and_shift_bytes():
    rnd = random.Random(1)
    noise = lambda n: bytes(rnd.randrange(97, 123) for _ in range(n))
    for s in range(31):
        string = noise(suffix_dedup.LENGTH)
        other = bytearray(string)
        other[suffix_dedup.COVER + s] ^= 1  # the pivot comes first and differs just after the bytes its shift decides
        gaps = [noise(rnd.randrange(31)) for _ in range(4)]
        _check([gaps[0], bytes(other), gaps[1], string, gaps[2], string, gaps[3]])


def test_random_ties():
    rnd = random.Random(2)
    noise = lambda n: bytes(rnd.randrange(97, 99) for _ in range(n))
    for _ in range(25):
        base = noise(600)
        pieces = []
        for _ in range(7):
            piece = bytearray(base[rnd.randrange(60): rnd.randrange(450, 600)])
            if rnd.random() < 0.6:
                piece[rnd.randrange(300, len(piece))] ^= 3
            pieces += [noise(rnd.randrange(40)), bytes(piece)]
        _check(pieces)
    _check([b"a" * 1500, b"b", b"a" * 700, b"ab" * 600])
