from __future__ import annotations

import numpy as np
from texts import given

from eventloom.llm import sketches
from eventloom.llm.sketches import containment, likeness


def sketch(text, scale=1):
    return sketches.sketch(text, scale=scale)


def shingles(text):
    words = text.encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_short_within_long():
    """Texts of any length are contained and alike as their shingles are."""
    long = " ".join(f"word{k}" for k in range(900))
    for n in (5, 6, 8, 12, 20, 40, 100):
        for at in range(0, 800, 50):
            short = " ".join(long.split()[at : at + n])
            assert containment(sketch(short), sketch(long)) == 1
            assert abs(likeness(sketch(short), sketch(long)) - (n - 4) / 896) < 1e-12


def test_given_halves():
    for _, text, _ in given():
        half = text[: len(text) // 2]
        x, y = shingles(half), shingles(text)
        if x:
            assert abs(containment(sketch(half), sketch(text)) - len(x & y) / len(x)) < 1e-12
            assert abs(likeness(sketch(half), sketch(text)) - len(x & y) / len(x | y)) < 1e-12


def test_sketches_merge():
    a, b = "one two three four five six", "six seven eight nine ten"
    for scale in (1, 4):
        assert set(sketch(a, scale=scale).tolist()) <= set(sketch(a + " " + b, scale=scale).tolist())


def test_half_of_the_hashes():
    """The default keeps what lies below half of the range: nothing else, and all of it.
    Estimates scatter by the number of hashes, and short texts stay contained in long ones."""
    errors = []
    for _, text, _ in given():
        half = text[: len(text) // 2]
        kept, full = sketches.sketch(text), sketch(text)
        assert kept.tolist() == [h for h in full.tolist() if h < 2**63]
        if len(sketches.sketch(half)):
            assert set(sketches.sketch(half)[:-1].tolist()) - set(kept.tolist()) <= set(sketch(half).tolist()) - set(full.tolist())
            error = likeness(sketches.sketch(half), kept) - likeness(sketch(half), full)
            errors.append(error * np.sqrt(len(full)))
    assert abs(np.mean(errors)) < 0.2 and np.std(errors) < 1
