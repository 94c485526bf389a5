"""Gaps and insertions inside a template, and repeats of short notices."""

import random

import pytest

from skyledger.llm import licenses
from skyledger.llm.license_texts import TEMPLATES

MIT = [w.decode() for w in licenses.tokens(TEMPLATES["mit"])]


def scan(text):
    return licenses.Index(TEMPLATES).scan(text, 0.8)[1]


@pytest.mark.parametrize("gap", [3, 8, 9, 12, 17])
def test_words_missing_in_the_middle(gap):
    noise = [f"noise{i}" for i in range(30)]
    found = [m for m in scan(" ".join(noise + MIT[:35] + MIT[35 + gap :] + noise)) if m[0] == "mit"]
    n = len(licenses.tokens(TEMPLATES["mit"]))
    assert found == [("mit", round((n - gap) / n, 6), 30, 30 + n - gap)]


@pytest.mark.parametrize("line", [8, 9, 20, 300])
def test_line_inserted(line):
    inside = [f"line{i}" for i in range(line)]
    found = [m for m in scan(" ".join(MIT[:40] + inside + MIT[40:])) if m[0] == "mit"]
    assert found == [("mit", 1.0, 0, len(licenses.tokens(TEMPLATES["mit"])) + line)]


def test_too_little_is_not_reported():
    assert not [m for m in scan(" ".join(MIT[:30] + MIT[50:])) if m[0] == "mit"]
    assert not [m for m in scan(" ".join(MIT[45:] + MIT[:45])) if m[0] == "mit"]  # not in template order


@pytest.mark.parametrize("between", ["", "Photo {}:", "see the next picture {} on the wall of the room:"])
def test_every_repeat_of_a_notice_is_reported(between):
    text, want, at = [], [], 0
    for i in range(50):
        text += [between.format(i), "Licensed under CC BY 4.0."]
        at += len(licenses.tokens(between.format(i)))
        want.append(("cc-by-4.0-notice", 1.0, at, at + 6))
        at += 6
    assert [m for m in scan(" ".join(text)) if m[0] == "cc-by-4.0-notice"] == want


def test_incomplete_copy_takes_nothing_from_the_next():
    found = [m for m in scan("Licensed under CC BY 4. Photo: Licensed under CC BY 4.0.") if m[0] == "cc-by-4.0-notice"]
    assert found == [("cc-by-4.0-notice", round(5 / 6, 6), 0, 5), ("cc-by-4.0-notice", 1.0, 6, 12)]


def test_many_long_copies():
    draw, text = random.Random(5), []
    for _ in range(20):
        text += [f"x{draw.randrange(99)}" for _ in range(draw.randrange(40))] + MIT
    found = [m for m in scan(" ".join(text)) if m[0] == "mit"]
    assert [m[1] for m in found] == [1.0] * 20 and all(a[3] <= b[2] for a, b in zip(found, found[1:], strict=False))
    assert all(m[3] - m[2] == len(licenses.tokens(TEMPLATES["mit"])) for m in found)
