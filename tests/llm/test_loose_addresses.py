"""The quick look for written-out addresses lets through whatever their pattern takes."""

import itertools

from simforge.llm import pii


def test_candidates_are_those_of_the_pattern():
    for (left, right), a, b, word in itertools.product(("[]", "()"), ("", " "), ("", " "), ("at", "AT")):
        text = f"bob {left}{a}{word}{b}{right} example [dot] com"
        spans = [m.span() for m in pii._LOOSE["email"].finditer(text)]
        assert spans and pii.candidates(text, pii.base_spans(text), False) == [(0, *s) for s in spans], text
    assert pii.candidates("plain text", pii.base_spans("plain text"), False) == []
