"""Plain spans of op5 against the contract's patterns, taken one by one, and long runs of one sign."""

import random
import re
import time

import pandas as pd
import pytest

from merchframe.llm import pii

# The contract's patterns, as they stand there.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def by_contract(text):
    def luhn(digits):
        doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
        return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    found = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), order, m.end(), kind))
    return [(s, e, kind) for s, _, e, kind in sorted(found)]


def test_plain_spans_are_the_contracts():
    draw = random.Random(5)
    pieces = ["1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "007.0.0.255", "4242 4242 4242 4242", "4242-4242 4242-42424", "+44 (20) 7946-0958",
              "+1", "a@b.co", "a.b@@c.d", "x@y", "@", ".", "-", " ", "  ", "(", ")", "9", "00", "1234567890123", "٣", "é", "\n", "z"]
    for _ in range(4000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 14)))
        assert pii.plain_spans(text) == by_contract(text), text


def test_plain_spans_of_documents():
    texts = pd.read_parquet("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"]
    for text in texts.dropna():
        assert pii.plain_spans(text) == by_contract(text)


def test_marks_with_blanks_around():
    # The same disguise however the blanks lie, also where the blanks before a mark belong to the mark before it.
    for text in ("bob(at)example(dot)com", "bob (at) example (dot) com", "bob\t( at )  example [dot]com", "bob {AT}example<dot>\tcom"):
        assert (0, len(text), "email") in pii.all_spans(text)[1], text
    assert pii._disguised("a (at) (dot) b") == [(1, 7, "@"), (7, 13, ".")]


LONG = 1_000_000


@pytest.mark.parametrize("name, text, spans", [
    ("digits", "1" * LONG, 0), ("blanks", "a (at) b" + " " * LONG, 0), ("tabs", "(at)" + "\t" * LONG + "x", 0),
    ("dots", "." * LONG, 0), ("parts", "1." * (LONG // 2), LONG // 8), ("brackets", "(" * LONG + "at", 0),
    ("open brackets", "( " * (LONG // 2) + "(at)", 0), ("spelled", "one " * (LONG // 4), 0),
    ("apart", "one two" + " " * LONG + "three", 0), ("signs", "a@" * (LONG // 2), 0),
    ("many addresses", "a@b.co (at) " * (LONG // 12), LONG // 12), ("invisible", "a​" * (LONG // 2), 0),
    ("bare", "a (dot) b" + " x at y" * (LONG // 6), 0)])
def test_long_runs_take_linear_time(name, text, spans):
    began = time.process_time()
    assert len(pii.all_spans(text)[0]) == spans
    assert time.process_time() - began < 30
