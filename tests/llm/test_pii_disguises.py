"""One disguise for every look-alike and digit word of op5, and clean text that looks like one."""

import pytest

from merchframe.llm import pii


def whole(text, kind):
    return (0, len(text), kind) in pii.all_spans(text)[1]


@pytest.mark.parametrize("c", pii.LOOKALIKES)
def test_every_lookalike(c):
    to = pii.LOOKALIKES[c]
    text, kind = {
        "@": (f"bob{c}example.com", "email"), ".": (f"bob@example{c}com", "email"), "-": (f"+44{c}20{c}79460958", "phone"),
        "+": (f"{c}442079460958", "phone"), "(": (f"+44 {c}20) 79460958", "phone"), ")": (f"+44 (20{c} 79460958", "phone"),
    }.get(to, (f"{c}b@example.com", "email"))
    assert whole(text, kind), (hex(ord(c)), to)


def test_full_width_marks():
    assert whole("bob（at）example（dot）com", "email") and whole("４２４２‐４２４２－４２４２‐４２４２", "card")
    assert whole("ｂｏｂ％１＠ｅｘａｍｐｌｅ．ｃｏｍ", "email")
    for clean in ("（442079460958）", "call （0207 946 0958 11） now", "（1234567890）"):
        assert pii.all_spans(clean) == ([], []) and pii.redacted(clean) == clean


@pytest.mark.parametrize("words", [
    "plus four four two oh seven nine four six zero nine five eight",
    "plus vier vier zwei null sieben neun vier sechs null neun fünf acht",
    "Plus VIER vier zwo null sieben neun vier sechs null neun FÜNF acht",
    "plus quatre quatre deux zéro sept neuf quatre six zéro neuf cinq huit",
    "más cuatro cuatro dos cero siete nueve cuatro seis cero nueve cinco ocho",
    "plus one un une uno eins trois tres three drei un",
])
def test_spelled_phones_of_four_languages(words):
    assert whole(words, "phone")


def test_every_digit_word():
    for word, digit in pii.DIGIT_WORDS.items():
        assert whole(f"plus {' '.join([word] * 11)}", "phone"), word
        assert pii.Mapped(t := f"{word} {word} {word} {word}").rewrite(pii._spelled(t)).text == digit * 4


def test_spelled_addresses_and_odd_cases():
    assert whole("eins null Punkt null eins Punkt null zwei Punkt drei", "ip")
    assert whole("uno cero punto cero uno punto cero dos punto tres", "ip")
    assert whole("plus fıve ſix fİve " + "one " * 8 + "two", "phone")
    assert pii.all_spans("un deux trois quatre, puis plus un de moins")[1] == []
