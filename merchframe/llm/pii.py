"""Personal data in whole texts, with offsets into the original also where it is disguised.

Plain identifiers are found in the text as it stands. Then three transducers write a normalised
text beside a map from every normalised character back to its source span:

1. characters: full-width forms, look-alike Greek and Cyrillic letters, other digits and dashes
   become ASCII; zero-width characters vanish;
2. words: runs of at least four spelled digits ("four two oh one") in English, German, French or
   Spanish become digits, "plus" before such a run becomes "+", "dot" between them "." ;
3. disguises of an address: "(at)", "[dot]", "{at}" and the like, with or without blanks around
   them, become "@" and "."; bare " at " and " dot " count only in the full shape
   name at host dot ending, with a known ending.

The same patterns run on the normalised text; their spans are mapped back. A disguised span is
added unless a plain span of its kind covers it.
"""

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from merchframe.llm.common import ship_package

KINDS = ("email", "ip", "card", "phone")
#: Texts that a worker rewrites before it hands them on.
OUT_ROWS = 200
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that begins inside a run of digits also begins at the run's first digit, so only that one is tried.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")

# Look-alikes of Latin letters, spelled digits and endings that bare words may take.
LOOKALIKES = {c: to for to, group in [
    ("a", "аα"), ("e", "е"), ("o", "оοο"), ("p", "рρ"), ("c", "с"), ("y", "у"), ("x", "х"), ("i", "іι"),
    ("s", "ѕ"), ("j", "ј"), ("h", "һ"), ("d", "ԁ"), ("q", "ԛ"), ("w", "ԝ"), ("u", "υ"), ("v", "ν"), ("k", "κ"),
    ("t", "τ"), ("A", "АΑ"), ("B", "ВΒ"), ("E", "ЕΕ"), ("K", "КΚ"), ("M", "МΜ"), ("H", "НΗ"), ("O", "ОΟ"),
    ("P", "РΡ"), ("C", "С"), ("T", "ТΤ"), ("X", "ХΧ"), ("I", "ІΙ"), ("S", "Ѕ"), ("J", "Ј"), ("Z", "Ζ"), ("N", "Ν"),
    ("Y", "Υ"), ("@", "＠"), (".", "．﹒․·"), ("-", "‐‑‒–—―−﹣－"), ("+", "＋﹢"), ("(", "（﹙"), (")", "）﹚")] for c in group}
# English, German, French and Spanish.
DIGIT_WORDS = {word: str(digit) for digit, group in enumerate([
    "zero oh null zéro cero", "one eins un une uno", "two zwei zwo deux dos", "three drei trois tres",
    "four vier quatre cuatro", "five fünf fuenf cinq cinco", "six sechs seis", "seven sieben sept siete",
    "eight acht huit ocho", "nine neun neuf nueve"]) for word in group.split()}
SIGN_WORDS = {"plus": "+", "más": "+", "mas": "+", "dot": ".", "punkt": ".", "point": ".", "punto": "."}
ENDINGS = "com org net edu gov info io co uk de fr es eu biz dev app".split()
INVISIBLE = "​‌‍⁠﻿­"

_DIGIT, _PLUS, _DOT = ("|".join(words) for words in (
    DIGIT_WORDS, [w for w in SIGN_WORDS if SIGN_WORDS[w] == "+"], [w for w in SIGN_WORDS if SIGN_WORDS[w] == "."]))
_SPELLED = re.compile(
    rf"(?i)(?<![^\W_])(?:(?:{_PLUS})[\s-]+)?(?:{_DIGIT})(?:[\s,-]+(?:(?:{_DOT})[\s,-]+)?(?:{_DIGIT})){{3,}}(?![^\W_])")
_SPELLED_PART = re.compile(r"(?i)[^\W\d_]+")
# Leading blanks are tried from the first of their run alone, which keeps long runs linear.
_MARKED = re.compile(r"(?i)(?:(?<![\x20\t])[\x20\t]++)?[(\[{<][\x20\t]*+(at|dot|punkt|punto|point)[\x20\t]*+[)\]}>][\x20\t]*+")
_BARE = re.compile(
    r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*[A-Za-z0-9]([\x20]+at[\x20]+)[A-Za-z0-9-]+(?:(?:[\x20]+dot[\x20]+|\.)[A-Za-z0-9-]+)*?"
    r"(?:[\x20]+dot[\x20]+)(?:" + "|".join(ENDINGS) + ")(?![A-Za-z0-9])")
_BARE_PART = re.compile(r"(?i)[\x20]+(at|dot)[\x20]+")
_HINT = re.compile(r"(?i)[(\[{<][\x20\t]*(?:at|dot|punkt|punto|point)[\x20\t]*[)\]}>]|\x20dot\x20")
_DIGIT_HINT = re.compile(rf"(?i)\b(?:{_DIGIT})\b[\s,-]+(?:(?:{_DOT})[\s,-]+)?(?:{_DIGIT})\b")
_ODD = re.compile("[^\x00-\x7f¡-¬®-¶¸-ſ]|­")
# Letters that patterns which ignore case take for i and s, though lower() keeps them.
_CASE_TWINS = str.maketrans({"ı": "i", "ſ": "s", "\u0307": None})


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str) -> list:
    # Only around each "@", since the pattern would try every word start of a long text.
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        host = _HOST.match(text, at)
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if host and start < at:
            out.append((start, host.end()))
            done = host.end()
        at = text.find("@", max(done, at + 1))
    return out


_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def _cards(text: str) -> list:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def _phones(text: str) -> list:
    if "+" not in text:
        return []
    return [m.span() for m in PHONE.finditer(text)
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15]


def _ips(text: str) -> list:
    return [m.span() for m in IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]


def plain_spans(text: str) -> list:
    """(start, end, kind) of the identifiers in the text as it stands, ends exclusive."""
    found = []
    for kind, spans in zip(KINDS, (_emails(text), _ips(text), _cards(text), _phones(text))):
        found += [(s, e, kind) for s, e in spans]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


class Mapped:
    """A text and, for each of its characters, start and end of what it stands for."""

    def __init__(self, text, starts=None, ends=None):
        self.text = text
        self.starts = range(len(text)) if starts is None else starts
        self.ends = range(1, len(text) + 1) if ends is None else ends

    def rewrite(self, edits: list) -> "Mapped":
        """`edits`: ordered (start, end, replacement); every new character maps to the whole edit."""
        if not edits:
            return self
        text, starts, ends, at = [], [], [], 0
        for s, e, new in edits:
            text += (self.text[at:s], new)
            starts += self.starts[at:s]
            ends += self.ends[at:s]
            if new:
                starts += [self.starts[s]] * len(new)
                ends += [self.ends[e - 1]] * len(new)
            at = e
        text.append(self.text[at:])
        starts += self.starts[at:]
        ends += self.ends[at:]
        return Mapped("".join(text), starts, ends)


def _letters(text: str) -> list:
    edits = []
    for m in _ODD.finditer(text):
        c = m.group()
        if c in INVISIBLE:
            edits.append((m.start(), m.end(), ""))
        elif c in LOOKALIKES:
            edits.append((m.start(), m.end(), LOOKALIKES[c]))
        elif "！" <= c <= "～":
            edits.append((m.start(), m.end(), chr(ord(c) - 0xFEE0)))
        elif c.isdecimal():
            edits.append((m.start(), m.end(), str(int(c))))
    return edits


def _spelled(text: str) -> list:
    edits = []
    for m in _SPELLED.finditer(text):
        parts = list(_SPELLED_PART.finditer(text, *m.span()))
        for k, p in enumerate(parts):
            word = p.group().lower().translate(_CASE_TWINS)
            new = DIGIT_WORDS.get(word) or SIGN_WORDS[word]
            # What separates spelled digits belongs to the digit before it.
            end = parts[k + 1].start() if k + 1 < len(parts) else p.end()
            edits.append((p.start(), end, new))
    return edits


def _disguised(text: str) -> list:
    edits = {(m.start(), m.end()): "@" if m.group(1).lower() == "at" else "." for m in _MARKED.finditer(text)}
    for m in _BARE.finditer(text):
        for p in _BARE_PART.finditer(text, *m.span()):
            edits[p.span()] = "@" if p.group(1).lower() == "at" else "."
    out, at = [], 0
    for (s, e), new in sorted(edits.items()):
        if s >= at:
            out.append((s, e, new))
            at = e
    return out


def all_spans(text: str) -> tuple[list, list]:
    """Plain spans, and plain and disguised spans together, in order of start and kind."""
    plain = plain_spans(text)
    mapped = Mapped(text)
    if not text.isascii():
        mapped = mapped.rewrite(_letters(text))
    if _DIGIT_HINT.search(mapped.text):
        mapped = mapped.rewrite(_spelled(mapped.text))
    if _HINT.search(mapped.text):
        mapped = mapped.rewrite(_disguised(mapped.text))
    if mapped.text is text or mapped.text == text:
        return plain, plain
    every = set(plain)
    # Plain spans of a kind don't overlap: only the last one that starts early enough can cover a span.
    known = {kind: [x for x in plain if x[2] == kind] for kind in KINDS}
    for s, e, kind in plain_spans(mapped.text):
        start, end = mapped.starts[s], mapped.ends[e - 1]
        at = bisect_right(known[kind], start, key=lambda x: x[0])
        if not at or known[kind][at - 1][1] < end:
            every.add((start, end, kind))
    return plain, sorted(every, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _joined(spans: list) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def _find(batches):
    for pdf in batches:
        plain, every, counts = [], [], []
        for text in pdf.pop("text"):
            a, b = all_spans(text or "")
            plain.append(_joined(a))
            every.append(_joined(b))
            counts.append([sum(x[2] == k for x in a) for k in KINDS])
        for k, kind in enumerate(KINDS):
            pdf[f"n_{kind}"] = [c[k] for c in counts]
        pdf["base"], pdf["spans"] = plain, every
        yield pdf


def redacted(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans merge into the
    first one's."""
    out, at, end = [], 0, 0
    for s, e, kind in all_spans(text)[1]:
        if s >= end:
            out += (text[at:s], f"[{kind.upper()}]")
        at = end = max(end, e)
    return "".join(out) + text[at:] if out else text


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, counts of plain spans by kind, `base` (plain spans) and
    `spans` (plain and disguised) as kind:start:end, comma-joined, in code points. A null text is
    empty and has none; very long texts are scanned whole, in time linear in their length."""
    ship_package(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(
        _find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def _redact(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Batches in small parts, so that a worker holds few texts besides the batch it got."""
    for batch in batches:
        for at in range(0, len(batch), OUT_ROWS):
            yield pa.array([None if text is None else redacted(text) for text in batch.slice(at, OUT_ROWS).to_pylist()], pa.string())


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with personal data replaced in text; n_chars (if a column) follows. Null texts stay null."""
    ship_package(docs.sparkSession)
    out = docs.withColumn("text", F.arrow_udf(_redact, "string")("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)
