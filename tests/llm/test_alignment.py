"""Cross-tokenizer alignment against whole texts of both libraries, aligned by a plain loop."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from merchframe.llm import alignment

ODD = [
    None, "", " ", "a", "  two  blanks  ", "line\r\nnext\r\n\r\n  x;\r\n", "tab\there\n\n  y\n", "café à la ïü z",
    "no break  em 　wide  x", "語文字列を切る test", "blank sign ▁ in text", "<|endoftext|> <s> </s> [INST]",
    "\x00 \x1c \x85 q ​﻿ r", "\U0001f600\U0001f468‍\U0001f469 ok", "don't we'll 12345 6.75e-3", "ha ha ha " * 300,
    "aaaa" * 700, "1" * 900, " " * 4000 + "x", "-=" * 500, "  \n \t ", "é ö", "x" * 30 + " " + "x" * 30]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_table():
    """Characters of the byte-level spelling by byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in keep]
    return {**{chr(b): b for b in keep}, **{chr(256 + i): b for i, b in enumerate(other)}}


def plain_version(texts, libraries):
    a_lib, b_lib = libraries
    table, out, held = byte_table(), [], Counter()
    for text in texts:
        links, groups = Counter(), []
        n_a = n_b = n_links = 0
        if text:
            a = a_lib.encode(" " + text, add_special_tokens=False).ids
            b = b_lib.encode(text)
            a_bytes = [bytes(table[c] for c in a_lib.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()
                       for i, p in ((i, b_lib.id_to_piece(i)) for i in b)]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
                cuts = sorted(set(a_ends.tolist()) & set(b_ends.tolist()))
                i = k = 0
                for cut in cuts:
                    j, m = int(np.searchsorted(a_ends, cut)) + 1, int(np.searchsorted(b_ends, cut)) + 1
                    groups.append((a[i:j], b[k:m]))
                    for x in a[i:j]:
                        for y in b[k:m]:
                            links[x, y] += 1
                    i, k = j, m
                n_a, n_b, n_links = len(a), len(b), sum(links.values())
        held.update(links.keys())
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), n_links, links,
                    hashlib.sha256(spelled.encode()).hexdigest() if groups else ""))
    best = Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [(n_a, n_b, g, n, sum(t for p, t in links.items() if held[p] == best[p[0]]),
             sum(t * held[p] for p, t in links.items()), h) for n_a, n_b, g, n, links, h in out]


def check(spark, rows, libraries):
    docs = spark.createDataFrame([(i, t, 7, 8) for i, t in rows], "doc_id long, text string, row int, pairs int")
    got = [tuple(r) for r in alignment.align(docs).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
    want = [(i, *w) for (i, _), w in zip(rows, plain_version([t for _, t in rows], libraries))]
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_odd_texts(spark, libraries):
    rows = list(enumerate(ODD))
    check(spark, rows + [rows[5], (None, "no id"), (None, None), (3, "another text of id 3")], libraries)


def test_driver_documents(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], libraries)


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_wide_groups_count_as_narrow_ones(monkeypatch):
    r = np.random.RandomState(1)
    ids = [r.randint(0, 9, 60) for _ in range(2)]
    cuts = [np.array([0, 25, 31, 60]), np.array([0, 40, 42, 60])]
    args = (np.array([0, 0, 2]), *ids, cuts[0][:-1], cuts[0][1:], cuts[1][:-1], cuts[1][1:])
    narrow = alignment._summed(*alignment.group_links(*args))
    monkeypatch.setattr(alignment, "WIDE", 10)
    wide = alignment._summed(*alignment.group_links(*args))
    assert all((x == y).all() for x, y in zip(narrow, wide))


def test_lockstep_meets_at_shared_ends():
    unit, a, b = alignment.lockstep(np.array([1, 2, 1, 4]), np.array([0, 3, 4]), np.array([3, 1, 2, 2]), np.array([0, 2, 4]))
    assert list(zip(unit.tolist(), a.tolist(), b.tolist())) == [(0, 2, 1), (0, 3, 2), (1, 4, 4)]


def test_units_join_to_the_text():
    texts = pa.array([t for t in ODD if t])
    units, n = alignment.cut_units(texts)
    parts, at = units.to_pylist(), 0
    for text, k in zip(texts.to_pylist(), n.tolist()):
        assert b"".join(parts[at:at + k]) == (" " + text).encode()
        at += k
    assert at == len(parts)
