"""Language identification: code lengths against a plain tree, held-out accuracy, odd rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa

from merchframe.llm import language_id as L

SF = "/root/testdata/sf0.01"
TRAIN = {"xx": "the cat sat on the mat and the hat was flat", "yy": "le chat était là où la fenêtre était ouverte"}


class PlainTree:
    """Followers of every context of one language, a dictionary per context."""

    def __init__(self, text):
        self.next = defaultdict(Counter)
        for w in text.lower().split():
            spelled = f" {w} ".encode()
            for p in range(1, len(spelled)):
                for k in range(min(p, L.DEPTH) + 1):
                    self.next[k, spelled[p - k:p]][spelled[p]] += 1

    def bits(self, word):
        spelled, total = f" {word} ".encode(), 0.0
        for p in range(1, len(spelled)):
            for k in range(min(p, L.DEPTH), -1, -1):
                follow = self.next.get((k, spelled[p - k:p]))
                if not follow:
                    continue
                n = sum(follow.values()) + len(follow)
                if spelled[p] in follow:
                    total -= math.log2(follow[spelled[p]] / n)
                    break
                total -= math.log2(len(follow) / n)
            else:
                total += 8
        return total


def fitted():
    rows = [(lang, w, n) for lang, text in TRAIN.items() for w, n in Counter(text.lower().split()).items()]
    return L.Model.fit(pd.DataFrame(rows, columns=["lang", "word", "n"]))


def test_code_lengths_are_those_of_the_trees():
    probe = ["the", "thé", "chatter", "", "était", "zzz", "hat", "語", "a" * 500, "flat\x00cat"]
    got = fitted().code_lengths(pa.array(probe, pa.large_string())) / L.UNIT
    for j, lang in enumerate(sorted(TRAIN)):
        tree = PlainTree(TRAIN[lang])
        for i, w in enumerate(probe):
            want = tree.bits(w) if w else 0.0
            assert abs(got[i, j] - want) < 1e-3 * max(1.0, want) , (w, lang)


def test_texts_sum_words_whatever_the_batch():
    model, texts = fitted(), ["the cat", None, "", "  là\n était the ", "mat " * 999, "le chat"]
    best, score = model.predict(pa.array(texts))
    for i, t in enumerate(texts):
        one, s = model.predict(pa.array([t], pa.string()))
        assert one[0] == best[i] and s[0] == score[i]
    assert [model.languages[b] for b in best[[0, 4, 5]]] == ["xx", "xx", "yy"]
    assert score[1] == 0.5 and best[1] == 0


def test_a_full_model_drops_the_rarest():
    rows = pd.DataFrame([("a", "common", 50), ("a", "rare", 1), ("b", "other", 50)], columns=["lang", "word", "n"])
    small = L.Model.fit(rows, most=60)
    assert sum(len(t[0]) for t in small.tables) * 2 <= 60
    lengths = small.code_lengths(pa.array(["common", "other"], pa.large_string()))
    assert lengths[0, 0] < lengths[0, 1] and lengths[1, 1] < lengths[1, 0]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and any(c.isalpha() for c in r.text or "")]
    right = sum(r.lang_pred == r.lang for r in held)
    print(right, len(held), [(r.lang, r.lang_pred, r.text[:80]) for r in held if r.lang != r.lang_pred][:5])
    assert right >= 0.98 * len(held)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score double, letters string"
    train = [(i, TRAIN[lang], lang, None, "x") for i in range(20) for lang in TRAIN]
    odd = [(100, None, "xx", None, None), (101, "", None, None, None), (102, "123 !?", "yy", None, None),
           (None, "the hat", None, None, None), (103, "the cat " * 20_000, None, None, None), (103, "la fenêtre", None, None, None),
           (103, "la fenêtre", None, None, None), (104, "a" * 200_000, None, None, None), (105, "語", None, None, None)]
    got = L.identify(spark.createDataFrame(train + odd, schema)).collect()
    assert len(got) == len(train) + len(odd)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r.lang_pred)
    assert by_id[100] == by_id[101] == by_id[102] == ["und"] and by_id[None] == ["xx"]
    assert sorted(by_id[103]) == ["xx", "yy", "yy"] and by_id[105][0] in TRAIN
    assert L.identify(spark.createDataFrame([], schema)).count() == 0
    blind = L.identify(spark.createDataFrame([(1, "some text", None, None, None)], schema)).collect()
    assert [(r.lang_pred, r.score) for r in blind] == [("und", 0.0)]
