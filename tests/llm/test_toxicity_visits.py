"""Nearest examples are those of a plain scan; vocabularies travel without the words they saw."""

import pickle
import random

import numpy as np

from merchframe.llm import toxicity


def _vectors(n, terms, seed):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        raw = {t: draw.uniform(0.5, 3) for t in draw.sample(range(terms), draw.randint(1, 6))}
        length = sum(w * w for w in raw.values()) ** 0.5
        out.append({t: w / length for t, w in raw.items()})
    return out


def test_nearest_is_a_plain_scan_with_copies_and_a_left_out_example():
    vectors = _vectors(700, 40, 5)
    vectors += vectors[:100]  # copies, by other ids
    index = toxicity.BlockMaxIndex(list(range(800)), [0] * 800, vectors, 40)
    for q, but in [(0, None), (3, 3), (90, 90), (650, None), (799, 799)]:
        own = vectors[q]
        cosines = [(-sum(own[t] * v[t] for t in own if t in v), i) for i, v in enumerate(vectors) if i != but]
        best = sorted((round(c, 12), i) for c, i in cosines if c < 0)[:toxicity.NEIGHBOURS]
        found, values = index.nearest(own, but=but)
        assert sorted(zip(np.round(-values, 12), index.ids[found].tolist())) == best


def test_a_visit_scores_many_blocks_at_once(monkeypatch):
    vectors = _vectors(toxicity.BLOCK * 100, 8, 7)
    index = toxicity.BlockMaxIndex(list(range(len(vectors))), [0] * len(vectors), vectors, 8)
    visits, scores = [], index._scores
    monkeypatch.setattr(index, "_scores", lambda cells, *rest: visits.append(cells.shape[1]) or scores(cells, *rest))
    index.nearest({t: 8 ** -0.5 for t in range(8)}, k=3000)
    assert len(visits) <= 4 and sum(visits) == 100


def test_a_vocabulary_keeps_few_words_and_travels_without_them(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 10)
    vocabulary = toxicity.Vocabulary(["abcd", "abcd*", "abcde*", "ab"])
    text = "Abcd abcdef ab abc xyz " + " ".join("abcd" + chr(97 + k) * 3 for k in range(26))
    terms = toxicity.terms_of(text)
    assert vocabulary.counts(text) == {k: terms[t] for t, k in vocabulary.at.items()}
    assert len(vocabulary.words) <= 10
    again = pickle.loads(pickle.dumps(vocabulary))
    assert not again.words and again.counts(text) == vocabulary.counts(text)
    assert pickle.loads(pickle.dumps(toxicity.Vocabulary([]))).counts("abcd") == {}
