"""Whole scores of op3 against a brute-force version, its calibration and its draw by class."""

import math
import random

import numpy as np
import pytest

from merchframe.llm import toxicity

CLEAN = "river stone market window garden letter summer paper bridge candle harbor meadow silver orange simple".split()
TOXIC = "stupid idiots hateful garbage moronic".split()


def made(n, share, seed=3, noise=0.1):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        y = int(draw.random() < share)
        words = draw.choices(CLEAN, k=20)
        # Some clean texts hold one such word, some toxic ones only one.
        words += draw.choices(TOXIC, k=draw.randint(1, 5)) if y else draw.choices(TOXIC, k=int(draw.random() < noise))
        rows.append((k, " ".join(draw.sample(words, len(words))), y))
    return rows


def frames(spark, rows):
    return (spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string"),
            spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int"))


def test_scores_equal_brute_force(spark):
    rows = made(260, 0.25)
    docs, labels = frames(spark, rows)
    toxicity.ship_package(spark)
    model = toxicity.fit(docs, labels)
    terms = list(model.vocabulary.at)
    assert terms
    bags = [toxicity.terms_of(t) for _, t, _ in rows]
    idf = {t: math.log((len(rows) + 1) / (sum(t in b for b in bags) + 1)) + 1 for t in terms}

    def vector(bag):
        raw = {t: (1 + math.log(bag[t])) * idf[t] for t in terms if t in bag}
        size = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / size for t, w in raw.items()}
    vectors = [vector(b) for b in bags]
    import zlib
    fitted = [i for i, (k, _, _) in enumerate(rows) if zlib.crc32(str(k).encode()) % 5 and vectors[i]]
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, (k, _, _) in enumerate(rows):
        if not vectors[i]:
            assert got[k].score == pytest.approx(model.without) and got[k].example_ids == []
            continue
        cosines = [(sum(w * vectors[j].get(t, 0.0) for t, w in vectors[i].items()), rows[j][0], rows[j][2]) for j in fitted]
        best = sorted((c for c in cosines if c[0] > 0), key=lambda c: (-round(c[0], 12), c[1]))[:toxicity.NEIGHBOURS]
        # Ties by rounding may swap equal neighbours, so cosines and labels are compared, not ids.
        assert got[k].cosines == pytest.approx([c[0] for c in best])
        weight = [1 / (0.05 + 1 - min(c[0], 1)) for c in best]
        if len({y for _, _, y in best}) == 1:
            vote = (sum(weight) * best[0][2] + 0.5 * model.prior) / (sum(weight) + 0.5)
            assert got[k].score == pytest.approx(float(np.interp(vote, *model.knots)), abs=1e-6)


@pytest.mark.parametrize("n, share", [(120, 0.15), (400, 0.15), (400, 0.03), (1500, 0.1)])
def test_few_and_many_examples_behave_alike(spark, n, share):
    rows = made(n, share)
    docs, labels = frames(spark, rows)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, labels).collect()}
    toxic = [k for k, _, y in rows if y]
    clean = [k for k, _, y in rows if not y]
    assert sum(got[k] for k in toxic) >= 0.5 * len(toxic)
    # A clean text with one such word doesn't pull in all others.
    assert sum(got[k] for k in clean) <= 0.06 * len(clean)


def test_monotone_fit():
    draw = np.random.default_rng(1)
    votes = draw.random(300).round(2)
    labels = (draw.random(300) < votes).astype(float)
    at, rate = toxicity._monotone(votes, labels, np.ones(300), 0.1)
    assert at == sorted(at) and all(a < b for a, b in zip(rate, rate[1:])) and 0 <= min(rate) and max(rate) <= 1
    # Votes without any sense give one pool, near the rate; none at all, the prior.
    assert len(toxicity._monotone(np.linspace(0, 1, 50), np.linspace(1, 0, 50) > 0.5, np.ones(50), 0.1)[0]) == 1
    assert toxicity._monotone(np.array([]), np.array([]), np.array([]), 0.2) == ([0.0, 1.0], [0.2, 0.2])
    # An example that stands for ten rows weighs like ten.
    one = toxicity._monotone(np.array([0.5, 0.5]), np.array([0.0, 1.0]), np.array([10.0, 1.0]), 0.0)[1][0]
    assert one == pytest.approx(2 / 11 / 3)


def test_rare_class_is_kept_whole():
    cap = toxicity.MAX_EXAMPLES
    assert toxicity._shares(100, 10) == (1.0, 1.0) and toxicity._shares(cap - 10, 10) == (1.0, 1.0)
    clean, toxic = toxicity._shares(50 * cap, 17)
    assert toxic == 1.0 and clean * 50 * cap == pytest.approx(cap - 17)
    clean, toxic = toxicity._shares(10 * cap, 10 * cap)
    assert clean == toxic == 0.05
