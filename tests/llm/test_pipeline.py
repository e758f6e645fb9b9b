"""Stages of the corpus pipeline against brute force."""

import corpus_pipeline
from merchframe.llm import setsketch


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b)


def near_rows():
    """Groups of a text and one copy of it with `n` words changed, far enough apart to hit 5 shingles each."""
    out = []
    for group, n in enumerate([1, 2, 3, 4, 4, 4, 5, 6]):
        words = [f"w{group}x{k}" for k in range(204)]
        copy = words.copy()
        for k in range(n):
            copy[20 + 25 * k] = f"changed{group}y{k}"
        out += [(2 * group, " ".join(words)), (2 * group + 1, " ".join(copy))]
    return out


def test_near_dedup_stage_links_from_080(spark):
    made = near_rows()
    sets = {i: shingles(t) for i, t in made}
    between = [i for i in sets for j in sets if i < j and 0.80 <= similarity(sets[i], sets[j]) < 0.85]
    assert between, "the fixture holds pairs that 85 would leave"
    want = {i for i in sets if not any(j < i and similarity(sets[j], sets[i]) >= 0.80 for j in sets)}
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, "").collect()]
    assert sorted(got) == sorted(want)
    kept = {r.doc_id for r in setsketch.near_duplicates(docs).where("kept").collect()}
    assert kept == {i for i in sets if not any(j < i and similarity(sets[j], sets[i]) >= 0.85 for j in sets)}


def test_bands_follow_the_threshold():
    assert setsketch.banding(85) == (36, 6) and setsketch.banding(80) == (43, 5)
    for threshold in (60, 70, 80, 85, 90, 99):
        bands, width = setsketch.banding(threshold)
        assert bands * width <= setsketch.REGISTERS
        assert (1 - (threshold / 100) ** width) ** bands <= setsketch.MISS
