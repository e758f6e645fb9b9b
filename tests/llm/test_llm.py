"""The training text operators against brute force on small fixtures with odd rows."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from merchframe.llm import (
    chat, fingerprints, line_dedup, packing, pii, setsketch, sharding, toxicity, unigram, vp_search)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, part int"
WORDS = "amber birch cedar dune ember frost grove heath iris juniper kelp larch moss".split()


def text(seed, n):
    r = np.random.RandomState(seed)
    return " ".join(WORDS[i] + str(r.randint(40)) for i in r.randint(len(WORDS), size=n))


def rows():
    base = text(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    out = [base, near, base, None, "", "   \n\t", "two words", text(2, 30) + "\n" + text(3, 30),
           text(4, 20) + "\n" + text(3, 30) + " more", text(5, 9000), "same short", "same short",
           "You idiot, write to bob (at) mail [dot] example [dot] com or 10.0.0.1"]
    made = [(k, t, "en", None if k % 5 == 0 else f"s{k % 3}", None, "k", 1) for k, t in enumerate(out)]
    return made + [made[2], (None, base, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_setsketch(docs, empty):
    got = {r.doc_id: r for r in setsketch.near_duplicates(docs).where("doc_id IS NOT NULL").collect()}
    sets = {r[0]: shingles(r[1]) for r in rows() if r[0] is not None}
    for i, s in sets.items():
        linked = [j for j, t in sets.items() if s and t and 100 * len(s & t) >= 85 * len(s | t)]
        assert got[i].n_shingles == len(s) and got[i].component_id == min(linked or [i]), i
    assert setsketch.near_duplicates(empty).count() == 0
    kept = setsketch.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {0, 3, 4, 5}


def test_setsketch_merges_and_estimates():
    r = np.random.RandomState(0)
    a, b = (np.unique(r.randint(0, 2**62, 3000).astype(np.uint64)) for _ in range(2))
    union = np.unique(np.concatenate([a, b]))
    assert (setsketch.merge_registers(setsketch.registers(a), setsketch.registers(b)) == setsketch.registers(union)).all()
    x, y = setsketch.registers(np.concatenate([a[:900], b[:50]])), setsketch.registers(np.concatenate([a[:900], b[50:100]]))
    more, equal = (x > y).sum(), (x == y).sum()
    assert setsketch.reaches(0.75, more, len(x) - more - equal, equal, 0.5, 0.5)
    assert not setsketch.reaches(0.99, more, len(x) - more - equal, equal, 0.5, 0.5)


def test_forest_of_blocks_is_exact():
    r = np.random.RandomState(3)
    base = np.arange(200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sets = [np.unique(np.where(r.rand(200) < 0.05, r.randint(0, 2**62, 200).astype(np.uint64), base)) for _ in range(60)]
    regs = np.vstack([setsketch.registers(s) for s in sets])

    def labels(pairs):
        up = setsketch._Forest(60)
        for a, b in pairs:
            up.join(a, b)
        return [up.root(i) for i in range(60)]

    want = [(i, j) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    side = np.arange(60) % 2
    parts = [np.flatnonzero(side == k) for k in (0, 1)]
    found = setsketch.forest(sets, regs, side)
    for p in parts:
        found += [(p[a], p[b]) for a, b in setsketch.forest([sets[i] for i in p], regs[p], np.zeros(len(p), int))]
    assert labels(want) == labels(found) and len(found) < 120


def test_line_dedup(docs, empty):
    got = {(r.doc_id, r.text): r for r in line_dedup.dedup_lines(docs).collect()}
    by_id = {r[0]: r for r in rows() if r[0] is not None}
    out = {k[0]: k[1] for k in got if k[0] is not None}
    earlier, want = [], {}
    for i in sorted(by_id):
        t = by_id[i][1]
        if t is None:
            want[i] = None
            continue
        keep = []
        for line in t.split("\n"):
            s = set(line.lower().split())
            if len(s) < 5 or not any(len(s & e) >= 0.8 * len(s | e) for e in earlier):
                keep.append(line)
            if len(s) >= 5:
                earlier.append(s)
        want[i] = "\n".join(keep)
    assert out == want
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(docs).count() == docs.count()


def test_pii():
    t = "Mail bоb@exаmple.com, a.b at host dot com; card four two four two four two four two four two four two four two four two. x@y.z"
    plain, every = pii.all_spans(t)
    assert set(plain) <= set(every)
    assert [t[a:b] for a, b, k in every if k == "card"] == [t[t.index("four"):t.index(". x@y")]]
    assert "bоb@exаmple.com" in [t[a:b] for a, b, _ in every] and "a.b at host dot com" in [t[a:b] for a, b, _ in every]
    assert pii.all_spans("meet at the dot at one two three")[1] == [] == pii.all_spans("")[1]
    assert pii.redacted("x 10.0.0.1 y") == "x [IP] y"


def test_pii_rows(docs, empty):
    got = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    assert got[12].spans.startswith("email:") and got[12].n_ip == 1 and got[3].spans == ""
    assert pii.redact(docs).columns == docs.columns and pii.redact(empty).count() == 0


def test_packing(docs, empty):
    for n in (1, 1023, 1024, 5000):
        pieces = packing.cut(n)
        assert sum(x for _, x in pieces) == n and all(x & (x - 1) == 0 for _, x in pieces)
        assert [s for s, _ in pieces] == [sum(x for _, x in pieces[:k]) for k in range(len(pieces))]
    got = packing.pack(docs, with_ids=True).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert sum(r.doc_id == 3 for r in got) == 1 and packing.pack(empty).count() == 0


def test_sharding(docs, empty):
    got = sharding.shard_by_mixture(docs, 4).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == docs.count() and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.shard_by_mixture(empty).count() == 0


def test_chat(spark):
    turns = [(1, 2, "assistant", "a\\n<|im_end|>"), (1, 1, "us\ner\\", None), (1, 3, "assistant", "b"), (2, 1, None, "x"),
             (None, 1, "assistant", "<\\|im_sep|>"), (1, 3, "assistant", "b")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(df)).collect()}
    conv = defaultdict(list)
    for c, k, role, t in turns:
        conv[c].append((k, role or "", t or ""))
    for c, own in conv.items():
        loss = "".join(t for _, r, t in sorted(own) if r == "assistant")
        lines = "".join(f"{r}\n{t}\n" for _, r, t in sorted(own))
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(lines.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_fingerprints(docs, empty):
    own = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in fingerprints.fingerprints(own).collect()}
    texts = {r[0]: r[1] or "" for r in rows() if r[0] is not None}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        t, after = texts[i], texts[order[(k + 1) % len(order)]]
        edited = t[:len(t) - len(t) // 3] + after[:len(t) // 3]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t), shingles(edited)
        assert abs(got[i].near_edited - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.2
    assert got[0].fingerprint == got[2].fingerprint and fingerprints.fingerprints(empty).count() == 0


def test_vantage_points(spark):
    r = np.random.RandomState(5)
    v = r.randn(700, 8)
    v[300:500] = v[300]
    data = [(k, [float(x) for x in row]) for k, row in enumerate(v)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (950, [1.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for factor, least in ((1.0, 1.0), (1.1, 0.9)):
        got = defaultdict(list)
        for x in vp_search.nearest(df, factor=factor).orderBy("query_id", "rank").collect():
            got[x.query_id].append(x.vec_id)
        hit = 0
        for q in range(0, 700, 50):
            s = np.round(unit @ unit[q], 12)
            s[q] = -2
            hit += len(set(np.lexsort((np.arange(700), -s))[:5]) & set(got[q]))
        assert hit / 70 >= least and set(got) == set(range(0, 700, 50))
    assert vp_search.nearest(df.limit(0)).count() == 0


def test_unigram(spark, docs, empty):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = unigram.Model.get(path)
    score = {i: s for i, s in model.pieces.values()}
    odd = spark.createDataFrame([(1, "a" * 700), (2, text(7, 200)), (3, None), (4, ""), (5, "é\U0001F600 \n" * 60)],
                                "doc_id long, text string")
    for df, chunk in ((odd, 40), (docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), unigram.CHUNK)):
        ids, back = defaultdict(list), defaultdict(str)
        for r in unigram.decode(unigram.encode(df, path, chunk), path).orderBy("doc_id", "part").collect():
            ids[r.doc_id] += r.ids
            back[r.doc_id] += r.text
        for r in df.collect():
            t = r.text or ""
            whole = model.whole("▁" + t.replace(" ", "▁")) if t else []
            assert back[r.doc_id] == t
            assert sum(score.get(i, 0) for i in ids[r.doc_id]) == sum(score.get(int(i), 0) for i in whole)
    assert unigram.encode(empty, path).count() == 0


def test_words_together_and_alone():
    import public_tokenizers

    model = unigram.Model.get(public_tokenizers.path("piece_bpe_32k.model"))
    words = ["▁the", "abcabc", "▁²½", "x_5", "\n\n▁", "日本語", "é\U0001F600", "aa" * 30, "b" * 200, "▁", "", "\ud800"]
    words += [text(k, 1) for k in range(300)]
    model.known.clear()
    model.learn(set(words))
    assert len(model.known) > 200
    assert all(model.known[w] == model._segment(w) for w in model.known)
    odd = ["▁".join(words), "", "▁", "".join(words) * 3]
    for t, ids in zip(odd, model.wholes(odd)):
        assert ids == model.trace(t, 0, len(t), len(t))[1]


def test_toxicity(spark):
    r = np.random.RandomState(2)
    made = [(k, text(k, 40) + (" you idiot " if k % 4 == 0 else " you "), int(k % 4 == 0)) for k in range(400)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in made] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in made] + [(5000, 1), (7, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score(docs, labels).collect()}
    assert all(got[k].predicted == y and 0 <= got[k].score <= 1 for k, _, y in made)
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in got)
    assert got[900].predicted == got[901].predicted == 0
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert {x.doc_id for x in toxicity.drop_toxic(docs, labels).collect()} == {k for k, _, y in made if not y} | {900, 901}


def test_block_max_is_exact():
    r = np.random.RandomState(1)
    vectors = []
    for _ in range(500):
        w = r.rand(4)
        vectors.append(dict(zip(map(int, r.choice(30, 4, False)), (w / np.linalg.norm(w)).tolist())))
    index = toxicity.BlockMaxIndex(list(range(500)), [0] * 500, vectors, 30)
    dense = np.zeros((500, 30))
    for k, v in enumerate(vectors):
        dense[k, list(v)] = list(v.values())
    for q in range(0, 500, 25):
        found, cosines = index.nearest(vectors[q], 7)
        assert np.allclose(np.sort(dense @ dense[q])[::-1][:7], cosines)
