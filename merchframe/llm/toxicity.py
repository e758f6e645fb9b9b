"""Toxicity of whole texts from their nearest labelled examples.

1. A hash-drawn sample of labelled rows, MAX_EXAMPLES expected at most, is the example set. It is drawn by
   class: all rows of a class rarer than half of MAX_EXAMPLES stay.
2. Terms are words and their beginnings of four to six letters. Those that speak for toxicity in
   the examples (likelihood ratio and lift) form the vocabulary, at most MAX_TERMS.
3. Inverse document frequencies of these terms are counted over all documents.
4. Examples with a term form a block-max inverted index: for each term the largest weight in every
   block of examples. A text visits blocks by falling upper bound and stops when no block can
   improve its nearest NEIGHBOURS, so the neighbours are exact by TF-IDF cosine.
5. The votes of the neighbours count by cosine distance. Votes of the examples themselves, each
   without itself, calibrate the score by a monotone fit on single votes. A text without any term takes the
   smoothed rate of the examples without any.

What is broadcast is bounded by MAX_EXAMPLES and MAX_TERMS.
"""

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from merchframe.llm.common import settle, ship_package

MAX_EXAMPLES, MAX_TERMS = 20_000, 2_048
NEIGHBOURS, BLOCK = 15, 64
#: Blocks that a text visits first; every further visit takes four times as many, MOST_BLOCKS at most.
FIRST_BLOCKS, MOST_BLOCKS = 4, 64
#: Words that a worker keeps the terms of.
CACHE_WORDS = 100_000
#: A term needs this likelihood ratio, lift in the toxic examples and number of toxic examples.
MIN_RATIO, MIN_LIFT, MIN_TOXIC = 12.0, 4.0, 4
HELD_OUT_FOLD, FOLDS = 0, 5
STEMS = (4, 5, 6)
#: Letters of a word that tell whether it may have a term.
HEAD = min(STEMS)
#: Score from which `predicted` is 1.
CUT = 0.5
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD


def terms_of(text: str | None) -> dict:
    """Term counts of a text: words, and beginnings of longer words (ended by '*')."""
    counts: dict = {}
    for word in _WORD.findall(text.lower()) if text else ():
        counts[word] = counts.get(word, 0) + 1
    for word, n in list(counts.items()):
        for k in STEMS:
            if len(word) > k:
                stem = word[:k] + "*"
                counts[stem] = counts.get(stem, 0) + n
    return counts


def _example_terms(batches):
    for pdf in batches:
        terms = [list(terms_of(t)) for t in pdf["text"]]
        yield pd.DataFrame({"toxic": np.repeat(pdf["toxic"].to_numpy(), [len(t) for t in terms]),
                            "term": [x for t in terms for x in t]})


class _WordTerms(dict):
    """Places of the terms of each word asked for."""

    def __init__(self, at: dict):
        self.at = at

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        names = [word] + [word[:k] + "*" for k in STEMS if len(word) > k]
        own = self[word] = tuple(self.at[n] for n in names if n in self.at)
        return own


class Vocabulary:
    """Finds the counts of chosen terms in a text."""

    def __init__(self, terms: list):
        self.at = {t: k for k, t in enumerate(terms)}
        self.words = _WordTerms(self.at)
        # Few words begin like a term, so the others are told without a place in `words`.
        self.heads = {t[:HEAD] for t in terms}

    def __reduce__(self):
        return Vocabulary, (list(self.at),)  # words seen in the driver stay there

    def hits(self, text) -> dict:
        """Counts of a text's words that have a term."""
        heads, words = self.heads, self.words
        counted = Counter(_WORD.findall(text.lower())) if text else {}
        return {w: n for w, n in counted.items() if w[:HEAD] in heads and words[w]}

    def counts(self, text) -> dict:
        out: dict = {}
        for word, n in self.hits(text).items():
            for k in self.words[word]:
                out[k] = out.get(k, 0) + n
        return out


class BlockMaxIndex:
    """Exact nearest examples by cosine of TF-IDF vectors, block by block."""

    def __init__(self, ids, labels, vectors: list, n_terms: int):
        # Neighbours in the order of their heaviest term share blocks, which tightens the bounds.
        order = sorted(range(len(ids)), key=lambda i: (max(vectors[i], key=vectors[i].get), ids[i]))
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.labels = np.array([labels[i] for i in order], np.float64)
        self.n_blocks = -(-len(order) // BLOCK)
        rows = [(t, at, w) for at, i in enumerate(order) for t, w in vectors[i].items()]
        rows.sort()
        self.example = np.array([r[1] for r in rows], np.int64)
        self.weight = np.array([r[2] for r in rows])
        # Where the postings of a term in a block begin; they end where those of the next block do.
        cells = np.array([r[0] * self.n_blocks + r[1] // BLOCK for r in rows], np.int64)
        self.start = np.searchsorted(cells, np.arange(n_terms * self.n_blocks + 1))
        self.top = np.zeros((n_terms, self.n_blocks), np.float32)
        for t, at, w in rows:
            # Rounded up, so that a bound is never below a true cosine.
            self.top[t, at // BLOCK] = max(self.top[t, at // BLOCK], np.nextafter(np.float32(w), np.float32(2)))

    def nearest(self, vector: dict, k: int = NEIGHBOURS, but: int | None = None):
        """(positions, cosines) of the k nearest examples, ties to the smaller id; `but` is left out."""
        terms = np.fromiter(vector, np.int64, len(vector))
        weights = np.fromiter(vector.values(), np.float64, len(vector))
        if not len(terms) or not self.n_blocks:
            return np.empty(0, np.int64), np.empty(0)
        bound = weights @ self.top[terms] * (1 + 1e-6)
        found, cosines, worst = np.empty(0, np.int64), np.empty(0), -1.0
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        cells = terms[:, None] * self.n_blocks
        at, step = 0, FIRST_BLOCKS
        while at < len(order) and bound[order[at]] >= worst:
            take = order[at:at + step]
            at, step = at + step, min(step * 4, MOST_BLOCKS)
            take = take[bound[take] >= worst]
            own, scores = self._scores(cells + take, weights, take)
            if but is not None:
                other = self.ids[own] != but
                own, scores = own[other], scores[other]
            found, cosines = np.concatenate((found, own)), np.concatenate((cosines, scores))
            if len(cosines) > k:
                near = cosines >= np.partition(cosines, -k)[-k]
                found, cosines = found[near], cosines[near]
            best = np.lexsort((self.ids[found], -cosines))[:k]
            found, cosines = found[best], cosines[best]
            worst = cosines[-1] if len(cosines) == k else -1.0
        return found, cosines

    def _scores(self, cells, weights, blocks):
        """(positions, cosines) of the examples in `blocks` that share a term, from the postings of all terms
        (rows of `cells`) in all these blocks (columns) at once."""
        first = self.start[cells]
        counts = self.start[cells + 1] - first
        flat = counts.ravel()
        ends = np.cumsum(flat)
        at = np.arange(ends[-1]) + np.repeat(first.ravel() - ends + flat, flat)
        place = self.example[at] % BLOCK + np.repeat(np.tile(np.arange(len(blocks)) * BLOCK, len(weights)), flat)
        # Terms are added one after another, so sums don't depend on the blocks of a visit.
        scores = np.bincount(place, np.repeat(weights, counts.sum(axis=1)) * self.weight[at], len(blocks) * BLOCK)
        hit = np.flatnonzero(scores > 0)
        return blocks[hit // BLOCK] * BLOCK + hit % BLOCK, scores[hit]


class Model:
    """Vocabulary, weights, index and calibration; all of bounded size."""

    def __init__(self, terms, idf, examples, prior, counts=(1.0, 1.0)):
        self.vocabulary, self.idf, self.prior = Vocabulary(terms), np.array(idf), prior
        vectors = [self.vector(t) for _, _, t in examples]
        none = [y for (_, y, _), v in zip(examples, vectors) if not v]
        weight = sum(counts[y] for y in none)
        self.without = _rate((0.0, sum(none) * counts[1], weight, len(none)), prior) if none else prior
        some = [(i, y, v) for (i, y, _), v in zip(examples, vectors) if v]
        self.index = BlockMaxIndex(*([x[k] for x in some] for k in range(3)), len(terms))
        votes = np.array([self.vote(*self.index.nearest(v, but=i)) for i, _, v in some])
        own = np.array([y for _, y, _ in some], np.int64)
        # Arrays, since every text is looked up in them.
        self.knots = tuple(np.array(k) for k in _monotone(votes, own.astype(float), np.array(counts)[own], prior))

    def vector(self, text) -> dict:
        counts = self.vocabulary.counts(text)
        raw = {t: (1.0 + math.log(n)) * self.idf[t] for t, n in counts.items()}
        length = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / length for t, w in raw.items()} if length else {}

    def vote(self, found, cosines) -> float:
        """Share of toxic votes, weighted by closeness, with one vote at half weight for the prior."""
        weight = 1.0 / (0.05 + 1.0 - np.minimum(cosines, 1.0))
        return float((weight @ self.index.labels[found] + 0.5 * self.prior) / (weight.sum() + 0.5))

    def score(self, text):
        vector = self.vector(text)
        if not vector:
            return self.without, [], []
        found, cosines = self.index.nearest(vector)
        if not len(found):
            return self.without, [], []
        value = float(np.interp(self.vote(found, cosines), *self.knots))
        return value, [int(x) for x in self.index.ids[found]], [float(c) for c in cosines]


def _monotone(votes, labels, counts, prior):
    """Knots of a rising map from votes to rates: adjacent single votes are pooled until the rates rise.

    `counts` says how many labelled rows an example stands for. A pool's rate is shrunk to the prior by one row;
    equal votes share a pool, and no pool depends on how many examples there are.
    """
    if not len(votes):
        return [0.0, 1.0], [prior, prior]
    single, where = np.unique(votes, return_inverse=True)
    n = np.bincount(where, counts)
    toxic = np.bincount(where, labels * counts)
    rows = np.bincount(where)
    pools = []
    for pool in zip(single * n, toxic, n, rows):
        pools.append(pool)
        while len(pools) > 1 and _rate(pools[-2], prior) >= _rate(pools[-1], prior):
            last = pools.pop()
            pools[-1] = tuple(a + b for a, b in zip(pools[-1], last))
    return [p[0] / p[2] for p in pools], [_rate(p, prior) for p in pools]


def _rate(pool, prior):
    """Toxic share of a pool, shrunk by one row of the examples' mean count."""
    _, toxic, n, rows = pool
    return (toxic / n * rows + prior) / (rows + 1.0)


def _ratio(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """Log-likelihood ratio of a term's presence in the two classes."""
    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    share = (toxic + clean) / F.lit(float(n_toxic + n_clean))
    return 2 * (part(toxic, share * n_toxic) + part(clean, share * n_clean)
                + part(n_toxic - toxic, (1 - share) * n_toxic) + part(n_clean - clean, (1 - share) * n_clean))


def _shares(n_clean: int, n_toxic: int) -> tuple[float, float]:
    """Drawn shares of both classes: up to half of MAX_EXAMPLES each, more where the other class leaves room."""
    half = MAX_EXAMPLES // 2
    return tuple(min(1.0, max(half, MAX_EXAMPLES - other) / max(own, 1))
                 for own, other in ((n_clean, n_toxic), (n_toxic, n_clean)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from the labelled rows outside the held-out fold. Labels without a text, or null, don't count;
    several labels of one document count as one example each."""
    spark = docs.sparkSession
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    labelled = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    shares = _shares(labelled.get(0, 0), labelled.get(1, 0))
    drawn = usable.where(F.pmod(F.xxhash64("label_id", F.lit(3)), F.lit(1_000_000)) < F.when(
        F.col("toxic") == 1, int(shares[1] * 1_000_000)).otherwise(int(shares[0] * 1_000_000)))
    sample = settle(docs.select("doc_id", "text").join(
        F.broadcast(drawn), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "toxic"), "examples")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    # An example stands for as many labelled rows as its class was thinned out by.
    counts = (1.0 / shares[0], 1.0 / shares[1])
    prior = (n_toxic * counts[1] + 0.5) / (n_toxic * counts[1] + n_clean * counts[0] + 1.0)
    terms = []
    if n_toxic and n_clean:
        seen = sample.mapInPandas(_example_terms, "toxic int, term string").groupBy("term").agg(
            F.sum("toxic").cast("double").alias("t"), F.count("*").cast("double").alias("n")).where(f"t >= {MIN_TOXIC}")
        clean = F.col("n") - F.col("t")
        ratio = _ratio(F.col("t"), clean, n_toxic, n_clean)
        terms = [r["term"] for r in seen.withColumn("ratio", ratio).where(
            (F.col("ratio") >= MIN_RATIO) & (F.col("t") / n_toxic >= MIN_LIFT * clean / n_clean)).orderBy(
            F.desc("ratio"), "term").limit(MAX_TERMS).collect()]
    shared = spark.sparkContext.broadcast(Vocabulary(terms))

    def presence(batches):
        total = np.zeros(len(shared.value.at) + 1, np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                total[list(shared.value.counts(text))] += 1
            total[-1] += len(pdf)
        yield pd.DataFrame({"term": np.arange(len(total)), "n": total})

    counted = {r["term"]: r["n"] for r in docs.select("text").mapInPandas(presence, "term int, n long").groupBy(
        "term").agg(F.sum("n").alias("n")).collect()} if terms else {}
    total = counted.get(len(terms), 0)
    idf = [math.log((total + 1.0) / (counted[k] + 1.0)) + 1.0 for k in range(len(terms))]
    # Only the examples' chosen terms matter; the sample is bounded by MAX_EXAMPLES.
    def slim(batches):
        for pdf in batches:
            pdf["text"] = [" ".join(w for w, n in shared.value.hits(t).items() for _ in range(n)) for t in pdf["text"]]
            yield pdf
    examples = sample.mapInPandas(slim, "doc_id long, text string, toxic int").orderBy("doc_id", "text", "toxic").collect()
    return Model(terms, idf, [(r["doc_id"], r["toxic"], r["text"]) for r in examples], prior, counts)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs`' doc_id with held_out, score, predicted and evidence (ids and cosines of the examples that
    voted). Empty and null texts have no term and take the rate of examples without any. Copies of a
    text get equal scores; labels, lang, source and doc_id are no inputs of a score."""
    spark = docs.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels))

    def scored(batches):
        for pdf in batches:
            rows = [model.value.score(t) for t in pdf.pop("text")]
            pdf["score"] = [r[0] for r in rows]
            pdf["example_ids"], pdf["cosines"] = [r[1] for r in rows], [r[2] for r in rows]
            yield pdf

    out = docs.select("doc_id", "text").mapInPandas(
        scored, "doc_id long, score double, example_ids array<long>, cosines array<double>")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= CUT).cast("int").alias("predicted"), "example_ids", "cosines")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows whose score reaches CUT; all columns stay. Rows are judged by their text alone."""
    spark = docs.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels))

    def scores(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: model.value.score(t)[0]).astype("float64")

    return docs.where(F.pandas_udf(scores, "double")("text") < CUT)
