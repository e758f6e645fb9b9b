"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a tree of byte contexts of up to DEPTH bytes. A byte is coded in the longest
context that the language knows; where it never followed that context, an escape is coded (by the share of
different followers, method C, without exclusion) and the next shorter context is tried, down to even
odds over 256 bytes. Statistics are frozen after learning, so the code length of a word is a sum of table
entries, and the same word costs the same everywhere. The language with the shortest code for a text wins.

Contexts begin at a word's leading blank. So only the distinct words of a batch are coded, all their
bytes and all languages at once: one lookup of the context and one of context and byte for each depth. Code lengths are
sums of whole numbers (1/65536 bit), the same whatever a word is batched with.

Learning counts words of a sample of whole labelled texts, drawn by a hash of doc_id so that a language has
SAMPLE_BYTES bytes in expectation, all languages SAMPLE_TOTAL at most. Scoring covers all rows and whole texts.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from merchframe.llm.common import settle, ship_package, small_side
from merchframe.llm.fill_middle import blocks

#: Bytes of the longest context.
DEPTH = 5
#: Text bytes to learn a language from, and all languages together, as expected values.
SAMPLE_BYTES, SAMPLE_TOTAL = 1 << 20, 8 << 20
#: Entries (contexts with a byte, times languages) of the model; the rarest go beyond that.
MAX_CELLS = 16 << 20
#: Prediction for texts without letters, and where nothing could be learnt.
UNKNOWN = "und"
#: Text bytes whose words are coded together (a longer text is a block of its own).
BLOCK_BYTES = 8 << 20
UNIT = 65_536


def held_out() -> Column:
    """Rows that nothing is learnt from; an absent doc_id counts as an empty one."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct lower-cased words, the word of each place, first place of each text and the total)."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    coded = pc.list_flatten(lists).dictionary_encode()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return (coded.dictionary, coded.indices.to_numpy(zero_copy_only=False),
            np.concatenate([[0], np.cumsum(sizes, dtype="i8")]))


def _spelled(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words with a blank at both ends as bytes; the word of each byte and its place in it."""
    raw = pc.binary_join_element_wise(
        *[pa.scalar(" ", pa.large_string()), values.cast(pa.large_string()), pa.scalar(" ", pa.large_string())],
        pa.scalar("", pa.large_string()))
    at = np.frombuffer(raw.buffers()[1], "i8")[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], "u1")[at[0]:at[-1]]
    sizes = np.diff(at)
    word = np.repeat(np.arange(len(sizes)), sizes)
    return data, word, np.arange(len(data)) - np.repeat(at[:-1] - at[0], sizes)


def _grams(data: np.ndarray, place: np.ndarray):
    """For each depth the coded bytes with a context that long: (positions, context, context and byte)."""
    key = data.astype("i8")
    before = np.zeros(len(key), "i8")
    for depth in range(DEPTH + 1):
        if depth:
            earlier = np.append(np.zeros(depth, "i8"), data[:-depth].astype("i8"))[:len(data)]
            before = before | earlier << 8 * (depth - 1)
        at = np.flatnonzero(place >= max(depth, 1))
        yield at, before[at], before[at] << 8 | key[at]


class Model:
    """Tables of the languages' trees, by depth: code lengths in bits, escapes of contexts."""

    def __init__(self, languages: list[str], tables):
        self.languages, self.tables = languages, tables

    @classmethod
    def fit(cls, counts: pd.DataFrame, most: int = MAX_CELLS) -> "Model":
        """Trees from counted words (lang, word, n)."""
        if not len(counts):
            return cls([], [])
        languages = sorted(counts["lang"].unique().tolist())
        data, word, place = _spelled(pa.array(counts["word"], pa.large_string()))
        lang = np.searchsorted(languages, counts["lang"].to_numpy(object)).astype("i8")[word]
        weight = counts["n"].to_numpy("i8")[word]
        seen = []
        for at, _, gram in _grams(data, place):
            keys, inverse = np.unique(gram, return_inverse=True)
            seen.append((keys, np.bincount(inverse * len(languages) + lang[at], weights=weight[at],
                                           minlength=len(keys) * len(languages)).reshape(len(keys), -1)))
        least = 1
        while sum((n.sum(axis=1) >= least).sum() for _, n in seen) * len(languages) > most:
            least += 1
        tables = []
        for keys, n in seen:
            keep = n.sum(axis=1) >= least
            keys, n = keys[keep], n[keep]
            contexts, inverse = np.unique(keys >> 8, return_inverse=True)
            total, kinds = (np.zeros((len(contexts), len(languages))) for _ in range(2))
            np.add.at(total, inverse, n)
            np.add.at(kinds, inverse, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                codes = np.where(n > 0, -np.log2(n / (total + kinds)[inverse]), np.nan)
                escapes = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            tables.append((keys, codes.astype("f4"), contexts, escapes.astype("f4")))
        return cls(languages, tables)

    def code_lengths(self, values: pa.Array) -> np.ndarray:
        """Code length of each word in each language, in units of 1/65536 bit; an empty word has none."""
        data, word, place = _spelled(values)
        bits = np.full((len(data), len(self.languages)), 8.0, "f4")
        for (at, before, gram), (keys, codes, contexts, escapes) in zip(_grams(data, place), self.tables):
            if not len(keys):
                continue
            known = np.minimum(np.searchsorted(contexts, before), len(contexts) - 1)
            here = np.flatnonzero(contexts[known] == before)
            at, gram, known = at[here], gram[here], known[here]
            longer = bits[at] + escapes[known]
            found = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            hit = np.flatnonzero(keys[found] == gram)
            own = codes[found[hit]]
            longer[hit] = np.where(np.isnan(own), longer[hit], own)
            bits[at] = longer
        bits[place == 0] = 0
        units = np.rint(bits.astype("f8") * UNIT).astype("i8")
        total = np.concatenate([np.zeros((1, units.shape[1]), "i8"), np.cumsum(units, axis=0)])
        ends = np.searchsorted(word, np.arange(len(values) + 1))
        out = total[ends[1:]] - total[ends[:-1]]
        out[pc.equal(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)] = 0
        return out

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language with the shortest code, its share of all by code lengths); ties to the first."""
        distinct, use, ends = words(texts)
        each = self.code_lengths(distinct)
        total = np.concatenate([np.zeros((1, each.shape[1]), "i8"), np.cumsum(each[use], axis=0)])
        text = total[ends[1:]] - total[ends[:-1]]
        best = text.argmin(axis=1)
        more = (text - text[np.arange(len(text)), best][:, None]) / UNIT
        return best, 1 / np.exp2(-np.minimum(more, 1000.0)).sum(axis=1)


def _count_words(batches):
    for batch in batches:
        for block in blocks(batch, BLOCK_BYTES):
            distinct, use, ends = words(block["text"])
            langs = block["lang"].dictionary_encode()
            lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype("i8"), np.diff(ends))
            key, n = np.unique(lang * max(len(distinct), 1) + use, return_counts=True)
            yield pa.record_batch(
                [langs.dictionary.take(pa.array(key // max(len(distinct), 1))),
                 distinct.take(pa.array(key % max(len(distinct), 1))).cast(pa.string()), pa.array(n, pa.int64())],
                names=["lang", "word", "n"])


def learn(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, sample_total: int = SAMPLE_TOTAL) -> Model:
    """A model of the labelled rows of `docs` (doc_id, text, lang) that aren't held out.

    What reaches the driver is the sample's counted words, bounded by `sample_total` bytes in expectation.
    """
    ship_package(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0))
    sizes = settle(rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")), "language-sizes")
    each = min(sample_bytes, sample_total // max(sizes.count(), 1))
    share = sizes.select("lang", (F.lit(2.0**31) * each / F.col("bytes")).alias("below"))
    drawn = rows.join(small_side(share), "lang").where(
        F.xxhash64(F.lit("language"), "doc_id").bitwiseAND(F.lit(2**31 - 1)) < F.col("below"))
    counts = drawn.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long")
    return Model.fit(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas())


def _predict(shared):
    def run(batches):
        model = shared.value
        names = pa.array([*model.languages, UNKNOWN], pa.string())
        for batch in batches:
            for block in blocks(batch, BLOCK_BYTES):
                known = block["letters"].to_numpy(zero_copy_only=False)
                if model.languages:
                    best, score = model.predict(block["text"])
                else:
                    best, score, known = np.zeros(len(block), int), np.zeros(len(block)), np.zeros(len(block), bool)
                yield pa.record_batch(
                    [block["doc_id"], block["held_out"], names.take(pa.array(np.where(known, best, len(names) - 1))),
                     pa.array(np.where(known, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of `docs` (doc_id, text, lang, ...): doc_id, held_out, lang_pred, score.

    lang_pred is the learnt language with the shortest code for the whole text, ties to the smaller name; score
    is its share among all languages' code probabilities. A text that is null or has no letter, and every
    text where nothing was learnt, gives `und` with score 0. Repeated rows give repeated results, other columns
    are ignored, a very long text is a block of its own, and an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs) if model is None else model)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text",
                       F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")
