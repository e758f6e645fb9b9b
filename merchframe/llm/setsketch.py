"""SetSketch registers of word shingles, and near-duplicate components built on them.

A register holds the truncated logarithm of the smallest of exponentially spread hash values, so
registers of a union are the larger ones register by register (mergeable), and two sets agree in
a register about as often as their Jaccard similarity (locality-sensitive). Steps:

1. every text becomes its set of 5-word shingles, 216 registers and a 128-bit set key;
2. rows with equal sets form one class; only the smallest doc_id of a class goes on;
3. bands of registers link each class to the smallest class of its bucket; the connected
   components of these links are candidate clusters (a pair at the threshold misses every band
   with probability 4e-8: 36 bands of 6 registers at 0.85, 43 of 5 at 0.80);
4. clusters are cut into blocks of bounded size. Pairs of blocks are compared by the joint
   likelihood of similarity given both registers and both set sizes; what may reach the threshold
   is verified on the full sets. A pair of blocks returns a spanning forest, never all its pairs;
5. components of the verified links, spread to the classes' rows.

Shingles are identified by 64-bit hashes. No row is dropped, capped or sampled.
"""

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from merchframe.llm.common import components, settle, ship_package, small_side

SHINGLE_WORDS = 5
REGISTERS = 216
#: Largest probability with which a pair at the threshold may miss every band.
MISS = 5e-8
#: SetSketch parameters: base, rate and largest register value minus one.
BASE, RATE, LIMIT = 1.001, 20.0, 65534
#: Link where 100 * intersection >= THRESHOLD * union, unless a caller passes another value.
THRESHOLD = 85
#: Standard deviations of the estimate by which a candidate may miss the threshold.
MARGIN = 5.0
#: Aim of members and of shingles in a block, and of shingles of small clusters in one task.
BLOCK_MEMBERS, BLOCK_SHINGLES, TASK_SHINGLES = 512, 1_000_000, 1_000_000

_ODD = np.random.RandomState(20240607)
_MULT = _ODD.randint(0, 2**63, REGISTERS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _ODD.randint(0, 2**63, REGISTERS).astype(np.uint64)
_WORD_MULT = _ODD.randint(0, 2**63, SHINGLE_WORDS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Words whose hashes a worker keeps.
_WORD_CACHE_SIZE = 150_000


class _WordHashes(dict):
    def __missing__(self, word):
        if len(self) >= _WORD_CACHE_SIZE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of one text.

    A-Z is lower-cased and words end at ASCII white space. Fewer than five words make one shingle
    (the whole sequence); no words or a null text make none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE_WORDS, len(h))
    n = len(h) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n] * _WORD_MULT[k]
    return np.unique(_mix(total))


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of a set of 64-bit hashes; all 0 for the empty set."""
    if not len(shingles):
        return np.zeros(REGISTERS, "<u2")
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        h = (shingles[at:at + 512, None] ^ _SALT) * _MULT
        h ^= h >> np.uint64(32)
        h *= _MULT
        np.minimum(least, h.min(axis=0), out=least)
    smallest = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    value = np.floor(1.0 - np.log(smallest) / np.log(BASE))
    return np.clip(value, 0, LIMIT + 1).astype("<u2")


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def reaches(j: float, more, less, equal, u, v):
    """True where the joint likelihood of similarity, given counts of larger, smaller and equal
    registers and relative set sizes u + v = 1, peaks at j or above. The log-likelihood is
    concave, so its slope at j decides."""
    c = (BASE - 1.0) / BASE
    log_b = np.log(BASE)
    x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
    px, py = -np.log1p(-x * c) / log_b, -np.log1p(-y * c) / log_b
    dx, dy = c / (log_b * (1.0 - x * c)), c / (log_b * (1.0 - y * c))
    rest = np.maximum(1.0 - px - py, 1e-12)
    return equal * (v * dx + u * dy) / rest >= more * v * dx / px + less * u * dy / py


def _sketch_rows(batches):
    for pdf in batches:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            s = shingle_set(text)
            key = xxhash.xxh3_128_digest(s.tobytes())
            rows.append((doc_id, len(s), int.from_bytes(key[:8], "little", signed=True),
                         int.from_bytes(key[8:], "little", signed=True),
                         registers(s).tobytes() if len(s) else None))
        yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "key1", "key2", "regs"]).astype(
            {"doc_id": "Int64"})


def _set_rows(batches):
    for pdf in batches:
        pdf["shingles"] = [shingle_set(t).tobytes() for t in pdf.pop("text")]
        yield pdf


def banding(threshold: int) -> tuple[int, int]:
    """Bands and registers a band: the widest bands that a pair at the threshold hardly ever misses."""
    t = threshold / 100.0
    for width in range(REGISTERS, 1, -1):
        if (1.0 - t**width) ** (REGISTERS // width) <= MISS:
            return REGISTERS // width, width
    return REGISTERS, 1


class _Forest:
    def __init__(self, n):
        self.up = list(range(n))

    def root(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i, j):
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def forest(sets: list, regs: np.ndarray, side: np.ndarray, threshold: int = THRESHOLD) -> list:
    """Spanning forest of the verified links among `sets`, as index pairs.

    side: 0 or 1. With both values present only pairs across the sides are compared.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    both = side.min() != side.max()
    order = np.argsort(side, kind="stable")
    left = order[:int((side == side.min()).sum())]
    right = order[len(left):] if both else left
    t = threshold / 100.0
    low = t - MARGIN * np.sqrt(t * (1 - t) / regs.shape[1])
    out, joined = [], _Forest(n)
    picked = np.concatenate([sets[j] for j in right]) if len(right) else np.empty(0, np.uint64)
    dense_all, dense = np.unique(np.concatenate([picked] + [sets[i] for i in left]), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(sizes[right])])
    at = len(picked)
    marked = np.zeros(len(dense_all), np.int32)
    for place, i in enumerate(left):
        own = dense[at:at + sizes[i]]
        at += sizes[i]
        first = 0 if both else place + 1
        js = np.arange(first, len(right))
        if not len(js):
            continue
        s = sizes[right[js]]
        js = js[np.minimum(s, sizes[i]) * 100 >= threshold * np.maximum(s, sizes[i])]
        if not len(js):
            continue
        r = regs[right[js]]
        more, equal = (regs[i] > r).sum(1), (regs[i] == r).sum(1)
        u = sizes[i] / (sizes[i] + sizes[right[js]])
        js = js[reaches(low, more, regs.shape[1] - more - equal, equal, u, 1.0 - u)]
        if not len(js):
            continue
        marked[own] = 1
        for j in js:
            inter = int(marked[dense[bounds[j]:bounds[j + 1]]].sum())
            k = int(right[j])
            if 100 * inter >= threshold * (sizes[i] + sizes[k] - inter) and joined.join(int(i), k):
                out.append((int(i), k))
        marked[own] = 0
    return out


def _verify(pdf: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """Links (a, b) of one task: blocks of one cluster, or many small clusters."""
    found = []
    for _, part in pdf.groupby("cluster", sort=False):
        part = part.sort_values("rep")
        sets = [np.frombuffer(x, np.uint64) for x in part["shingles"]]
        regs = np.vstack([np.frombuffer(x, "<u2") for x in part["regs"]])
        ids = part["rep"].to_numpy()
        found += [(ids[i], ids[j]) for i, j in forest(sets, regs, part["side"].to_numpy(), threshold)]
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of `docs` (doc_id, text, ...): doc_id, n_shingles, component_id, kept.

    Rows whose shingle sets have 100 * intersection >= threshold * union are linked; component_id is the
    smallest doc_id reachable and `kept` marks it. Texts without words are linked with nothing.
    Rows that share a doc_id count as one document; a row without doc_id is its own component
    (component_id null, kept).
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select("doc_id", "text")
    sketches = settle(texts.mapInPandas(
        _sketch_rows, "doc_id long, n_shingles long, key1 long, key2 long, regs binary"), "sketches")
    keys = ["key1", "key2"]
    # One smallest doc_id for each distinct set, counted before the shuffle.
    classes = settle(
        sketches.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*keys)
        .agg(F.min("doc_id").alias("rep")), "classes")
    reps = settle(
        sketches.where("n_shingles > 0").join(classes, keys).where("doc_id = rep")
        .select("rep", "n_shingles", "regs").dropDuplicates(["rep"]), "reps")
    count, width = banding(threshold)
    width *= 2
    bands = (reps.select("rep", "regs", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("band"))
             .select("rep", F.xxhash64("band", F.expr(f"substring(regs, band * {width} + 1, {width})")).alias("bucket")))
    heads = (bands.groupBy("bucket").agg(F.min("rep").alias("head"), F.count("*").alias("n"))
             .where("n > 1").select("bucket", "head"))
    stars = bands.join(heads, "bucket").where("rep != head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    clusters = settle(components(stars), "clusters")
    links = components(_verified(docs.select("doc_id", "text"), reps, clusters, threshold))
    # Classes that reach a smaller doc_id; every other class is its own component.
    moved = links.where("node != label").select(F.col("node").alias("rep"), "label")
    labels = classes.join(moved, "rep", "left").select(
        *keys, F.coalesce("label", "rep").alias("component"))
    # The same doc_id in several classes: all of them take the smallest component.
    return (sketches.join(labels, keys, "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(
                F.when(F.col("n_shingles") > 0, F.col("component")), "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _verified(docs: DataFrame, reps: DataFrame, clusters: DataFrame, threshold: int) -> DataFrame:
    members = clusters.select(F.col("node").alias("rep"), F.col("label").alias("cluster")).join(reps, "rep")
    totals = members.groupBy("cluster").agg(
        F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_MEMBERS),
                   F.lit(1)).cast("int").alias("blocks"))
    members = settle(members.join(totals, "cluster"), "members")
    size = members.agg(F.count("*"), F.sum(F.when(F.col("blocks") == 1, F.col("n_shingles")))).first()
    tasks = max(1, -(-(size[1] or 0) // TASK_SHINGLES))
    texts = docs.withColumnRenamed("doc_id", "rep").join(
        small_side(members.select("rep", "cluster", "blocks"), size[0]), "rep")
    # A doc_id with several texts is one document: its largest set goes on with its registers.
    sets = texts.mapInPandas(_set_rows, "rep long, cluster long, blocks int, shingles binary").join(
        members.select("rep", "regs", F.col("n_shingles").alias("n")), "rep").where(
        F.octet_length("shingles") == 8 * F.col("n")).dropDuplicates(["rep"])
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    pair = F.when(F.col("blocks") == 1, F.array(F.struct(
        F.pmod(F.xxhash64("cluster"), F.lit(tasks)).alias("task"), F.lit(-1).alias("low"), F.lit(-1).alias("high"),
        F.lit(0).alias("side")))).otherwise(F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(
                F.col("cluster").alias("task"), F.least(other, block).alias("low"),
                F.greatest(other, block).alias("high"),
                F.when(block > other, 1).otherwise(0).alias("side"))))
    dealt = sets.select("rep", "cluster", "regs", "shingles", F.explode(pair).alias("pair")).select(
        "rep", "cluster", "regs", "shingles", "pair.*")
    return dealt.groupBy("task", "low", "high").applyInPandas(
        lambda pdf: _verify(pdf, threshold), "a long, b long")


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """`docs` without the rows that `near_duplicates` doesn't keep; all columns stay."""
    gone = settle(near_duplicates(docs, threshold).where("NOT kept").select("doc_id").distinct(), "dropped")
    return docs.join(small_side(gone), "doc_id", "left_anti").select(*docs.columns)
