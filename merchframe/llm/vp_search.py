"""Nearest vectors by cosine with a vantage-point tree per shard.

Vectors are dealt into shards of bounded bytes; each shard becomes one row that holds its vectors and,
built once, a vantage-point tree over their directions, where Euclidean distance is a metric and falls
as cosine rises. Every vector keeps its distances to all vantage points on its path. Queries are packed
into groups; every group visits every shard. A first descent to each query's nearest leaf sets its bound,
then all queries that a node may still concern visit it together. By the triangle inequality a subtree, or a single vector of a leaf, is at least as far
from a query as their distances to a vantage point differ; it is passed over when that difference times
a factor is beyond the query's current k-th nearest. Factor 1 is exact search; larger ones pass over more.

Unless one is given, every shard picks its own factor by measured recall: SAMPLE of its rows are compared
with all its rows, and the largest factor is taken that keeps RECALL of their true neighbours.

Scores are computed in double precision on the original vectors.
"""

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from merchframe.llm.common import settle, ship_package

SHARD_BYTES, GROUP_QUERIES, LEAF = 16 << 20, 2048, 128
#: Rows of a shard that its factor is fitted on, and the share of their neighbours to keep.
SAMPLE, RECALL = 128, 0.97
NEAREST, QUERY_EVERY = 5, 50
_SLACK = 1e-9
#: Pairs scored at once.
_PAIRS = 16_384


class Tree:
    """Vantage-point tree over unit vectors: nodes of [start, end) in `order`, and for every place in
    `order` the distances to the vantage points on its path, the root's first."""

    def __init__(self, units: np.ndarray):
        order = np.arange(len(units))
        self.nodes = []  # (start, end, vantage, left, right, bounds of the two halves)
        depth = max(0, int(np.ceil(np.log2(max(len(units), 1) / LEAF))))
        self.path = np.zeros((depth, len(units)))
        self.vantages = np.full((depth, len(units)), -1, np.int64)
        self._build(units, order, 0, len(units), 0)
        self.order = order

    def _build(self, units, order, start, end, level):
        at = len(self.nodes)
        self.nodes.append(None)
        if end - start <= LEAF:
            self.nodes[at] = (start, end, -1, -1, -1, None)
            return at
        own = order[start:end].copy()
        # The vector farthest from the first one separates well.
        vantage = own[np.argmin(units[own] @ units[own[0]])]
        far = _distance(units[own] @ units[vantage])
        rank = np.argsort(far, kind="stable")
        order[start:end] = own[rank]
        # Distances of the levels above follow their vectors.
        self.path[:level, start:end] = self.path[:level, start:end][:, rank]
        far, mid = far[rank], (end - start) // 2
        self.path[level, start:end], self.vantages[level, start:end] = far, vantage
        bounds = (far[0], far[mid - 1], far[mid], far[-1])
        left = self._build(units, order, start, start + mid, level + 1)
        right = self._build(units, order, start + mid, end, level + 1)
        self.nodes[at] = (start, end, int(vantage), left, right, bounds)
        return at

    def fit_factor(self, units: np.ndarray, k: int) -> float:
        """The largest factor, 1 at least, that keeps RECALL of the k nearest of SAMPLE rows, each judged
        with its final bound; searches begin with wider ones."""
        n = len(units)
        if n <= k + 1 or not len(self.path):
            return 1.0
        rows = np.unique(np.linspace(0, n - 1, min(SAMPLE, n)).astype(np.int64))
        cosines = units[rows] @ units.T
        cosines[np.arange(len(rows)), rows] = -np.inf
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        far = _distance(np.take_along_axis(cosines, near, 1))
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        least = np.zeros(near.shape)
        for path, vantage in zip(self.path, self.vantages):
            at = vantage[place[near]]
            own = _distance(np.einsum("qd,qkd->qk", units[rows], units[at]))
            least = np.maximum(least, np.where(at < 0, 0.0, np.abs(own - path[place[near]])))
        ratio = np.sort(((far.max(axis=1)[:, None] + _SLACK) / np.maximum(least, _SLACK)).ravel())
        return max(1.0, float(ratio[int((1 - RECALL) * len(ratio))]))


def _distance(cosine):
    return np.sqrt(np.maximum(2.0 - 2.0 * cosine, 0.0))


class Search:
    """A group of queries against one shard, node by node with the queries that may need it; `scanned`
    counts the pairs whose score was computed."""

    def __init__(self, ids, vectors, query_ids, queries, k, factor=None, tree=None):
        self.ids, self.query_ids, self.k = ids, query_ids, k
        self.vectors, self.queries = vectors.astype(np.float64), queries.astype(np.float64)
        self.norms, self.query_norms = _norms(self.vectors), _norms(self.queries)
        self.units, self.query_units = self.vectors / self.norms[:, None], self.queries / self.query_norms[:, None]
        n = len(query_ids)
        self.best = np.full((n, k), -np.inf)
        self.found = np.full((n, k), np.iinfo(np.int64).max, np.int64)
        self.tree = Tree(self.units) if tree is None else tree
        self.factor = self.tree.fit_factor(self.units, k) if factor is None else factor
        self.scanned = 0

    def run(self):
        if len(self.ids) and len(self.query_ids):
            every = np.arange(len(self.query_ids))
            self.home = np.full(len(every), -1)
            self._descend(0, every, [])
            self._visit(0, every, [])
        return self.found, self.best

    def _reach(self, active):
        """Largest distance that still matters for each query; without bound until k are found."""
        worst = self.best[active, -1]
        return np.where(np.isinf(worst), np.inf, _distance(np.maximum(worst, -1.0))) + _SLACK

    def _descend(self, node, active, path):
        """Every query scans the leaf on its own side of all vantage points, its home."""
        start, end, vantage, left, right, bounds = self.tree.nodes[node]
        if vantage < 0:
            self.home[active] = node
            self._scan(start, end, active, path)
            return
        far = _distance(self.query_units[active] @ self.units[vantage])
        near_left = far <= (bounds[1] + bounds[2]) / 2
        for half, side in ((left, near_left), (right, ~near_left)):
            if side.any():
                self._descend(half, active[side], [p[side] for p in path] + [far[side]])

    def _visit(self, node, active, path):
        start, end, vantage, left, right, bounds = self.tree.nodes[node]
        if vantage < 0:
            away = self.home[active] != node
            self._scan(start, end, active[away], [p[away] for p in path])
            return
        far = _distance(self.query_units[active] @ self.units[vantage])
        for half, low, high in ((left, *bounds[:2]), (right, *bounds[2:])):
            least = np.maximum(np.maximum(far - high, low - far), 0.0)
            open_ = least * self.factor <= self._reach(active)
            if open_.any():
                self._visit(half, active[open_], [p[open_] for p in path] + [far[open_]])

    def _scan(self, start, end, active, path):
        rows = self.tree.order[start:end]
        least = np.zeros((len(active), len(rows)))
        for own, theirs in zip(path, self.tree.path):
            np.maximum(least, np.abs(own[:, None] - theirs[None, start:end]), out=least)
        near = (least * self.factor <= self._reach(active)[:, None]) & (self.query_ids[active][:, None] != self.ids[rows])
        self.scanned += int(near.sum())
        # A product of matrices is rounded by its shape, so it only tells which pairs to score.
        rough = np.where(near, self.query_units[active] @ self.units[rows].T, -np.inf)
        q, v = np.nonzero(near & (rough >= self.best[active, -1][:, None] - _SLACK))
        if not len(q):
            return
        scores = np.full(least.shape, -np.inf)
        for at in range(0, len(q), _PAIRS):
            a, b = q[at:at + _PAIRS], v[at:at + _PAIRS]
            x, y = active[a], rows[b]
            # Summed the same way for every pair, so equal vectors get equal scores.
            dots = np.einsum("pd,pd->p", self.queries[x], self.vectors[y])
            scores[a, b] = dots / (self.query_norms[x] * self.norms[y])
        some = np.unique(q)
        active, scores = active[some], scores[some]
        scores = np.concatenate([self.best[active], scores], 1)
        ids = np.concatenate([self.found[active], np.broadcast_to(self.ids[rows], (len(active), len(rows)))], 1)
        top = np.lexsort((ids, -scores), axis=1)[:, :self.k]
        self.best[active] = np.take_along_axis(scores, top, 1)
        self.found[active] = np.take_along_axis(ids, top, 1)


def _norms(vectors):
    return np.sqrt(np.einsum("vd,vd->v", vectors, vectors))


def _usable(batches):
    for pdf in batches:
        keep, packed = [], []
        for v in pdf["embedding"]:
            try:
                a = None if v is None else np.array(v, np.float64)
            except TypeError:
                a = None
            ok = a is not None and len(a) and np.isfinite(a).all() and a.any()
            keep.append(bool(ok))
            packed.append(a.tobytes() if ok else b"")
        out = pd.DataFrame({"vec_id": pdf["vec_id"], "dim": [len(p) // 8 for p in packed], "vector": packed})
        yield out[np.array(keep, bool) & pdf["vec_id"].notna().to_numpy()]


def _shard(pdf: pd.DataFrame, k: int, factor: float | None) -> pd.DataFrame:
    """One row for a shard: ids, vectors, tree and factor."""
    pdf = pdf.sort_values(["vec_id", "vector"])
    vectors = np.frombuffer(b"".join(pdf["vector"]), np.float64).reshape(len(pdf), -1)
    units = vectors / _norms(vectors)[:, None]
    tree = Tree(units)
    fitted = tree.fit_factor(units, k) if factor is None else factor
    del tree.vantages
    return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "part": [pdf["part"].iloc[0]],
                         "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [vectors.tobytes()],
                         "tree": [pickle.dumps((tree.nodes, tree.path, tree.order))], "factor": [fitted]})


def _stored_tree(data: bytes) -> Tree:
    tree = Tree.__new__(Tree)
    tree.nodes, tree.path, tree.order = pickle.loads(data)
    return tree


def shards(rows: DataFrame, k: int = NEAREST, factor: float | None = None) -> DataFrame:
    """The index of `rows` (dim, part, vec_id, vector): a row for each shard, written to the shared folder."""
    return settle(rows.groupBy("dim", "part").applyInPandas(
        lambda pdf: _shard(pdf, k, factor),
        "dim int, part long, ids binary, vectors binary, tree binary, factor double"), "vector-shards")


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = QUERY_EVERY, factor: float | None = None) -> DataFrame:
    """For each row of `vectors` (vec_id, embedding, ...) whose vec_id is divisible by `every`, its k
    nearest other rows: query_id, rank, vec_id, score (cosine); ties to the smaller vec_id.

    Rows without vec_id and vectors that are null, empty, zero or hold null or non-finite numbers take
    no part; vectors of unequal length are never compared. Rows that share a vec_id are never each
    other's neighbours; a repeated query row is answered as often as it stands. A factor of 1 makes the
    search exact; without one, every shard fits its own.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = settle(vectors.select("vec_id", "embedding").mapInPandas(_usable, "vec_id long, dim int, vector binary"), "vectors")
    asked = F.col("vec_id") % every == 0
    sizes = settle(rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(asked).alias("q")), "sizes")
    sizes = sizes.select("dim", F.ceil(F.col("n") * F.col("dim") * 8 / SHARD_BYTES).alias("shards"),
                         F.ceil(F.col("q") / GROUP_QUERIES).alias("groups"))
    # One row for each length of vector; rows are dealt by their place in the table, whatever their ids.
    dealt = settle(rows.withColumn("place", F.monotonically_increasing_id()).join(sizes, "dim"), "vectors-dealt")
    index = shards(dealt.select("dim", "vec_id", "vector", F.pmod(F.xxhash64("place"), "shards").alias("part")), k, factor)
    queries = dealt.where(asked).select(
        "dim", "vec_id", "vector", "place", F.pmod(F.xxhash64("place"), "groups").alias("asked"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("part"))
    visits = index.join(sizes, "dim").withColumn("asked", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    visits = visits.where("groups > 0").drop("shards", "groups")

    def search(shard, group):
        if not len(shard) or not len(group):
            return pd.DataFrame({"query_id": [], "query": [], "vec_id": [], "score": []})
        row = shard.iloc[0]
        a = np.frombuffer(row.vectors, np.float64).reshape(-1, row.dim)
        b = np.frombuffer(b"".join(group["vector"]), np.float64).reshape(-1, row.dim)
        query_ids = group["vec_id"].to_numpy(np.int64)
        found, best = Search(np.frombuffer(row.ids, np.int64), a, query_ids, b, k, row.factor, _stored_tree(row.tree)).run()
        at, col = np.nonzero(np.isfinite(best))
        return pd.DataFrame({"query_id": query_ids[at], "query": group["place"].to_numpy()[at],
                             "vec_id": found[at, col], "score": best[at, col]})

    key = ["dim", "part", "asked"]
    hits = visits.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(
        search, "query_id long, query long, vec_id long, score double")
    w = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
