"""op6: stored trees, pruning of single vectors, factors fitted by measured recall."""

import numpy as np
import pytest

from merchframe.llm import vp_search


def shapes():
    r = np.random.RandomState(1)
    centres = r.randn(60, 32)
    return {"clustered": centres[r.randint(60, size=6000)] + 0.3 * r.randn(6000, 32),
            "flat": r.randn(6000, 5) @ r.randn(5, 32), "random": r.randn(3000, 32)}


@pytest.mark.parametrize("name,most", [("clustered", 0.2), ("flat", 0.1), ("random", 1.0)])
def test_recall_and_share_scanned(name, most):
    v = shapes()[name]
    ids, asked = np.arange(len(v)), np.arange(0, len(v), 40)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    cosines = unit[asked] @ unit.T
    cosines[np.arange(len(asked)), asked] = -2
    least = -np.sort(-cosines, axis=1)[:, 4:5]
    for factor, recall in ((None, 0.93), (1.0, 1.0)):
        search = vp_search.Search(ids, v, asked, v[asked], 5, factor)
        best = search.run()[1]
        assert (best >= least - 1e-12).mean() >= recall
        assert factor or search.scanned <= most * len(v) * len(asked)


def test_bounds_of_single_vectors():
    v = shapes()["random"][:500]
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    tree = vp_search.Tree(unit)
    assert sorted(tree.order) == list(range(500))
    for level in range(len(tree.path)):
        for place in range(0, 500, 7):
            at = tree.vantages[level, place]
            if at >= 0:
                far = np.linalg.norm(unit[tree.order[place]] - unit[at])
                assert abs(far - tree.path[level, place]) < 1e-6


def test_several_shards_and_groups(spark, monkeypatch):
    """Every group visits every shard; repeated rows, shared vec_ids, odd vectors, extra columns."""
    monkeypatch.setattr(vp_search, "SHARD_BYTES", 32 * 8 * 400)
    monkeypatch.setattr(vp_search, "GROUP_QUERIES", 7)
    v = shapes()["clustered"][:1000]
    data = [(k, [float(x) for x in row], "s") for k, row in enumerate(v)]
    data += [(1000, [float(x) for x in v[3]], "s"), (1000, [float(x) for x in v[3]], "s"), (1050, None, None),
             (None, [1.0] * 32, "s"), (1100, [], "s"), (1150, [0.0] * 32, "s"), (1200, [None] + [1.0] * 31, "s"), (1250, [2.0], "s")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, part string").repartition(3)
    rows = [(r.query_id, r["rank"], r.vec_id) for r in vp_search.nearest(df, factor=1.0).collect()]
    ids = np.array([d[0] for d in data[:1002]])
    unit = np.array([d[1] for d in data[:1002]])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    want = []
    for q in [k for k in range(1002) if ids[k] % 50 == 0]:
        s = np.round(unit @ unit[q], 12)
        s[ids == ids[q]] = -2
        want += [(ids[q], n + 1, ids[x]) for n, x in enumerate(np.lexsort((ids, -s))[:5])]
    assert sorted(rows) == sorted(want)
