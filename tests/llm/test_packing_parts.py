"""A worker holds the pieces of few documents at once."""

from types import SimpleNamespace

import pandas as pd

from merchframe.llm import packing


def test_pieces_come_in_small_parts(monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    docs = pd.DataFrame({"doc_id": range(1200), "text": ["a b"] * 1199 + [None]})
    parts = list(packing._pieces(True)(iter([docs])))
    assert max(part["doc_id"].nunique() for part in parts) <= 500
    rows = pd.concat(parts)
    assert sorted(rows["doc_id"].unique()) == list(range(1200))
    for _, group in rows.groupby("length"):
        assert list(group["number"]) == list(range(len(group)))
    assert all(len(ids) == n for ids, n in zip(rows["ids"], rows["length"]))
