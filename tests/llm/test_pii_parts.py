"""Redaction hands on small parts of a batch."""

import pyarrow as pa

from merchframe.llm import pii


def test_parts_are_small_and_whole():
    texts = [None, "", "mail me@here.example now", "x" * 50] * 150
    parts = list(pii._redact(iter([pa.array(texts), pa.array([], pa.string()), pa.array(texts[:3])])))
    assert len(parts) > 3 and all(0 < len(p) <= pii.OUT_ROWS for p in parts)
    assert [t for p in parts for t in p.to_pylist()] == [
        None if t is None else pii.redacted(t) for t in texts + texts[:3]]


def test_rows_keep_their_columns(spark):
    texts = [None if k % 7 == 0 else f"row {k} me{k}@here.example" for k in range(1000)]
    docs = spark.createDataFrame([(k, t, k % 3, 5) for k, t in enumerate(texts)], "doc_id long, text string, other int, n_chars long")
    got = {r.doc_id: r for r in pii.redact(docs.repartition(2)).collect()}
    for k, t in enumerate(texts):
        want = None if t is None else f"row {k} [EMAIL]"
        assert tuple(got[k]) == (k, want, k % 3, 5 if t is None else len(want))
