"""Fill-in-the-middle forms against a plain version."""

import hashlib
import re

from merchframe.llm import fill_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [
    None, "", " ", "\n\t ", "one", " one", "one ", "a  b\r\n\x0bc\x0c", "ünïcode 語 文 x　y  z w", "\x00 \x01 \x1c x",
    "holds <P> a mark", "<S>", "near <P < S> <<M mark>", "<" * 5 + " <P", "word " * 3000, "a" * 100_000,
    " " * 50_000, ("x\n" * 30_000)]


def plain_version(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    hexed = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    made = [(11 * i + j, t) for i, t in enumerate(TEXTS) for j in range(7)]
    return made + [made[30], made[30], (None, "no id at all"), (None, None), (-5, "negative id here")]


def test_forms_and_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows()], "doc_id long, text string, form string, n int")
    got = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored()).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    want = [(i, *plain_version(i, t), t or "") for i, t in rows()]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_digest_and_empty_table(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    out = {r.doc_id: r for r in fill_middle.digest(fill_middle.fill_in_middle(docs)).collect()}
    for i, t in rows():
        assert out[i].restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest() or i is None
        assert out[i].output_sha256 == hashlib.sha256(plain_version(i, t)[4].encode()).hexdigest() or i is None
    assert fill_middle.digest(fill_middle.fill_in_middle(docs.limit(0))).count() == 0


def test_blocks_keep_every_row():
    import pyarrow as pa
    batch = pa.record_batch({"text": pa.array(["a" * 10, None, "b" * 100, "", "c" * 5])})
    cut = list(fill_middle.blocks(batch, 12))
    assert [len(b) for b in cut] == [2, 1, 2]
    assert pa.Table.from_batches(cut).to_pylist() == batch.to_pylist()
