"""op4 on short lines and on scripts without blanks, against brute force."""

import re

import numpy as np

from merchframe.llm import line_dedup

DENSE = r"[぀-ヿ一-鿿฀-๿]"


def tokens(line):
    out = set(re.sub(f"{DENSE}+", " ", line.lower()).split())
    for run in re.findall(f"{DENSE}+", line):
        out |= {run[k:k + 3] for k in range(max(1, len(run) - 2))}
    return out


def short_rows():
    r = np.random.RandomState(8)
    passage = "".join(chr(0x4E00 + x) for x in r.randint(3000, size=60))
    thai = "".join(chr(0x0E01 + x) for x in r.randint(40, size=200))
    other_thai = "".join(chr(0x0E01 + x) for x in r.randint(40, size=200))
    made = [
        "All rights reserved.\n\none line here\n----\nhttps://a.example/x\nha ha ha ha ha ha",
        "all  RIGHTS reserved.\n   \n----\nhttps://a.example/y\nHa ha\nline here one",
        "a b c d\nb c d e f\na b c",
        "d c b a e\na b c d x y\na b d",
        passage + "\n中文\n中\n" + thai,
        passage[:30] + "变" + passage[31:] + "\n中文\n中文字\n中\n" + other_thai,
        passage[:30] + passage[::-1],
        "mixed 中文字符 words café été\n----",
        "words été mixed café 中文字符\nété été",
        "été\n\n----"]
    for k in range(40):
        made.append("\n".join(" ".join("abcdefg"[x] for x in r.randint(7, size=r.randint(0, 8))) for _ in range(4)))
    return list(enumerate(made))


def test_short_and_dense_lines(spark):
    made = short_rows()
    earlier, want, short = [], {}, 0
    for i, t in made:
        keep = []
        for line in t.split("\n"):
            s = tokens(line)
            if s and any(len(s & e) * 5 >= 4 * len(s | e) for e in earlier):
                short += len(s) < 5
            else:
                keep.append(line)
            if s:
                earlier.append(s)
        want[i] = "\n".join(keep)
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, least=1).collect()}
    assert got == want and short > 20
    assert want[5].split("\n")[0] == "中文字" and "a b c d" in want[2] and "d c b a e" not in want[3]


def test_query_and_pipeline_pass_every_line(spark, tmp_path):
    import corpus_pipeline
    from merchframe.llm import queries

    docs = spark.createDataFrame([(1, "All rights reserved.\nx"), (2, "All rights reserved.\ny")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for df in (queries.QUERIES["op4_line_dedup"](spark, str(tmp_path)), corpus_pipeline.dedup_lines(spark, docs, "")):
        assert {r.doc_id: r.text for r in df.collect()} == {1: "All rights reserved.\nx", 2: "y"}


def test_columns_of_any_name(spark):
    rows = [(1, "one two three four five six\nown line", 7, "a", [1], "v"), (2, "one two three four five six\nother", 8, "b", [2], "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed int, _doc string, _lines array<int>, _Version string")
    out = line_dedup.dedup_lines(docs, least=1)
    assert out.columns == ["doc_id", "text", "_doc", "_lines", "_Version", "n_removed"]
    got = {r.doc_id: tuple(r) for r in out.collect()}
    assert got == {1: (1, rows[0][1], "a", [1], "v", 0), 2: (2, "other", "b", [2], "w", 1)}


def test_crowded_tokens(spark, monkeypatch):
    """Groups of near copies on both sides of the bound of crowded tokens, in parts of few lines."""
    monkeypatch.setattr(line_dedup, "PART_LINES", 20)
    r = np.random.RandomState(5)
    base = [f"w{x}" for x in range(30)]
    made = []
    for k in range(180):
        words = list(base)
        for x in r.choice(30, size=r.randint(0, 6), replace=False):
            words[x] = f"e{r.randint(400)}"
        made.append((k, " ".join(words) + "\n" + " ".join(f"o{v}" for v in r.randint(60, size=8))))
    earlier, want = [], {}
    for i, t in made:
        keep = []
        for line in t.split("\n"):
            s = tokens(line)
            if not any(len(s & e) * 5 >= 4 * len(s | e) for e in earlier):
                keep.append(line)
            earlier.append(s)
        want[i] = "\n".join(keep)
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    for crowd in (1, line_dedup.CROWD):
        monkeypatch.setattr(line_dedup, "CROWD", crowd)
        got = {x.doc_id: x.text for x in line_dedup.dedup_lines(docs, least=1).collect()}
        assert got == want
    assert 20 < sum(len(x) < len(t) for (_, t), x in zip(made, want.values())) < 180
