"""Lines meet on a fixed number of sketches, however many lines share a token."""

from merchframe.llm import line_dedup


def test_rows_that_meet_grow_with_the_lines(spark, monkeypatch, tmp_path):
    made, most = {}, {}
    settle = line_dedup.settle

    def counted(df, name):
        out = settle(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(line_dedup, "settle", counted)
    met = line_dedup._met
    monkeypatch.setattr(line_dedup, "_met", lambda firsts: (most.update(met=met(firsts).count()), met(firsts))[1])
    for n in (100, 500):
        # All lines share their words but two; at 500 rows every word is shared by more than 128 lines.
        docs = spark.createDataFrame([(k, f"a b c d e f g h own{k} one{k}") for k in range(n)], "doc_id long, text string")
        assert line_dedup.repeated_lines(docs, 1).count() == 0
        assert most["met"] == 3 * n
        assert made["line-crowds"] == 0
    # Near copies are settled by their sketches: no more than one candidate a line.
    copies = [(k, f"a b c d e f g h i j k l m n o p own{k}") for k in range(300)]
    made.clear()
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    assert line_dedup.repeated_lines(docs, 1).count() == 299
    assert made["line-pairs"] <= 400 and made["lines-found"] >= 295
