"""Hand-written rows for rules that the driver tables don't reach."""

from pyspark.sql import functions as F

from merchframe.functions import text, urls, values
from merchframe.functions.jsonld import first_product
from merchframe.operators import mapping, products
from merchframe.sources.feed_files import scan_feed_csv


def column(spark, make, *cells):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(make("c")).collect()]


def test_clean_and_header(spark):
    assert column(spark, text.clean_value, " NaN ", None, " x\t", "none!") == ["", "", "x", "none!"]
    assert column(spark, text.is_header_string, "1,000", "-inf", "1_0", "5d", "", "Price") == [
        False, False, False, True, False, True]


def test_prices(spark):
    rows = [("BIGINT", "989"), ("DECIMAL(3,2)", "9.89"), ("STRING", "9.89"), ("STRING", "1,989"),
            ("BOOLEAN", "true"), ("STRING", "5.5d"), ("STRING", "")]
    df = spark.createDataFrame(rows, "k string, t string")
    got = [r[0] for r in df.select(values.to_major_units("k", "t")).collect()]
    assert got == [9.89, 9.89, 9.89, 19.89, None, None, None]


def test_join_url(spark):
    df = spark.createDataFrame([("../c?x=1",), ("/d",), ("//h/e",), ("#f",), ("",), ("g",)], "h string")
    got = [r[0] for r in df.select(urls.join_url(F.lit("https://s.com/a/b/?q"), "h")).collect()]
    assert got == ["https://s.com/a/c?x=1", "https://s.com/d", "https://h/e",
                   "https://s.com/a/b/?q#f", "https://s.com/a/b/?q", "https://s.com/a/b/g"]


def test_linked_data_order():
    nested = '{"@graph": [{"@type": "ItemList", "itemListElement": [{"@type": ["x", "Product"], "name": "a"}]},'
    assert '"a"' in first_product(nested + ' {"@type": "Product", "name": "b"}]}')
    assert first_product("{bad") is None and first_product('{"@type": "Person"}') is None


def feed(spark, rows, headers):
    df = spark.createDataFrame([("f", i, list(r)) for i, r in enumerate(rows)],
                               "feed_id string, pos bigint, cells array<string>")
    heads = spark.createDataFrame([("f", headers)], "feed_id string, headers array<string>")
    return df, mapping.map_feeds(heads)


def by_order(df):
    return df.orderBy("pos", "variant_idx").collect()


def test_continuation_and_numbering_cross_blocks(spark):
    titles = ["", "a", "", "a", "", "", "b", "a", ""]
    df, mapped = feed(spark, [(t, "S") for t in titles], ["Title", "Size"])
    for bits in (0, 1, 2, 16):
        rows = by_order(products.generate(df, mapped, bits=bits))
        assert [r["URL handle"] for r in rows] == ["a", "a", "a-2", "a-2", "a-2", "b", "a-3", "a-3"]


def test_one_hot_feed_matches_plain_loop(spark):
    titles = [["", "x", "y", "x"][i * 7 % 4 if i % 3 else 0] for i in range(300)]
    want, seen, active = [], {}, None
    for t in titles:
        if t:
            seen[t] = seen.get(t, 0) + 1
            active = t if seen[t] == 1 else f"{t}-{seen[t]}"
        if active:
            want.append(active)
    df, mapped = feed(spark, [(t,) for t in titles], ["Title"])
    got = [r["URL handle"] for r in by_order(products.generate(df, mapped, bits=4))]
    assert got == want


def test_expanded_variants_are_active_and_markup_stays_whole(spark):
    df, mapped = feed(spark, [("T", "S,M", "Draft"), ("U", "<p>a, b</p>", "archived")],
                      ["Title", "Size", "Status"])
    rows = by_order(products.generate(df, mapped))
    assert [(r["Option1 value"], r["Status"]) for r in rows] == [
        ("S", "Draft"), ("M", "Active"), ("<p>a, b</p>", "Archived")]
    assert [r["Title"] for r in rows] == ["T", "", "U"]


def test_feed_without_title_gives_nothing(spark):
    df, mapped = feed(spark, [("x",)], ["Price"])
    assert products.generate(df, mapped).count() == 0


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Title row\nName,Note\n"x","one\ntwo, three"\ny,"q ""q"""\n')
    (tmp_path / "b.csv").write_bytes("Name;Note\ncaf\xe9;1\n".encode("latin-1"))
    rows = scan_feed_csv(spark, str(tmp_path)).orderBy("feed_id", "pos").collect()
    assert [r.cells for r in rows] == [
        ["Title row"], ["Name", "Note"], ["x", "one\ntwo, three"], ["y", 'q "q"'],
        ["Name", "Note"], ["café", "1"]]
