"""Captures, positions, given mappings and sources that no table of the driver reaches."""

from pyspark.sql import functions as F

from merchframe.operators import feeds, images, mapping, pages, payloads, products

DETAIL = "store_url string, handle string, status int, is_uk boolean, body string"


def test_last_capture_wins(spark):
    rows = [("s", "a", 200, True, '{"title": "Old"}', "2024-01-01"), ("s", "a", 200, True, '{"title": "New"}', "2024-03-01"),
            ("s", "a", 500, True, None, "2024-02-01"), ("s", "b", 200, True, '{"title": "B"}', None),
            ("s", "c", 200, True, '{"title": "C1"}', "2024-01-01"), ("s", "c", 200, True, '{"title": "C2"}', "2024-01-01")]
    detail = spark.createDataFrame(rows, DETAIL + ", captured_at string")
    handles = spark.createDataFrame([("s", "x", 1, i, h) for i, h in enumerate("abcd")],
                                    "store_url string, collection string, page int, idx int, handle string")
    ties = set()
    for parts in (1, 3, 7):
        got = {r.handle: r for r in payloads.crawl_drafts(payloads.join_listing_detail(
            handles, detail.repartition(parts))).join(handles, ["store_url", "collection", "page", "idx"]).collect()}
        assert set(got) == {"a", "b", "c"} and got["a"].title == "New" and got["b"].title == "B"
        ties.add(got["c"].title)
    assert len(ties) == 1
    errors = payloads.crawl_errors(payloads.join_listing_detail(handles, detail)).collect()
    assert [r.handle for r in errors] == ["d"]
    summary = payloads.crawl_summary(payloads.join_listing_detail(handles, detail)).first()
    assert (summary.row_count, summary.error_count, summary.failure) == (3, 1, "")


def test_positions_beyond_21_bits(spark):
    far = 2**21 + 1
    places = [(1, 0, 0), (1, far, 0), (1, far, 1), (far, 0, 0), (far, 0, far), (far + 1, 2, 0)]
    blank = [F.lit(None).cast("string").alias(c) for c in payloads.DRAFT_COLUMNS if c != "title"]
    rows = spark.createDataFrame([("s", "c", *p, str(n)) for n, p in enumerate(places)][::-1],
                                 "store_url string, collection string, page int, idx int, variant_idx int, title string")
    got = payloads.drafts_to_feed(rows.select("*", *blank)).orderBy("pos").collect()
    assert [(r.pos, r.cells[0]) for r in got] == [(n, str(n)) for n in range(len(places))]


def test_repeated_keys_whatever_ran_before(spark):
    repeated = [("s", "a", 200, True, '{"title": "x", "title": "last"}')]
    detail = spark.createDataFrame(repeated, DETAIL)
    html = '<script type="application/ld+json">{"@type": "Product", "name": "a", "name": "b"}</script>'
    page = spark.createDataFrame([("p", html)], "page_id string, html string")
    for _ in range(2):
        spark.conf.unset("spark.sql.variant.allowDuplicateKeys")
        assert payloads.parse_products(detail).where("product IS NOT NULL").count() == 1
        spark.conf.unset("spark.sql.variant.allowDuplicateKeys")
        assert pages.parse_pages(page).select(F.size(pages.jsonld_blocks(F.col("page")))).first()[0] == 1
        list(payloads.listing_handles(spark.createDataFrame(
            [("s", "c", 1, "{}")], "store_url string, collection string, page int, body string")).collect())


def test_single_product_address(spark):
    rows = [("https://s.com", "p1", 200, False, '{"title": "T", "variants": [{"price": 1250, "option1": "S"}, {"price": "9.5"}]}'),
            ("https://s.com", "p2", 200, False, "not json")]
    got = payloads.product_drafts(spark.createDataFrame(rows, DETAIL), ["handle"]).orderBy("variant_idx").collect()
    assert [(r.handle, r.variant_idx, r.title, r.url_handle, r.price) for r in got] == [
        ("p1", 0, "T", "p1", "12.50"), ("p1", 1, "", "p1", "9.50")]


def test_given_mapping_conflicts_and_constants(spark):
    heads = spark.createDataFrame([("f", ["A", "B", "C"]), ("none", ["A"])], "feed_id string, headers array<string>")
    given = spark.createDataFrame([
        ("f", 1, "Title", None), ("f", 0, "Title", None), ("f", 2, "Vendor", "House"), ("f", 2, "Tags", "x"),
        ("f", 9, "Price", None), ("f", 1, "", None), ("other", 0, "Title", None), ("f", 1, "No such field", "y")],
        "feed_id string, col_idx int, target_field string, constant_value string")
    got = {r.feed_id: r for r in mapping.given_mapping(given, heads).collect()}
    # Column 2 is mapped twice and takes the smaller target; a row beyond the headers is ignored.
    assert got["f"].targets == ["Title", "", "Tags"] and got["f"].constants == {"Tags": "x"}
    assert got["none"].targets == [""] and got["none"].constants == {}
    rows = spark.createDataFrame([("f", 0, ["a", "b", "c"]), ("f", 1, ["d", "", ""])],
                                 "feed_id string, pos bigint, cells array<string>")
    mapped = mapping.given_mapping(given, heads)
    out = products.generate(rows, mapped, mapped.select("feed_id", "constants")).orderBy("pos").collect()
    assert [(r.Title, r.Tags) for r in out] == [("a", "x"), ("d", "x")]


def test_image_folder_and_shared_names(spark, tmp_path):
    for name in ("b/one.PNG", "a/one.jpg", "a/two.webp", "a/skip.txt", "a/none"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1234")
    found = images.scan_image_folder(spark, str(tmp_path))
    rows = found.collect()
    assert [r.path.rsplit("/", 2)[1:] for r in rows] == [["a", "one.jpg"], ["a", "two.webp"], ["b", "one.PNG"]]
    assert found.columns == ["path", "length", "modificationTime"] and {r.length for r in rows} == {4}
    files = spark.createDataFrame([(p,) for p in ["/x/one.png", "/y/one.jpg", "/z/two.png", "/n.txt", "/m.txt"]], "path string")
    plan = {r.path: (r.supported, r.out_name, r.collides) for r in images.image_plan(files).collect()}
    assert plan == {"/x/one.png": (True, "one.webp", True), "/y/one.jpg": (True, "one.webp", True),
                    "/z/two.png": (True, "two.webp", False), "/n.txt": (False, None, False), "/m.txt": (False, None, False)}


def test_selected_sheet_to_rows(spark):
    rows = [("book", 0, "Notes", 0, ["x"]), ("book", 1, "Raw Merged Data", 0, ["Title", "Price"]),
            ("book", 1, "Raw Merged Data", 1, ["Ring", "5"])]
    sheets = spark.createDataFrame(rows, "feed_id string, sheet_idx int, sheet string, pos bigint, cells array<string>")
    out = products.generate_feeds(feeds.read_selected_sheet(sheets)).collect()
    assert [(r.Title, r.Price) for r in out] == [("Ring", "5")]


def test_reasons_of_rejection(spark):
    deep = lambda n: '{"a": ' + "[" * (n - 1) + "]" * (n - 1) + "}"
    bodies = {
        deep(1000): None, deep(1001): "too deep", deep(1001)[:-3]: "too deep", deep(1000)[:-3]: "invalid",
        '{"a": "' + "[{" * 3000 + '"}': None, '{"a": "' + "[{" * 3000: "invalid", '{"a": "\\\\"' + "[" * 3000: "too deep",
        '{"a": "\\"' + "[" * 3000: "invalid", '{"\\u005b": [' + "[],[{}]," * 900 + "1]}": None,
        '{"a": [' + "[],[{}]," * 900 + "}": "invalid", "": "empty", " \n": "empty", None: "empty", "[]": "not an object",
        "<html>": "not an object", '"{}"': "not an object", "{}": None, "{" * 999: "invalid", "}" * 2000: "not an object",
        '{"a": 1} <!-- cached -->': "invalid", '{"a": 1};': "invalid", ' {"a": 1}\n': None, '{"a": 1, "a": 2}': None}
    rows = spark.createDataFrame([("s", "h", b, k) for k, b in enumerate(bodies)], "store_url string, handle string, body string, k int")
    got = {r.k: (r.reason, r.good) for r in payloads.parse_products(rows).select(
        "k", "reason", F.col("product").isNotNull().alias("good")).collect()}
    for k, (body, reason) in enumerate(bodies.items()):
        assert got[k] == (reason, reason is None), (body or "")[:40]
    big = spark.range(1).select(F.concat(F.lit('{"a": "'), F.repeat(F.lit("x"), F.lit(20_000_001)), F.lit('"}')).alias("body"))
    assert payloads.parse_products(big).select("reason").first()[0] == "too large"
    detail = spark.createDataFrame([("s", "a", 200, True, deep(1200)), ("s", "b", 404, True, "x"), ("s", "c", None, True, None),
                                    ("s", "e", 200, True, "{}")], DETAIL)
    handles = spark.createDataFrame([("s", "x", 1, i, h) for i, h in enumerate("abcde")],
                                    "store_url string, collection string, page int, idx int, handle string")
    errors = {r.handle: r.reason for r in payloads.crawl_errors(payloads.join_listing_detail(handles, detail)).collect()}
    assert errors == {"a": "too deep", "b": None, "c": "empty", "d": None}
