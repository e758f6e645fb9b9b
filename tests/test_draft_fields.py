"""Draft fields of odd payloads, and that a query of few fields reads few."""

from merchframe.operators import payloads

BODIES = [
    '{"title": " A ", "price": 250, "variants": [{"sku": 5, "price": 1200, "option1": "Default Title"}, null, 7,'
    ' {"sku": " x ", "price": "12.5", "option1": 2.0, "featured_image": {"src": "//c/v.jpg"}, "inventory_quantity": -3}]}',
    '{"title": 0, "handle": false, "price": 250, "variants": {"sku": "no list"}, "images": ["//c/i.jpg"], "tags": ["x", 0, 3.0]}',
    ' {"variants": [], "compare_at_price": "300", "price": 100, "featured_image": {"src": 4}, "options": [5, {"name": "T"}]} ',
    '{"variants": [{"featured_image": "//c/s.jpg", "price": true}], "images": "none", "description": ["a\\r\\n", null, "b"]}',
]


def drafts(spark):
    rows = [("s", f"h{i}", 200, False, b) for i, b in enumerate(BODIES)]
    detail = spark.createDataFrame(rows, "store_url string, handle string, status int, is_uk boolean, body string")
    return payloads.product_drafts(detail.repartition(2), ["store_url"])


def test_fields_of_odd_payloads(spark):
    names = ["url_handle", "variant_idx", "title", "description", "tags", "sku", "price", "compare_at_price",
             "option1_value", "inventory_quantity", "product_image_url"]
    got = sorted(tuple(r) for r in drafts(spark).select(*names).collect())
    assert got == [
        ("h0", 0, "A", "", "", "5", "12.00", "", "", "", ""),
        ("h0", 1, "", "", "", "", "", "", "", "", ""),
        ("h0", 2, "", "", "", "", "", "", "", "", ""),
        ("h0", 3, "", "", "", "x", "12.50", "", "2.0", "0", ""),
        ("h1", 0, "", "", "x, 3.0", "", "2.50", "", "", "", "https://c/i.jpg"),
        ("h2", 0, "", "", "", "", "1.00", "3.00", "", "", "4"),
        ("h3", 0, "", "a b", "", "", "", "", "", "", "https://c/s.jpg"),
    ]


def test_few_fields_are_read_without_lambdas(spark):
    """A lambda over all fields computes each for every variant, whatever the query reads."""
    plan = drafts(spark).select("url_handle", "sku", "price")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
