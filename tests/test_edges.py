"""Odd inputs: deep and broken pages, repeated keys, long listings, unreadable dates."""

import pytest

from merchframe import session
from merchframe.functions.html import _Elements
from merchframe.functions.jsonld import first_product
from merchframe.operators import payloads
from merchframe.sources.sinks import write_audit_json


def test_deep_page_parses_in_linear_time():
    page = _Elements().finish("<div>" * 50_000 + "x</b>" * 50_000)
    assert len(page.nodes) == 50_000 and "".join(page.texts).count("x") == 50_000


@pytest.mark.parametrize("value", ["5", '"a"', "{}", "null", "[[1], null]", "true"])
def test_odd_item_lists(value):
    assert first_product('{"@type": "ItemList", "itemListElement": %s}' % value) is None


def test_too_deep_linked_data():
    assert first_product("[" * 200_000) is None


def test_long_listing_and_repeated_keys(spark):
    many = ",".join('{"handle": "h%d"}' % i for i in range(1500))
    rows = [("s", "c", 1, '{"products": [%s]}' % many),
            ("s", "c", 2, '{"products": [{"handle": "x", "handle": "last"}]}'),
            ("s", "c", 3, '{"products": []}'), ("s", "c", 4, '{"products": [{"handle": "after"}]}'),
            ("s", "d", 900, '{"products": [{"handle": "far"}]}')]
    listing = spark.createDataFrame(rows, "store_url string, collection string, page int, body string")
    found = payloads.listing_handles(listing).collect()
    assert len({(r.collection, r.page, r.idx) for r in found}) == len(found) == 1502
    assert {"last", "far"} <= {r.handle for r in found} and "after" not in {r.handle for r in found}


def test_unreadable_audit_date(spark, tmp_path):
    docs = spark.sql("SELECT 'https://a.com' AS store_url, 'no date' AS audit_date, named_struct('x', 1) AS document")
    write_audit_json(docs, str(tmp_path / "out"))
    assert [r.day for r in spark.read.json(str(tmp_path / "out")).collect()] == ["undated"]


def test_shared_folder_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, other=None: other)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        session.shared_folder(Cluster, "x")
