"""Crawled stores to product rows: what a step shuffles is gone before the next, and blocks of pages change no row."""

import glob
import os
import re
import time
import uuid

import pytest
from pyspark.sql import functions as F

from merchframe import session
from merchframe.operators import mapping, payloads, products
from merchframe.plans import product_queries
from merchframe.schema import DRAFT_COLUMNS
from merchframe.session import DROP_SHUFFLES, settle, settle_parts


def _shuffles(spark):
    """Bytes of the files of shuffles that lie on the disk of a local session, by name."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def _left(spark, before, most=0):
    """Bytes of shuffles that are new; removed ones take a moment to go."""
    for _ in range(20):
        if (new := sum(size for name, size in _shuffles(spark).items() if name not in before)) <= most:
            break
        time.sleep(0.25)
    return new


def _tables(spark, folder):
    o = F.col("id").alias("o_orderkey")
    spark.range(1, 600).select(
        o, F.col("id").alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.lit(12.5).alias("o_totalprice"),
        F.lit("1-URGENT").alias("o_orderpriority")).write.parquet(f"{folder}/orders.parquet")
    spark.range(1, 1800).select(
        (F.col("id") % 600).alias("l_orderkey"), F.col("id").alias("l_partkey"), (F.col("id") % 7).alias("l_suppkey"),
        F.floor(F.col("id") / 600).cast("int").alias("l_linenumber"), F.lit(11.0).alias("l_quantity"),
        (F.col("id") * 1.25).alias("l_extendedprice"), F.lit("A").alias("l_returnflag"),
        F.lit("O").alias("l_linestatus")).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_lean_tables_take_their_shuffles_off_the_disk(spark):
    before = _shuffles(spark)
    made = spark.range(1000).groupBy((F.col("id") % 50).alias("k")).agg(F.count("*").alias("n"))
    table = settle(made, "counted", lean=True)
    assert not _left(spark, before) and spark.conf.get(DROP_SHUFFLES, None) != "true"
    assert table.count() == 50 and table.agg(F.sum("n")).first()[0] == 1000
    spark.conf.set(DROP_SHUFFLES, "false")
    try:
        settle(made, "counted", lean=True)
        assert spark.conf.get(DROP_SHUFFLES) == "false"
    finally:
        spark.conf.unset(DROP_SHUFFLES)


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_steps_of_a_crawl_leave_no_shuffles_and_no_payloads(spark, tmp_path, monkeypatch):
    for module in (session, product_queries):
        monkeypatch.setattr(module, "shared_folder", lambda spark, name: f"{tmp_path}/{name}-{uuid.uuid4().hex}")
    sf, before, got = _tables(spark, tmp_path), _shuffles(spark), []
    for orders in (1000, 100):  # one job, six jobs
        monkeypatch.setattr(product_queries, "ORDERS_PER_JOB", orders)
        rows = product_queries.crawl_products(spark, sf)
        # A count of the orders is all that may be left: some bytes of each task.
        assert _left(spark, before, 2_000) <= 2_000
        got.append(sorted(map(tuple, rows.collect())))
        before = _shuffles(spark)
    assert got[0] == got[1] and len(got[0]) > 1500 and len(set(got[0])) == len(got[0])
    sizes = {name: [_bytes(f) for f in glob.glob(f"{tmp_path}/{name}-*")] for name in ("payloads", "drafts")}
    assert len(sizes["payloads"]) == 2 and max(sizes["payloads"]) < 5_000 < min(sizes["drafts"])


def test_a_crawl_of_nothing(spark, tmp_path):
    sf = _tables(spark, tmp_path / "some")
    for name in ("orders", "lineitem"):
        spark.read.parquet(f"{sf}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert product_queries.crawl_products(spark, f"{tmp_path}/none").count() == 0


def test_parts_of_a_table(spark):
    parts = [spark.range(10 * n, 10 * n + 10) for n in range(3)]
    assert [r.id for r in settle_parts(parts, "numbers").orderBy("id").collect()] == list(range(30))


def test_wide_rows_of_a_crawl_are_shuffled_once_a_job(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = product_queries.crawl_products(spark, _tables(spark, tmp_path))
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [re.sub(r"^[ :+*()0-9-]*", "", line) for line in plan.splitlines()]
    wide = [i for i, line in enumerate(lines) if line.startswith("Exchange")
            and any("FileScan" in x and "description" in x for x in lines[i:i + 6])]
    assert len(wide) == 1


@pytest.mark.parametrize("bits", [0, 2, 20])
def test_blocks_of_pages_of_any_size_give_the_same_rows(spark, monkeypatch, bits):
    columns = [c for c in DRAFT_COLUMNS if c not in ("title", "option1_name", "option1_value", "price")]
    places = [("hot", page, idx, v) for page in range(1, 14) for idx in range(3) for v in range(2)] + [("cold", 300, 0, 0)]
    rows = [(s, "c", p, i, v, f"ring {i}" if v == 0 and p != 5 else "", "Cut" if p < 4 and v == 0 else "", "S", f"{p}.{i}{v}")
            for s, p, i, v in places]
    drafts = spark.createDataFrame(rows[::-1], "store_url string, collection string, page int, idx int, variant_idx int, "
                                   "title string, option1_name string, option1_value string, price string").select(
        "*", *[F.lit("").alias(c) for c in columns])
    monkeypatch.setattr(payloads, "PAGE_BITS", bits)
    feed = payloads.drafts_to_feed(drafts)
    got = {(r.feed_id, r.pos): r for r in products.generate(
        feed, mapping.map_feeds(payloads.draft_headers(feed)), apart=bits == 2).collect()}
    assert len(got) == len(places)
    used = {}
    for n, (store, _, _, _, _, title, name, _, price) in enumerate(rows[:-1]):
        if title:
            base = title.replace(" ", "-")
            used[base] = used.get(base, 0) + 1
            handle, label = base if used[base] == 1 else f"{base}-{used[base]}", name or "Size"
        r = got["hot/collections/c", n]
        assert (r["Price"], r["URL handle"], r["Option1 name"], r["Option1 value"]) == (price, handle, label, "S")
    assert got["cold/collections/c", 0]["URL handle"] == "ring-0"
