"""Feeds in blocks: one feed with most rows, and how often wide rows are shuffled."""

import re

import pytest
from pyspark.sql import functions as F

from merchframe.operators import feeds, products
from merchframe.operators.ordered import feed_blocks, join_feed, place

HEADER = ["Name", "Size", "Status", "Notes"]


def feed_rows(spark, n=400):
    hot = [("hot", 0, HEADER)] + [("hot", i, [["", "ring", "pin"][i % 3], "S,M" if i % 7 == 0 else "S", "draft" if i > 50 else "", "x"])
                                  for i in range(1, n)]
    small = [(f"f{k}", i, HEADER if i == 0 else ["ring", "L", "", ""]) for k in range(5) for i in range(4)]
    return spark.createDataFrame(hot + small, "feed_id string, pos bigint, cells array<string>")


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_rows_are_the_same_in_blocks_of_any_size(spark, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        rows = feed_rows(spark)
        want = sorted(map(tuple, products.generate_feeds(rows, bits=20).collect()))
        assert len(want) > 400 and {r[0] for r in want} == {"hot", *(f"f{k}" for k in range(5))}
        for bits in (3,):
            assert sorted(map(tuple, products.generate_feeds(rows, bits=bits).collect())) == want
        status = {r.feed_id: r.Status for r in products.generate_feeds(rows, bits=3).where("kind = 'first'").collect()}
        assert status["hot"] == "Draft" and status["f1"] == "Active"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_feed_spreads(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = place(feed_rows(spark, 4000), 6)
    sizes = [r.n for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # One feed holds 99.5 % of all rows; by feed alone one task would take them all.
    assert len(sizes) >= 3 and max(sizes) < 4000 * 0.6
    joined = join_feed(rows, feeds.feed_headers(feed_rows(spark, 4000)), feed_blocks(rows))
    assert joined.count() == 4020


def test_raw_rows_are_shuffled_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = products.generate_feeds(feed_rows(spark))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # From the output's window down to the rows: joins and a union in place, then the one exchange of rows.
    lines = [re.sub(r"^[ :+*()0-9-]*", "", line) for line in plan.splitlines()]
    top = [line.split()[0] for line in lines if line.split() and line.split()[0] in ("Window", "Union", "SortMergeJoin", "Exchange", "Scan")]
    first = top.index("Exchange")
    assert top[:first].count("Window") == 2 and "Union" in top[:first] and top[:first].count("SortMergeJoin") == 2
    assert "Scan" == top[first + 1]
