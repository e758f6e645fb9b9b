"""First values of columns are found by position, without a sort of all cells."""

from pyspark.sql import Row

from merchframe.operators import mapping


def test_sample_values_sort_no_cells(spark):
    rows = spark.createDataFrame([
        Row(feed_id="a", pos=2, cells=["late", "", " x "]), Row(feed_id="a", pos=1, cells=["", "", "y"]),
        Row(feed_id="a", pos=None, cells=["no", "no", "no"]), Row(feed_id="b", pos=1, cells=["", None, ""]),
        Row(feed_id="b", pos=1, cells=["k"])])
    headers = spark.createDataFrame([Row(feed_id="a", headers=["A", "B", "C"]), Row(feed_id="b", headers=["D", "E"])])
    got = mapping.sample_values(rows, headers)
    assert {(r["feed_id"], r["col_idx"]): (r["client_col"], r["sample"]) for r in got.collect()} == {
        ("a", 0): ("A", "late"), ("a", 1): ("B", ""), ("a", 2): ("C", "y"), ("b", 0): ("D", "k"), ("b", 1): ("E", "")}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan, plan
