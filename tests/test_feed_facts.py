"""What holds for a whole feed is worked out on the feed's one row."""

from pyspark.sql import functions as F

from merchframe.operators import products


def projected(spark, constants):
    rows = spark.createDataFrame([("f", p, ["t", None, "x"]) for p in range(3)] + [("g", 0, ["u"])],
                                 "feed_id string, pos bigint, cells array<string>")
    targets = spark.createDataFrame([("f", ["Title", "Price", "Status"]), ("g", ["Title"])],
                                    "feed_id string, targets array<string>")
    fixed = spark.createDataFrame([("f", {"Status": "Draft", "SKU": "no slot"})],
                                  "feed_id string, constants map<string,string>") if constants else None
    return products.project_fields(rows, targets, fixed)


def test_values_and_mapped_targets(spark):
    for constants, status in ((True, "Draft"), (False, "x")):
        got = projected(spark, constants).select("feed_id", *[products.value(t).alias(t) for t in ("Title", "Price", "Status", "SKU")],
                                                 products.is_mapped("Status").alias("m"), products.is_mapped("SKU").alias("k"),
                                                 F.size("vals").alias("n"))
        width = len(products.TARGET_COLUMNS)
        assert sorted(map(tuple, got.distinct().collect())) == [
            ("f", "t", "", status, "", True, False, width), ("g", "u", "", "", "", False, False, width)]


def test_rows_take_them_from_the_join(spark):
    for constants in (True, False):
        plan = projected(spark, constants)._jdf.queryExecution().optimizedPlan().toString()
        above = plan[:plan.index("Join")]
        assert "isnotnull" not in above and " mapped#" in above
