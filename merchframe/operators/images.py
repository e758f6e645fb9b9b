"""Image files: inventory and conversion plan (no pixels are touched)."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from merchframe.functions.text import or_blank
from merchframe.functions.urls import stem, suffix
from merchframe.schema import IMAGE_SUFFIXES, IMAGE_TARGETS


def image_inventory(files: DataFrame) -> DataFrame:
    """Files with an image suffix in any case, sorted by path."""
    return files.where(suffix("path").isin(IMAGE_SUFFIXES)).orderBy("path")


def scan_image_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Inventory of a folder tree; file contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return image_inventory(files.select("path", "length", "modificationTime"))


def target_format(c) -> Column:
    name = F.upper(or_blank(c))
    return F.when(name.isin(list(IMAGE_TARGETS)), name).otherwise("WEBP")


def image_plan(files: DataFrame, wanted: str = "WEBP") -> DataFrame:
    """(path, supported, out_name, collides): what a conversion would write.

    Outputs that share a name are counted first and joined back, so a name that most files share
    is pre-aggregated instead of windowed. Files without an output take no part in the join.
    """
    fmt = target_format(F.lit(wanted))
    extension = F.create_map(*[F.lit(x) for p in IMAGE_TARGETS.items() for x in p])[fmt]
    supported = suffix("path").isin(IMAGE_SUFFIXES)
    plan = files.select("path", supported.alias("supported"),
                        F.when(supported, F.concat(stem("path"), extension)).alias("out_name"))
    shared = plan.where("supported").groupBy("out_name").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").select("out_name", F.lit(True).alias("_shared"))
    named = plan.where("supported").join(shared, "out_name", "left").select(
        "path", "supported", "out_name", F.coalesce("_shared", F.lit(False)).alias("collides"))
    return named.unionByName(plan.where("NOT supported").withColumn("collides", F.lit(False)))


def image_plan_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count_if("supported").alias("converted"),
                    F.count_if(~F.col("supported")).alias("skipped"))
