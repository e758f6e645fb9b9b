"""Helpers that several operators share."""

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

import merchframe
from merchframe.session import settle

#: Rows of (id, small fixed columns) that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000

_shipped = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers keep their caches."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(merchframe.__file__)
    target = os.path.join(tempfile.mkdtemp(prefix="merchframe-"), "merchframe.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("merchframe", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df` with a broadcast hint if it has at most BROADCAST_ROWS rows, else as it is.

    For settled tables of a few fixed-width columns; `rows` saves the count if known.
    """
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def repartition_small_files(df: DataFrame) -> DataFrame:
    """Spread rows over the session's cores where the input has fewer partitions than cores.

    A narrow read of one file would else run heavy work in one task.
    """
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, label), label the smallest node.

    Alternating large-star and small-star contraction; every round is written and read back, so a
    lost executor repeats one round at most. Hubs are handled by minima with partial sums and by
    joins that the adaptive planner can split; no neighbour list is ever collected.
    """
    e = settle(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges")
    seen = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", "m")).distinct())
        e = settle(small, "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        e.select("b", "b").distinct())
