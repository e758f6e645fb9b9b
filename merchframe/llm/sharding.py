"""Shards that all follow the mixture of sources, in SQL functions.

Rows get a seeded random order within their source; (rank - 1/2) / source size is their fractional
rank. In the order of fractional ranks every stretch holds each source in proportion, so cutting it
into equal stretches gives every shard the mixture, to within a row for each source. Law: row
counts of shards differ by one at most.

Both ranks are distributed: rows fall into ranges of the random order (then of the fractional
rank), counts of ranges give where a range starts, and rows are numbered within their range only.
A source with a third of all rows spreads over all ranges. Range counts grow with the row count.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from merchframe.llm.common import settle, shuffle_partitions

SEED = "mixture-1"
#: Aim of rows in a range; ranges a shuffle partition at least, so that hashing evens them out.
RANGE_ROWS, RANGES_PER_PARTITION = 50_000, 16


def _ranges(n: int, partitions: int) -> int:
    """A power of two, so that leading hex digits can tell the range."""
    return 1 << max(partitions * RANGES_PER_PARTITION, n // RANGE_ROWS, 1).bit_length()


def _start(counts: DataFrame, by: str, within: list) -> DataFrame:
    """Running start of each range `by` (of all, or of each group `within`), with the total."""
    w = W.partitionBy(*within)
    before = F.sum("n").over(w.orderBy(by).rowsBetween(W.unboundedPreceding, -1))
    return counts.select(*within, by, F.coalesce(before, F.lit(0)).alias("start"), F.sum("n").over(w).alias("total"))


def _random(doc_id: Column) -> Column:
    """32 random bits that depend on the seed and doc_id alone."""
    text = F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def shard_by_mixture(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source, ...): doc_id, source, size, text_crc32, law,
    shard, slot, grown_shard.

    size: UTF-8 bytes of the text (null: none) plus 1. text_crc32 of a null text is that of an empty
    one. slot counts from 0 in each shard in mixture order. Null is a source of its own. Ties go by
    doc_id (nulls first), text_crc32 and size; rows equal in all of these are interchangeable.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id", "source")
    n = ids.count()
    ranges = _ranges(n, shuffle_partitions(spark))
    bits = ranges.bit_length() - 1
    source = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    at = F.shiftright("random", 32 - min(bits, 32))

    def keyed(df, *more):
        return df.select("doc_id", source.alias("src"), _random(F.col("doc_id")).alias("random"), *more).withColumn("at", at)

    starts = _start(keyed(ids).groupBy("src", "at").agg(F.count("*").alias("n")), "at", ["src"])
    rows = keyed(docs, (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                 F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    tie = ["src", "doc_id", "text_crc32", "size"]
    own = F.row_number().over(W.partitionBy("src", "at").orderBy("random", "doc_id", "text_crc32", "size"))
    ranked = rows.withColumn("own", own).join(starts, ["src", "at"])
    fraction = (F.col("start") + F.col("own") - F.lit(0.5)) / F.col("total")
    mixed = settle(ranked.select("doc_id", "src", "size", "text_crc32", fraction.alias("fraction")).withColumn(
        "at", F.floor(F.col("fraction") * ranges).cast("long")), "mixture")
    starts = _start(mixed.groupBy("at").agg(F.count("*").alias("n")), "at", [])
    own = F.row_number().over(W.partitionBy("at").orderBy("fraction", *tie))
    place = F.col("start") + F.col("own") - 1
    placed = mixed.withColumn("own", own).join(starts, "at").withColumn("place", place.cast("long"))
    return placed.withColumn("shard", F.expr(f"CAST(place * {shards} DIV total AS INT)")).select(
        "doc_id", F.when(~F.col("src.none"), F.col("src.name")).alias("source"), "size", "text_crc32",
        F.lit("rows").alias("law"), "shard",
        # A shard begins at the first place whose share of the total reaches it.
        F.expr(f"place - (CAST(shard AS BIGINT) * total + {shards - 1}) DIV {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
