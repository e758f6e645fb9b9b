"""Sinks: product CSV and audit documents."""

from pyspark.sql import DataFrame, functions as F

from merchframe.functions.urls import clean_domain
from merchframe.schema import TARGET_COLUMNS

#: A compressed file is read by one task, so files of audits are closed after so many.
DOCUMENTS_PER_FILE = 20_000


def write_product_csv(product_rows: DataFrame, folder: str, by_feed: bool = False) -> None:
    """CSV files with a header, every field quoted and the 39 columns in order.

    `by_feed` adds one folder per feed; rows of a feed stay together in source order.
    """
    order = ["feed_id", "pos", "variant_idx"]
    keep = ["feed_id"] if by_feed else []
    # A range partition by feed and position keeps order across files and splits hot feeds.
    rows = product_rows.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = rows.select(*keep, *TARGET_COLUMNS).write.mode("error").options(
        header=True, quoteAll=True, escape='"', emptyValue="", nullValue="")
    if by_feed:
        writer = writer.partitionBy("feed_id")
    writer.csv(folder)


def write_audit_json(documents: DataFrame, folder: str) -> None:
    """One JSON line per store, named by domain and day, in one folder per day.

    Documents without a readable date share the day "undated". A folder per store would leave a large run with one tiny file per store.
    Files are compressed by gzip, as documents repeat the names and texts of the checks.
    """
    day = F.coalesce(F.date_format(F.try_to_timestamp("audit_date"), "yyyy-MM-dd"), F.lit("undated"))
    documents.select(
        day.alias("day"), F.concat_ws("_", clean_domain("store_url"), day).alias("audit"),
        "document.*").write.mode("error").partitionBy("day").options(
            compression="gzip", maxRecordsPerFile=DOCUMENTS_PER_FILE).json(folder)
