"""Feed normalisation on the long form `feed_rows(feed_id, pos, cells)`.

Client headers stay data: they never become column names, so feeds of any shape share one plan.
"""

from pyspark.sql import Column, DataFrame, functions as F

from merchframe.functions.text import clean_value, is_header_string, is_nonempty
from merchframe.operators.ordered import first_in_order, join_feed
from merchframe.schema import (
    HEADER_MIN_SHARE, HEADER_SCAN_ROWS, PREFERRED_SHEETS, PREVIEW_CHARS,
    PREVIEW_FALLBACK_COLUMNS, PREVIEW_PRIORITY, PREVIEW_ROWS, SKIPPED_SHEETS,
)
from merchframe.functions.text import contains_any, strip


def cell_at(cells: Column, i) -> Column:
    """Cell by 0-based index; short rows read as padded with blanks."""
    return F.coalesce(F.get(cells, i), F.lit(""))


def padded(cells: Column, width: Column) -> Column:
    return F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0))))


# --- header row -------------------------------------------------------------------------

def detect_header(feed_rows: DataFrame) -> DataFrame:
    """(feed_id, header_pos, width, header_cells): one row per feed.

    The header is the first of a feed's first ten rows in which at least half of the feed's
    columns look like labels, else its first row.
    """
    widths = feed_rows.groupBy("feed_id").agg(F.max(F.size("cells")).alias("width"))
    labels = F.size(F.filter("cells", is_header_string))
    share = F.try_divide(labels, F.greatest(F.col("width"), F.lit(1)))
    head = first_in_order(feed_rows.select("feed_id", "pos", "cells"), ["feed_id"], "pos",
                          HEADER_SCAN_ROWS)
    return (
        head.join(widths, "feed_id")
        .groupBy("feed_id", "width")
        .agg(F.min_by(F.struct("pos", "cells"),
                      F.struct(share < HEADER_MIN_SHARE, F.col("pos"))).alias("h"))
        .select("feed_id", F.col("h.pos").alias("header_pos"), "width",
                padded(F.col("h.cells"), F.col("width")).alias("header_cells"))
    )


def header_names(header_cells: Column) -> Column:
    """Names of a header row; blanks are numbered by column."""
    return F.transform(
        F.transform(header_cells, clean_value),
        lambda c, i: F.when(c != "", c).otherwise(
            F.concat(F.lit("Column_"), (i + 1).cast("string"))))


def unique_headers(names: Column) -> Column:
    """Repeated names get a running suffix: array of struct(raw, name)."""
    start = F.array().cast("array<struct<raw:string,name:string>>")

    def add(done, raw):
        earlier = F.size(F.filter(done, lambda d: d["raw"] == raw))
        name = F.when(earlier == 0, raw).otherwise(
            F.concat(raw, F.lit("_"), earlier.cast("string")))
        return F.concat(done, F.array(F.struct(raw.alias("raw"), name.alias("name"))))
    return F.aggregate(names, start, add)


def kept_columns(unique: Column) -> Column:
    """Columns to keep as struct(name, idx): placeholder columns go, unless all would."""
    numbered = F.transform(unique, lambda u, i: F.struct(u["name"].alias("name"), i.alias("idx")))
    real = F.filter(numbered, lambda c: ~F.lower(clean_value(c["name"])).startswith("unnamed"))
    none = F.array().cast("array<struct<name:string,idx:int>>")
    return F.coalesce(F.nullif(real, none), numbered)


def feed_headers(feed_rows: DataFrame) -> DataFrame:
    """(feed_id, header_pos, width, headers, keep, duplicate_names): one row per feed."""
    named = detect_header(feed_rows).withColumn(
        "_unique", unique_headers(header_names(F.col("header_cells"))))
    named = named.withColumn("_kept", kept_columns(F.col("_unique")))
    names = F.transform("_unique", lambda u: u["name"])
    return named.select(
        "feed_id", "header_pos", "width",
        F.transform("_kept", lambda c: c["name"]).alias("headers"),
        F.transform("_kept", lambda c: c["idx"]).alias("keep"),
        (F.size(F.array_distinct(names)) < F.size("_unique")).alias("duplicate_names"),
    )


# --- body rows --------------------------------------------------------------------------

def apply_header(feed_rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows below the header with the feed's header columns joined on, by blocks of the feed.

    `headers` holds one row per feed.
    """
    return join_feed(feed_rows, headers).where(F.col("pos") > F.col("header_pos")).drop("_block")


def kept_cells(cells: Column, keep: Column) -> Column:
    return F.transform(keep, lambda i: clean_value(cell_at(cells, i)))


def drop_blank_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.exists("cells", lambda c: c != ""))


def normalize_feeds(feed_rows: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Clean body rows: (feed_id, pos, cells), cells aligned with `feed_headers.headers`."""
    headers = feed_headers(feed_rows) if headers is None else headers
    return body_rows(feed_rows, headers).drop("_block")


def body_rows(feed_rows: DataFrame, headers: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Clean body rows with `_block`, in place by (feed, block) for what follows."""
    body = join_feed(feed_rows, headers.select("feed_id", "header_pos", "keep"), blocks).where(
        F.col("pos") > F.col("header_pos"))
    kept = kept_cells(F.col("cells"), F.col("keep"))
    # The size names `cells` outside of the lambda: else Spark moves the test to the feeds' side of the join.
    filled = F.when(F.size("cells") > 0, F.exists(kept, lambda c: c != ""))
    return body.where(filled).select("feed_id", "_block", "pos", kept.alias("cells"))


def feed_profile(feed_rows: DataFrame) -> DataFrame:
    """(feed_id, row_count, column_count, headers) of every feed that has rows."""
    headers = feed_headers(feed_rows)
    counts = normalize_feeds(feed_rows, headers).groupBy("feed_id").agg(
        F.count(F.lit(1)).alias("row_count"))
    return counts.join(headers, "feed_id").select(
        "feed_id", "row_count", F.size("headers").alias("column_count"), "headers")


def reject_empty_feeds(feeds: DataFrame, feed_rows: DataFrame) -> DataFrame:
    """(feed_id, reason) of every registered feed that yields no data."""
    seen = feed_rows.select("feed_id").distinct().withColumn("seen", F.lit(True))
    alive = normalize_feeds(feed_rows).select("feed_id").distinct()
    return (
        feeds.select("feed_id").distinct().join(alive, "feed_id", "left_anti")
        .join(seen, "feed_id", "left")
        .select("feed_id", F.when(F.col("seen"), "File is empty or has no data rows after cleanup.")
                .otherwise("File is empty or has no data rows.").alias("reason"))
    )


def preview_columns(headers: Column, kind: str) -> Column:
    """0-based indexes of the columns a preview shows."""
    if kind == "upload":
        return F.sequence(F.lit(0), F.size(headers) - 1)
    wanted = F.array(*[F.lit(h) for h in PREVIEW_PRIORITY])
    found = F.transform(
        F.filter(wanted, lambda h: F.array_contains(headers, h)),
        lambda h: (F.array_position(headers, h) - 1).cast("int"))
    leading = F.slice(F.sequence(F.lit(0), F.size(headers) - 1), 1, PREVIEW_FALLBACK_COLUMNS)
    return F.when(F.size(found) > 0, found).otherwise(leading)


def preview_rows(rows: DataFrame, headers: DataFrame, kind: str = "upload") -> DataFrame:
    """First rows per feed with shortened cells: (feed_id, pos, headers, cells)."""
    shown = headers.select("feed_id", "headers", preview_columns(F.col("headers"), kind).alias("shown"))
    top = first_in_order(rows.select("feed_id", "pos", "cells"), ["feed_id"], "pos", PREVIEW_ROWS)
    return top.join(shown, "feed_id").select(
        "feed_id", "pos",
        F.transform("shown", lambda i: F.get("headers", i)).alias("headers"),
        F.transform("shown", lambda i: F.substring(cell_at(F.col("cells"), i), 1,
                                                   PREVIEW_CHARS[kind])).alias("cells"),
    )


# --- workbooks --------------------------------------------------------------------------

def select_sheet(sheet_rows: DataFrame) -> DataFrame:
    """(feed_id, sheet, sheet_idx): the sheet of every workbook to read.

    Two aggregations with partial sums; no window, so workbook size doesn't matter.
    """
    sheets = sheet_rows.groupBy("feed_id", "sheet_idx", "sheet").agg(
        F.max(F.size("cells")).alias("cols"),
        F.count_if(F.exists("cells", is_nonempty)).alias("data_rows"),
    )
    lower = F.lower(strip("sheet"))
    merged = F.contains(lower, F.lit("raw merged"))
    keyword = F.coalesce(*[F.when(F.contains(lower, F.lit(k)), F.lit(i))
                           for i, k in enumerate(PREFERRED_SHEETS, 1)])
    by_name = F.when(merged, 0).otherwise(F.coalesce(keyword, F.lit(len(PREFERRED_SHEETS) + 1)))
    skipped = contains_any(F.lower("sheet"), SKIPPED_SHEETS)
    fallback = by_name > len(PREFERRED_SHEETS)
    # The size tiers only rank sheets without a preferred name.
    order = F.struct(
        by_name.alias("name"),
        (fallback & skipped).alias("skipped"),
        (fallback & (F.col("data_rows") < 2)).alias("thin"),
        F.when(fallback, -F.col("cols")).otherwise(0).alias("cols"),
        F.when(fallback, -F.col("data_rows")).otherwise(0).alias("rows"),
        F.col("sheet_idx").alias("idx"),
    )
    return sheets.groupBy("feed_id").agg(
        F.min_by(F.struct("sheet", "sheet_idx"), order).alias("s")
    ).select("feed_id", "s.sheet", "s.sheet_idx")


def read_selected_sheet(sheet_rows: DataFrame) -> DataFrame:
    """`feed_rows` of the selected sheets."""
    chosen = select_sheet(sheet_rows).select("feed_id", "sheet_idx")
    return sheet_rows.join(chosen, ["feed_id", "sheet_idx"]).select("feed_id", "pos", "cells")
