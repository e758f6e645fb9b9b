"""Row-order helpers: first rows, blocks of positions, feed facts on rows."""

from pyspark.sql import DataFrame, Window as W, functions as F


def first_in_order(df: DataFrame, keys: list[str], pos: str, n: int) -> DataFrame:
    """First `n` rows of every key; Spark trims each partition to `n` before the shuffle."""
    w = W.partitionBy(*keys).orderBy(pos)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


#: Positions of a feed are cut into blocks of 2 to this power where nothing else is said.
BLOCK_BITS = 16


def with_block(rows: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Add `_block`, the block of positions that a row of a feed lies in, unless it is there."""
    return rows if "_block" in rows.columns else rows.withColumn("_block", F.shiftright("pos", bits))


def place(rows: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Rows shuffled by (feed, block), unless they lie so already (they have `_block`).

    Joins and windows on these two columns, and unions of tables placed so, need no further shuffle.
    """
    return rows if "_block" in rows.columns else with_block(rows, bits).repartition("feed_id", "_block")


def feed_blocks(rows: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(feed_id, _block): the blocks that hold rows, from pre-aggregated narrow columns."""
    return with_block(rows, bits).select("feed_id", "_block").distinct()


def join_feed(rows: DataFrame, feeds: DataFrame, blocks: DataFrame | None = None,
              bits: int = BLOCK_BITS) -> DataFrame:
    """`rows` with their feed's columns from `feeds` (one row per feed), and `_block`.

    The feed's row is copied for each of its blocks and joined by (feed, block), so that a feed with nearly all
    rows spreads over tasks. `blocks` may hold more blocks than the rows have.
    """
    rows = with_block(rows, bits)
    copies = (feed_blocks(rows) if blocks is None else blocks).join(feeds, "feed_id")
    return rows.join(copies, ["feed_id", "_block"])
