"""Product rows: from mapped feed rows to the 39 output columns.

Order is data here: a row without a title belongs to the last titled row above it, and repeated
handles are numbered in row order. A window over a whole feed would put a hot feed into one task,
so feeds are cut into blocks of positions (see `attach_active_product`).
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from merchframe.functions.text import col, first_text, slugify
from merchframe.functions.urls import absolute_image_url
from merchframe.functions.values import (
    norm_bool, norm_inventory_policy, norm_status, split_option_values,
)
from merchframe.operators.feeds import body_rows, feed_headers, normalize_feeds
from merchframe.operators.mapping import feed_constants, given_mapping, map_feeds, resolve_field_map
from merchframe.operators.ordered import BLOCK_BITS, feed_blocks, join_feed, place, with_block
from merchframe.schema import (
    BLANK_HANDLE, DEFAULTS, OPTION_NAME_DEFAULTS, PRODUCT_LEVEL, TARGET_COLUMNS,
)
from merchframe.session import settle

OPTIONS = (1, 2, 3)
_AT = {t: i for i, t in enumerate(TARGET_COLUMNS)}


# --- projection -------------------------------------------------------------------------

def target_slots(field_map) -> Column:
    """Column index per target column, NULL where unmapped."""
    return F.array(*[col(field_map)[t] for t in TARGET_COLUMNS])


def project_fields(rows: DataFrame, mapped: DataFrame,
                   constants: DataFrame | None = None, blocks: DataFrame | None = None,
                   bits: int = BLOCK_BITS) -> DataFrame:
    """(feed_id, _block, pos, vals, mapped): values of the 39 targets per source row.

    `mapped` and `constants` hold one row per feed. Constants replace the cell of their target.
    """
    feeds = resolve_field_map(mapped.select("feed_id", "targets")).select(
        "feed_id", target_slots("field_map").alias("slots"))
    # What holds for a whole feed is worked out on its one row, not on each of the feed's rows.
    is_set = F.transform("slots", lambda s: s.isNotNull()).alias("mapped")
    if constants is None:
        feeds = feeds.select("feed_id", "slots", is_set)
        vals = F.transform("slots", lambda s: F.coalesce(F.get("cells", s), F.lit("")))
    else:
        fixed = F.array(*[F.col("constants")[t] for t in TARGET_COLUMNS])
        feeds = feeds.join(constants, "feed_id", "left").select("feed_id", "slots", F.zip_with(
            "slots", fixed, lambda s, c: F.when(s.isNotNull(), c)).alias("fixed"), is_set)
        vals = F.zip_with("slots", "fixed", lambda s, c: F.coalesce(c, F.get("cells", s), F.lit("")))
    return join_feed(rows, feeds, blocks, bits).select(
        "feed_id", "_block", "pos", vals.alias("vals"), "mapped")


def value(target: str) -> Column:
    return F.get("vals", F.lit(_AT[target]))


def is_mapped(target: str) -> Column:
    return F.get("mapped", F.lit(_AT[target]))


def option_name(n: int) -> Column:
    """Name of option `n` on a row: its cell, else the default, blank when nothing is mapped."""
    known = is_mapped(f"Option{n} value") | is_mapped(f"Option{n} name")
    return F.when(known, first_text(value(f"Option{n} name"), F.lit(OPTION_NAME_DEFAULTS[n]))
                  ).otherwise("")


def handle_base() -> Column:
    mapped = value("URL handle")
    return first_text(slugify(F.when(mapped != "", mapped).otherwise(value("Title"))),
                      F.lit(BLANK_HANDLE))


def numbered_handle(base, use) -> Column:
    """The first use of a base keeps it; use n gets the suffix -n."""
    return F.when(col(use) > 1, F.concat(col(base), F.lit("-"), col(use).cast("string"))).otherwise(
        col(base))


# --- active product ---------------------------------------------------------------------

def attach_active_product(rows: DataFrame, bits: int = BLOCK_BITS, apart: bool = False) -> DataFrame:
    """Add `titled` and `active` struct(handle, names) to projected rows.

    Rows above a feed's first titled row are dropped. A feed is cut into blocks of `2 ** bits`
    positions. One pre-aggregated table holds, per block and handle base, how often the base was
    used and the block's last product; summed over the earlier blocks it tells each block where
    it starts. These start states enter the stream as extra rows at position -1. Rows placed by (feed,
    block) stay where they are, and no task sees more than one block of a hot feed. Rows that have
    `_block` keep it, whatever `bits`. `apart` writes that table before the stream begins, so that
    the shuffles of wide rows for the one and the other aren't on disk at a time.
    """
    titled = value("Title") != ""
    names = F.struct(*[option_name(n).alias(f"n{n}") for n in OPTIONS])
    rows = with_block(rows, bits).select(
        "*", titled.alias("titled"), F.when(titled, handle_base()).alias("_base"))

    uses = rows.groupBy("feed_id", "_block", "_base").agg(
        F.count(F.lit(1)).alias("_n"), F.max("pos").alias("_last"),
        F.max_by(names, "pos").alias("_names"))
    if apart:
        uses = settle(uses, "uses", lean=True)
    earlier_uses = W.partitionBy("feed_id", "_base").orderBy("_block").rowsBetween(
        W.unboundedPreceding, -1)
    uses = uses.withColumn("_before", F.coalesce(F.sum("_n").over(earlier_uses), F.lit(0)))
    start_uses = uses.where("_base is not null and _before > 0").select(
        "feed_id", "_block", "_base", F.col("_before").alias("_weight"))

    last_product = F.max_by(
        F.struct(numbered_handle("_base", F.col("_before") + F.col("_n")).alias("handle"),
                 F.col("_names").alias("names")),
        F.when(F.col("_base").isNotNull(), F.col("_last")))
    earlier_blocks = W.partitionBy("feed_id").orderBy("_block").rowsBetween(
        W.unboundedPreceding, -1)
    start_products = (
        uses.groupBy("feed_id", "_block").agg(last_product.alias("_tail"))
        .withColumn("_start", F.last("_tail", ignorenulls=True).over(earlier_blocks))
        .where("_start is not null").select("feed_id", "_block", "_start"))

    stream = (
        rows.withColumn("_weight", F.lit(1).cast("bigint"))
        .unionByName(start_uses.withColumn("pos", F.lit(-1).cast("bigint")).repartition("feed_id", "_block"),
                     allowMissingColumns=True)
        .unionByName(start_products.withColumn("pos", F.lit(-1).cast("bigint")).repartition("feed_id", "_block"),
                     allowMissingColumns=True))
    use = F.sum("_weight").over(
        W.partitionBy("feed_id", "_block", "_base").orderBy("pos")
        .rowsBetween(W.unboundedPreceding, 0))
    counted = stream.withColumn("_use", use)
    own = F.when(F.col("titled"), F.struct(
        numbered_handle("_base", "_use").alias("handle"), names.alias("names")))
    active = F.last(F.coalesce("_start", own), ignorenulls=True).over(
        W.partitionBy("feed_id", "_block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return (
        counted.withColumn("active", active)
        .where("titled is not null and active is not null")
        .drop("_base", "_block", "_weight", "_use", "_start"))


# --- variants ---------------------------------------------------------------------------

def expand_variants(rows: DataFrame) -> DataFrame:
    """One row per combination of option values, the last option fastest.

    Adds `variant_idx` and `o1`..`o3`. Rows without a title and unmapped options pass as they are.
    The three explodes stream, so no row holds its whole product of lists.
    """
    for n in OPTIONS:
        cell = value(f"Option{n} value")
        values = split_option_values(cell)
        split = F.when(F.col("titled") & (F.size(values) > 0), values).otherwise(
            F.array(F.when(F.col("titled"), "").otherwise(cell)))
        rows = rows.withColumn(f"_v{n}", split)
    out = rows
    for n in OPTIONS:
        out = out.select("*", F.posexplode(f"_v{n}").alias(f"_p{n}", f"o{n}"))
    idx = (F.col("_p1") * F.size("_v2") + F.col("_p2")) * F.size("_v3") + F.col("_p3")
    return out.withColumn("variant_idx", idx).drop(*[f"_{x}{n}" for n in OPTIONS for x in "vp"])


# --- output rows ------------------------------------------------------------------------

def _output_column(target: str) -> Column:
    is_first = F.col("titled") & (F.col("variant_idx") == 0)
    later = F.col("titled") & (F.col("variant_idx") > 0)
    cell = value(target)
    if target == "URL handle":
        return F.col("active.handle")
    if target == "Status":
        return F.when(later, DEFAULTS["Status"]).otherwise(norm_status(cell))
    if target == "Published on online store":
        return F.when(is_first, norm_bool(cell, DEFAULTS[target])).otherwise("")
    if target == "Product image URL":
        return F.when(is_first, absolute_image_url(cell)).otherwise("")
    if target == "Image position":
        image = absolute_image_url(value("Product image URL"))
        return F.when(is_first & (image != ""), "1").otherwise("")
    if target in PRODUCT_LEVEL:
        return F.when(is_first, cell).otherwise("")
    if target.startswith("Option"):
        n = int(target[len("Option")])
        if target.endswith("value"):
            return F.col(f"o{n}")
        filled = F.col(f"o{n}") != ""
        if target.endswith("name"):
            return F.when(filled, F.col(f"active.names.n{n}")).otherwise("")
        return F.when(filled & F.col("titled"), cell).otherwise("")
    if target == "Variant image URL":
        return absolute_image_url(cell)
    if target in ("Requires shipping", "Charge tax"):
        return norm_bool(cell, DEFAULTS[target])
    if target == "Continue selling when out of stock":
        return norm_inventory_policy(cell)
    if target in DEFAULTS:
        return first_text(cell, F.lit(DEFAULTS[target]))
    return cell


def output_rows(expanded: DataFrame) -> DataFrame:
    """(feed_id, pos, variant_idx, kind, 39 columns) in fixed column order."""
    kind = F.when(~F.col("titled"), "continuation").when(
        F.col("variant_idx") == 0, "first").otherwise("variant")
    return expanded.select(
        "feed_id", "pos", "variant_idx", kind.alias("kind"),
        *[_output_column(t).alias(t) for t in TARGET_COLUMNS])


def generate(rows: DataFrame, mapped: DataFrame, constants: DataFrame | None = None,
             bits: int = BLOCK_BITS, blocks: DataFrame | None = None, apart: bool = False) -> DataFrame:
    """Output rows of all feeds; a feed without a Title column has no titled row, so none.

    `apart` is for rows that are cheap to read twice (see `attach_active_product`).
    """
    projected = project_fields(place(rows, bits), mapped, constants, blocks, bits)
    return output_rows(expand_variants(attach_active_product(projected, bits, apart)))


def prepare_feeds(feed_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean body rows, mapped headers) of raw feeds, both written once for later passes."""
    mapped = settle(map_feeds(feed_headers(feed_rows)), "mapped")
    return settle(normalize_feeds(feed_rows, mapped), "rows"), mapped


def generate_feeds(feed_rows: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Raw feeds to output rows, with one constant status and published flag per feed.

    Raw rows are shuffled once, by (feed, block). Header, constants, slots and start states reach them there, and
    only narrow facts about feeds and blocks are written in between.
    """
    mapped = settle(map_feeds(feed_headers(feed_rows)), "mapped")
    blocks = settle(feed_blocks(feed_rows, bits), "blocks")
    rows = body_rows(place(feed_rows, bits), mapped, blocks)
    constants = settle(feed_constants(rows, mapped, blocks), "constants")
    return generate(rows, mapped, constants, bits, blocks)


def generate_given(feed_rows: DataFrame, mapping: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Raw feeds to output rows under a given mapping table (feed_id, col_idx, target_field, constant_value).

    Constants stand in every row of their target; Status and Published without one are read from the cells.
    """
    mapped = settle(given_mapping(mapping, feed_headers(feed_rows)), "mapped")
    blocks = settle(feed_blocks(feed_rows, bits), "blocks")
    rows = body_rows(place(feed_rows, bits), mapped, blocks)
    return generate(rows, mapped, mapped.select("feed_id", "constants"), bits, blocks)


def generation_totals(product_rows: DataFrame) -> DataFrame:
    """(feed_id, products, variants, rows) per feed."""
    return product_rows.groupBy("feed_id").agg(
        F.count_if(F.col("kind") == "first").alias("products"),
        F.count(F.lit(1)).alias("variants"),
        F.count(F.lit(1)).alias("rows"))
