"""Catalogue JSON: listing pages and product payloads to draft rows."""

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from merchframe.functions.text import col, first_text, or_blank, strip
from merchframe.functions.urls import absolute_image_url
from merchframe.functions.values import normalize_prices
from merchframe.schema import (
    DRAFT_COLUMNS, PLACEHOLDER_OPTION_NAME, PLACEHOLDER_OPTION_VALUES,
)
from merchframe.session import settle


# What Spark's reader of JSON text takes: nesting, characters of one string, bytes of a parsed value.
MAX_JSON_DEPTH, MAX_JSON_STRING, MAX_JSON_BYTES = 1_000, 20_000_000, 128 * 1024 * 1024


# --- JSON values ------------------------------------------------------------------------

def json_get(v, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(col(v), path, kind)


def json_kind(value: Column) -> Column:
    """Type name of a JSON value: NULL for a missing one, VOID for JSON null.

    Spark describes the whole value, so keep this away from whole documents.
    """
    return F.schema_of_variant(value)


def parse_json(text) -> Column:
    """Parsed JSON text, NULL if broken. Of repeated keys in an object the last one counts.

    Spark takes repeated keys by a setting of the session, which every reader of JSON text sets here, so that
    results don't depend on what ran before.
    """
    SparkSession.active().conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return F.try_parse_json(col(text))


def parse_object(body) -> Column:
    """Parsed JSON object; NULL for broken JSON, for other JSON values and for an object with text behind it.

    Spark's reader stops at the end of the first value, so what follows it must be told by the last character.
    """
    # Most bodies have no blanks around them; trimming reads the whole text.
    whole = col(body)
    text = strip(body)
    plain = whole.startswith("{") & whole.endswith("}")
    return F.when(plain | (text.startswith("{") & text.endswith("}")), parse_json(body))


def rejection(body, parsed: Column) -> Column:
    """Why a body gave no object: `empty`, `not an object`, `too deep`, `too large` or `invalid`; NULL if it gave one.

    Quotes that no backslash escapes cut a body into pieces, of which every second lies in a string. Brackets of the
    others give the depth, and the longest of the strings is compared with what Spark's reader takes. A body that is
    too deep or too large counts so also if it is broken too. Only rejected bodies are scanned.
    """
    text = strip(or_blank(body))
    pieces = F.split(F.regexp_replace(text, r'(?s)\\u[0-9a-fA-F]{4}|\\.', "x"), '"', -1)
    strings = F.filter(pieces, lambda s, i: i % 2 == 1)
    marks = F.regexp_replace(F.array_join(F.filter(pieces, lambda s, i: i % 2 == 0), ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state, mark):
        now = state["now"] + F.when(mark.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))
    depth = F.aggregate(F.split(marks, ""), start, step, lambda s: s["most"])
    return (F.when(parsed.isNotNull(), F.lit(None).cast("string"))
            .when(text == "", "empty")
            .when(~text.startswith("{"), "not an object")
            .when((F.length(marks) > MAX_JSON_DEPTH) & (depth > MAX_JSON_DEPTH), "too deep")
            .when((F.octet_length(text) > MAX_JSON_BYTES)
                  | F.exists(strings, lambda s: F.length(s) > MAX_JSON_STRING), "too large")
            .otherwise("invalid"))


def is_object(value: Column) -> Column:
    return F.coalesce(json_kind(value).startswith("OBJECT"), F.lit(False))


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def as_items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


#: Types of fractions that are whole; of more digits they are integers.
WHOLE_KINDS = [f"DECIMAL({digits},0)" for digits in range(19)]


def _printed(kind: Column, text: Column) -> Column:
    """A fraction that is whole keeps its ".0"."""
    return F.when(kind.isin(WHOLE_KINDS), F.concat(text, F.lit(".0"))).otherwise(text)


def _filled(kind: Column, text: Column) -> Column:
    empty = text.isNull() | ((kind == "BOOLEAN") & (text == "false")) | (
        kind.rlike("^(BIGINT|DECIMAL|DOUBLE)") & (text.try_cast("double") == 0))
    return strip(F.when((kind != "STRING") & empty, "").otherwise(or_blank(text)))


def scalar_text(value: Column) -> Column:
    return _printed(json_kind(value), as_text(value))


def filled_text(value: Column) -> Column:
    """Stripped text of a scalar; blank for missing, zero and false values."""
    return _filled(json_kind(value), scalar_text(value))


def with_scalars(df: DataFrame, values: dict[str, Column], filled: list[str]) -> DataFrame:
    """Add `<name>_kind` and `<name>_text` of some JSON values, and `<name>_filled` of those named in `filled`.

    Each value is described and printed once. Every one is a column of its own, so that a query which reads few of
    them computes few, and none is evaluated by a lambda.
    """
    out = df.withColumns({f"{n}_value": v for n, v in values.items()})
    out = out.withColumns({f"{n}_kind": json_kind(F.col(f"{n}_value")) for n in values}
                          | {f"{n}_raw": as_text(F.col(f"{n}_value")) for n in values})
    out = out.withColumns({f"{n}_text": _printed(F.col(f"{n}_kind"), F.col(f"{n}_raw")) for n in values})
    return out.withColumns({f"{n}_filled": _filled(F.col(f"{n}_kind"), F.col(f"{n}_text")) for n in filled}).drop(
        *[f"{n}_{part}" for n in values for part in ("value", "raw")])


# --- captures ---------------------------------------------------------------------------

def latest(captures: DataFrame, keys: list[str]) -> DataFrame:
    """The last capture of each key by `captured_at` (where there is such a column), ties by a hash of its content.

    A mergeable maximum: repeated captures are reduced before the shuffle, and a key with many of them is no
    large task. The result lies by the keys for a join that follows.
    """
    rest = [c for c in captures.columns if c not in keys]
    when = [F.col("captured_at")] if "captured_at" in rest else []
    order = F.struct(*when, F.xxhash64(*rest).alias("h"), F.xxhash64(F.lit(1), *rest).alias("h2"))
    return captures.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, "_last.*")


# --- listing pages ----------------------------------------------------------------------

def listing_handles(listing: DataFrame) -> DataFrame:
    """(store_url, collection, page, idx, handle): listed handles in order.

    Reading stops at a collection's first page without products. That page is one small row for
    each collection, found with partial minima; the bodies explode in place.
    """
    products = json_get(parse_json("body"), "$.products", "array<variant>")
    # Bodies are parsed once; from here on rows hold a place and a handle, and a page without products one row.
    listed = settle(listing.where("page >= 1").select(
        "store_url", "collection", "page", F.posexplode_outer(products).alias("idx", "p")).select(
        "store_url", "collection", "page", "idx", filled_text(json_get("p", "$.handle")).alias("handle")), "listed", lean=True)
    ends = listed.where("idx IS NULL").groupBy("store_url", "collection").agg(F.min("page").alias("_end"))
    return listed.where("handle <> ''").join(ends, ["store_url", "collection"], "left").where(
        "idx IS NOT NULL AND (_end IS NULL OR page < _end)").drop("_end")


def is_catalogue_response(status, content_type, body) -> Column:
    """A store's probe answer is a catalogue: an object with `products`, and not an error page."""
    parsed = parse_object(body)
    json_type = F.contains(F.lower(or_blank(content_type)), F.lit("json"))
    failed = (col(status) >= 400) & (~json_type | (col(status) == 404))
    return ~failed & F.coalesce(json_get(parsed, "$.products").isNotNull(), F.lit(False))


# --- product payloads -------------------------------------------------------------------

def parse_products(detail: DataFrame) -> DataFrame:
    """Add `product` (NULL where the body isn't a JSON object) and `reason` (why it is NULL) to captured payloads."""
    return detail.withColumn("product", parse_object("body")).withColumn(
        "reason", rejection("body", F.col("product")))


def single_html_string(text: Column, fragments: Column) -> Column:
    """Markup as one cell: fragments joined, line breaks to one blank, never split."""
    whole = F.coalesce(F.array_join(F.filter(fragments, lambda f: f.isNotNull()), ""), text, F.lit(""))
    return strip(F.regexp_replace(whole, "[\r\n]+", " "))


def join_tags(kind: Column, text: Column, items: Column) -> Column:
    listed = F.filter(F.transform(items, filled_text), lambda t: t != "")
    return F.when(kind == "STRING", text).otherwise(or_blank(F.array_join(listed, ", ")))


def option_names(items: Column) -> Column:
    """array of three names; strings or {name}, the placeholder name blanked."""
    def name(option):
        text = F.when(is_object(option), filled_text(json_get(option, "$.name"))).otherwise(
            strip(or_blank(as_text(option))))
        return F.when(F.lower(text) == PLACEHOLDER_OPTION_NAME, "").otherwise(text)
    blanks = F.array_repeat(F.lit(""), 3)
    found = F.transform(F.slice(items, 1, 3), name)
    return F.slice(F.coalesce(F.concat(found, blanks), blanks), 1, 3)


def _source(name: str) -> Column:
    """Link of an image given as a string or as an object with `src`."""
    kind = F.col(f"{name}_kind")
    return F.when(kind.startswith("OBJECT"), F.col(f"{name}_src_text")).when(kind != "VOID", F.col(f"{name}_text"))


def pick_image() -> Column:
    """Featured image, else the first of the images; with its protocol."""
    kind = F.col("featured_kind")
    featured = F.when(kind.startswith("OBJECT") | kind.startswith("STRING"), _source("featured"))
    return absolute_image_url(F.coalesce(F.when(featured != "", featured), _source("image"), F.lit("")))


def option_value(text: Column) -> Column:
    return F.when(F.lower(text).isin(PLACEHOLDER_OPTION_VALUES), "").otherwise(text)


def clamp_inventory(kind: Column, text: Column) -> Column:
    """Whole numbers floored at zero; other text stays, missing is blank."""
    # Fractions are cut, not rounded; text must be a whole number.
    digits = F.when(kind == "BOOLEAN", F.when(text == "true", "1").otherwise("0")).when(
        kind == "STRING", F.regexp_extract(strip(text), r"^([+-]?\d+(_\d+)*)$", 1)).otherwise(
        F.regexp_extract(text, r"^(-?\d+)", 1))
    whole = F.replace(digits, F.lit("_"), F.lit("")).try_cast("decimal(38,0)")
    floored = F.greatest(whole, F.lit(0).cast("decimal(38,0)")).cast("string")
    return F.coalesce(F.when(whole.isNotNull(), floored), text, F.lit(""))


def variant_image(own: Column, product_image: Column) -> Column:
    """A variant's own image wins over the product's."""
    kind, src = json_kind(own), as_text(json_get(own, "$.src"))
    return (F.when(kind == "STRING", absolute_image_url(as_text(own)))
            .when(kind.startswith("OBJECT") & (or_blank(src) != ""), absolute_image_url(src))
            .otherwise(product_image))


PRODUCT_NAMES = ("title", "handle", "vendor", "type", "product_type", "price", "compare_at_price", "body_html",
                 "description", "tags")
VARIANT_NAMES = ("sku", "barcode", "option1", "option2", "option3", "price", "compare_at_price",
                 "inventory_quantity", "featured_image")
_VARIANT_TYPE = "struct<" + ", ".join(f"{n}: variant" for n in VARIANT_NAMES) + ">"
# One pass over a payload reads every field there is a use for, instead of a search for each.
_PRODUCT_TYPE = "struct<" + ", ".join([*[f"{n}: variant" for n in PRODUCT_NAMES], "options: array<variant>",
                                       "featured_image: variant", "images: array<variant>",
                                       f"variants: array<{_VARIANT_TYPE}>"]) + ">"


def product_fields(products: DataFrame) -> DataFrame:
    """Parsed products with `product` as a struct of the fields that drafts have a use for.

    A list's entry that is no object is NULL there, as its fields are.
    """
    return products.withColumn("product", json_get("product", "$", _PRODUCT_TYPE))


def image_values() -> dict[str, Column]:
    """A product's featured image, its first image and their sources, as `pick_image` wants them described."""
    featured, image = F.col("product.featured_image"), F.get("product.images", F.lit(0))
    return {"featured": featured, "featured_src": json_get(featured, "$.src"),
            "image": image, "image_src": json_get(image, "$.src")}


def product_scalars(fields: DataFrame) -> DataFrame:
    """Add the product-level draft fields to products as a struct of fields."""
    filled = ["title", "handle", "vendor", "type", "product_type"]
    images = image_values()
    rows = with_scalars(fields.withColumnRenamed("handle", "_listed"), images, []).withColumns({
        "option_names": option_names(F.col("product.options")), "_image": pick_image()}).drop(
        *[f"{n}_{part}" for n in images for part in ("kind", "text")])
    rows = with_scalars(rows, {n: F.col(f"product.{n}") for n in PRODUCT_NAMES}, filled)
    has_body = F.coalesce(F.col("body_html_text") != "", F.lit(False))
    body = F.when(has_body, F.col("body_html_text")).otherwise(F.col("description_text"))
    source = F.when(has_body, F.col("product.body_html")).otherwise(F.col("product.description"))
    parts = F.transform(as_items(source), as_text)
    handle, listed, kind = F.col("handle_filled"), F.col("_listed"), F.col("type_filled")
    return rows.select("*", F.when(handle != "", handle).otherwise(or_blank(strip(listed))).alias("url_handle")).drop(
        "title", "handle", "description", "vendor", "type", "tags").withColumns({
            "title": F.col("title_filled"),
            "description": single_html_string(body, parts),
            "vendor": F.col("vendor_filled"),
            "type": F.when(kind != "", kind).otherwise(or_blank(F.col("product_type_filled"))),
            "tags": join_tags(F.col("tags_kind"), F.col("tags_text"), as_items(F.col("product.tags"))),
            "image": F.col("_image"),
        }).withColumnRenamed("_listed", "handle")


def explode_variants(products: DataFrame) -> DataFrame:
    """One row per variant with `variant_idx`; a product without variants gives one row, and `own` says which do."""
    listed = products.withColumn("_variants", F.col("product.variants")).drop("product")
    return listed.select("*", F.posexplode_outer("_variants").alias("_idx", "variant")).withColumns({
        "variant_idx": F.coalesce("_idx", F.lit(0)), "own": F.col("_idx").isNotNull()}).drop("_idx", "_variants")


def make_drafts(exploded: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep`, variant_idx and the 21 draft fields."""
    is_first = F.col("variant_idx") == 0
    values = {f"v_{n}": F.col(f"variant.{n}") for n in VARIANT_NAMES if n != "featured_image"}
    rows = with_scalars(exploded, values, [f"v_{n}" for n in ("sku", "barcode", "option1", "option2", "option3")])

    def priced(name):
        # Only a product without variants is priced itself.
        return F.when(F.col("own"), F.col(f"v_{name}")).otherwise(F.col(name))

    rows = rows.withColumns({f"_{name}_{part}": priced(f"{name}_{part}")
                             for name in ("price", "compare_at_price") for part in ("kind", "text")})
    # These stand in one step: its lambda lets Spark cut the code for all of them into small methods. Without one it
    # makes a single method of them, too large for the JVM to compile.
    rows = rows.withColumns({
        "money": normalize_prices("_price_kind", "_price_text", "_compare_at_price_kind", "_compare_at_price_text",
                                  "is_uk"),
        "image": F.when(is_first, variant_image(F.col("variant.featured_image"), F.col("image"))).otherwise(""),
        "options": F.transform(F.array(*[F.col(f"v_option{n}_filled") for n in (1, 2, 3)]), option_value),
        "inventory_quantity": clamp_inventory(F.col("v_inventory_quantity_kind"),
                                              F.col("v_inventory_quantity_text")),
    })

    def on_first(c):
        return F.when(is_first, c).otherwise("")

    fields = {
        "title": on_first(F.col("title")),
        "url_handle": F.col("url_handle"),
        "description": on_first(F.col("description")),
        "vendor": on_first(F.col("vendor")),
        "product_category": F.lit(""),
        "type": on_first(F.col("type")),
        "tags": on_first(F.col("tags")),
        "sku": F.col("v_sku_filled"),
        "barcode": on_first(F.col("v_barcode_filled")),
        "price": F.col("money.price"),
        "compare_at_price": F.col("money.compare_at_price"),
        "inventory_quantity": F.col("inventory_quantity"),
        "product_image_url": F.col("image"),
        "image_position": F.when(F.col("image") != "", "1").otherwise(""),
        "status": F.lit("Active"),
    }
    for n in (1, 2, 3):
        val = F.get("options", F.lit(n - 1))
        fields[f"option{n}_value"] = val
        fields[f"option{n}_name"] = on_first(
            F.when(val != "", F.get("option_names", F.lit(n - 1))).otherwise(""))
    return rows.select(*keep, "variant_idx", *[fields[k].alias(k) for k in DRAFT_COLUMNS])


def product_drafts(detail: DataFrame, keep: list[str]) -> DataFrame:
    """Draft rows of captured payloads (handle, body, is_uk, ...); broken bodies are left out."""
    good = parse_products(detail).where("product is not null").drop("body", "reason")
    return make_drafts(explode_variants(product_scalars(product_fields(good))), keep)


# --- crawl ------------------------------------------------------------------------------

def join_listing_detail(handles: DataFrame, detail: DataFrame) -> DataFrame:
    """Listed handles with their payload: adds product, variant_count, status, is_uk, `error` and `reason`, which
    tells a body that is too deep or too large from a broken one.

    Of several captures of a product the last one counts. The join key is (store, handle), so even one huge store
    spreads over all tasks; captures are reduced, parsed and joined in one place.
    """
    keys = ["store_url", "handle"]
    kept = [*keys, "status", "is_uk", "body"] + ["captured_at"] * ("captured_at" in detail.columns)
    payload = parse_products(latest(detail.select(*kept), keys)).select(
        *keys, "status", "is_uk", "product", "reason",
        F.greatest(F.coalesce(F.size(json_get("product", "$.variants", "array<variant>")), F.lit(1)), F.lit(1))
        .alias("variant_count"), F.lit(True).alias("_captured"))
    url = F.concat("store_url", F.lit("/products/"), "handle", F.lit(".js"))
    error = (
        F.when(F.col("_captured").isNull(), F.concat(F.lit("Request failed for "), url))
        .when(F.col("status") >= 400,
              F.concat(F.lit("HTTP "), F.col("status").cast("string"), F.lit(" for "), url))
        .when(F.col("product").isNull(),
              F.concat(F.lit("Invalid product.js for '"), "handle", F.lit("'"))))
    message = F.concat(F.lit("Failed product '"), "handle", F.lit("': "), error)
    # An error page is told by its status alone.
    return handles.join(payload, keys, "left").withColumn("error", message).withColumn(
        "reason", F.when(~F.coalesce(F.col("status") >= 400, F.lit(False)), F.col("reason"))).drop("_captured")


def crawl_drafts(joined: DataFrame) -> DataFrame:
    good = joined.where("error is null")
    return make_drafts(explode_variants(product_scalars(product_fields(good))),
                       ["store_url", "collection", "page", "idx"])


def crawl_errors(joined: DataFrame) -> DataFrame:
    """One row per failed product; kept as rows, since a store's list has no size bound."""
    return joined.where("error is not null").select(
        "store_url", "collection", "page", "idx", "handle", "error", "reason")


def crawl_summary(joined: DataFrame) -> DataFrame:
    """(store_url, row_count, error_count, failure) per store, all from one pre-aggregation."""
    rows = F.when(F.col("error").isNull(), F.col("variant_count"))
    counts = joined.groupBy("store_url").agg(
        F.coalesce(F.sum(rows), F.lit(0)).alias("row_count"),
        F.count("error").alias("error_count"))
    return counts.withColumn("failure", F.when(
        F.col("row_count") == 0,
        "No products found. Check the collection URL or try again.").otherwise(""))


#: Pages of a feed are taken together in blocks of 2 to this power: 64 pages of 250 products, some variants each, come
#: near the blocks of positions that other feeds have.
PAGE_BITS = 6


def drafts_to_feed(drafts: DataFrame) -> DataFrame:
    """Drafts as `feed_rows`-like rows (feed_id, pos, cells, _block), cells in draft column order.

    `pos` is the exact place in the feed, from 0, by page, place on the page and variant. It is made of two running
    ranks: the rows of earlier blocks of pages, from counts, and the place within the block. Rows lie by (feed, block)
    then, so that product rows need no further shuffle of them.
    """
    # A blank cell is shuffled as NULL, which takes no room in a row.
    rows = drafts.select(
        F.concat_ws("/collections/", "store_url", "collection").alias("feed_id"),
        F.shiftright("page", PAGE_BITS).cast("bigint").alias("_block"), "page", "idx", "variant_idx",
        *[F.nullif(c, F.lit("")).alias(c) for c in DRAFT_COLUMNS])
    counts = rows.groupBy("feed_id", "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("feed_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("feed_id", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    place = F.row_number().over(W.partitionBy("feed_id", "_block").orderBy("page", "idx", "variant_idx"))
    cells = F.array(*[or_blank(c) for c in DRAFT_COLUMNS])
    return rows.repartition("feed_id", "_block").withColumn("_place", place).join(starts, ["feed_id", "_block"]).select(
        "feed_id", (F.col("_start") + F.col("_place") - 1).alias("pos"), cells.alias("cells"), "_block")


def draft_headers(feed_rows: DataFrame) -> DataFrame:
    """(feed_id, headers) of draft feeds, for mapping."""
    headers = F.array(*[F.lit(h) for h in DRAFT_COLUMNS.values()])
    return feed_rows.select("feed_id").distinct().withColumn("headers", headers)
