"""Product extraction from captured pages: linked data, Open Graph, then plain markup."""

from pyspark.sql import Column, DataFrame, functions as F

from merchframe.functions.html import (
    at, attr, class_has, first, first_in_containers, parse_html, select, text_of,
)
from merchframe.functions.jsonld import find_product, find_products
from merchframe.functions.text import clean_value, col, contains_any, first_text, or_blank, strip
from merchframe.operators.payloads import (
    as_items, filled_text, is_object, json_get, parse_json, scalar_text,
)
from merchframe.schema import SKIPPED_IMAGE_WORDS

FIELDS = ["Title", "Description", "Price", "SKU", "Product image URL", "Vendor"]


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the markup by `page`, the parsed elements; every page is parsed once."""
    return pages.withColumn("page", parse_html(html)).drop(html)


def _fields(**found: Column) -> Column:
    names = {"title": "Title", "description": "Description", "price": "Price", "sku": "SKU",
             "image": "Product image URL", "vendor": "Vendor"}
    return F.struct(*[found.get(k, F.lit("")).alias(v) for k, v in names.items()])


# --- linked data ------------------------------------------------------------------------

def jsonld_blocks(page: Column) -> Column:
    """Bodies of the page's linked-data scripts that hold valid JSON, in order."""
    bodies = F.transform(
        F.filter(page["nodes"], lambda n: (n["tag"] == "script") & n["script"].isNotNull()),
        lambda n: strip(n["script"]))
    return F.filter(bodies, lambda b: parse_json(b).isNotNull())


def _first_item(value: Column) -> Column:
    return F.coalesce(F.get(as_items(value), F.lit(0)), value)


def jsonld_project(product) -> Column:
    """struct of product fields from one linked-data product node (JSON text)."""
    node = parse_json(product)
    get = lambda name: json_get(node, f"$.{name}")
    brand, image, offer = get("brand"), _first_item(get("image")), _first_item(get("offers"))
    raw = lambda v: F.when(filled_text(v) == "", "").otherwise(scalar_text(v))
    priced = F.when(is_object(offer), first_text(
        raw(json_get(offer, "$.price")), raw(json_get(offer, "$.lowPrice"))))
    return _fields(
        title=raw(get("name")),
        description=raw(get("description")),
        sku=first_text(raw(get("sku")), raw(get("mpn"))),
        vendor=F.when(is_object(brand), raw(json_get(brand, "$.name"))).otherwise(raw(brand)),
        image=F.when(is_object(image), raw(json_get(image, "$.url"))).otherwise(raw(image)),
        price=or_blank(priced),
    )


def jsonld_products(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, block_idx, product): product node of every linked-data block that has one."""
    blocks = parsed.select(*keep, F.posexplode(jsonld_blocks(F.col("page"))).alias("block_idx", "b"))
    found = blocks.select(*keep, "block_idx", find_product("b").alias("product"))
    return found.where("product is not null")


def jsonld_fields(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, block_idx, found): fields of a page's first product node that has a name."""
    named = jsonld_products(parsed, keep).select(
        *keep, "block_idx", jsonld_project("product").alias("found"))
    return (
        named.where(F.col("found.Title") != "").groupBy(*keep)
        .agg(F.min("block_idx").alias("block_idx"), F.min_by("found", "block_idx").alias("found")))


# --- Open Graph -------------------------------------------------------------------------

def _meta(page: Column, name: str) -> Column:
    def is_meta(key):
        return lambda n: (n["tag"] == "meta") & (attr(n, key) == name)
    tag = F.coalesce(first(page, is_meta("property")), first(page, is_meta("name")))
    return strip(attr(tag, "content"))


def og_product(page: Column) -> Column:
    return _fields(
        title=_meta(page, "og:title"),
        description=_meta(page, "og:description"),
        image=_meta(page, "og:image"),
        price=_meta(page, "product:price:amount"),
        sku=_meta(page, "product:retailer_item_id"),
    )


# --- plain markup -----------------------------------------------------------------------

def h1_title(page: Column) -> Column:
    return or_blank(text_of(page, first(page, lambda n: n["tag"] == "h1")))


def html_price(page: Column) -> Column:
    """Number in the first element with a price class and a digit."""
    el = first(page, lambda n: F.lower(attr(n, "class")).contains("price")
               & text_of(page, n).rlike("[0-9]"))
    text = F.replace(text_of(page, el), F.lit(","), F.lit(""))
    return or_blank(F.regexp_extract(text, r"[\d,.]+", 0))


def html_description(page: Column) -> Column:
    """First long paragraph, searched container by container when the page has containers."""
    chosen = first_in_containers(
        page, lambda n: n["tag"].isin("main", "article") | class_has(n, "product"),
        lambda n: (n["tag"] == "p") & (F.length(text_of(page, n)) > 50))
    return or_blank(text_of(page, at(page, chosen)))


def html_image(page: Column) -> Column:
    sources = F.transform(select(page, lambda n: n["tag"] == "img"),
                          lambda n: first_text(attr(n, "src"), attr(n, "data-src")))
    usable = F.filter(sources, lambda s: (s != "") & ~s.startswith("data:")
                      & ~contains_any(F.lower(s), SKIPPED_IMAGE_WORDS))
    return or_blank(F.get(usable, F.lit(0)))


def html_product(page: Column) -> Column:
    return _fields(title=h1_title(page), price=html_price(page),
                   description=html_description(page), image=html_image(page))


# --- cascade ----------------------------------------------------------------------------

def extract_products(pages: DataFrame, key: str) -> DataFrame:
    """(key, strategy, product fields, error): the first strategy with a title wins.

    Linked data is folded per page inside the row, so a page is never shuffled.
    """
    parsed = parse_pages(pages.select(key, "html"))
    page = F.col("page")
    with_blocks = parsed.withColumn("_blocks", jsonld_blocks(page))
    found = with_blocks.withColumn("_nodes", find_products("_blocks")).select(
        key,
        F.get(F.filter(F.transform("_nodes", jsonld_project), lambda s: s["Title"] != ""),
              F.lit(0)).alias("ld"),
        og_product(page).alias("og"), html_product(page).alias("html"))
    strategies = [("JSON-LD", "ld"), ("Open Graph", "og"), ("Generic HTML", "html")]

    def pick(make):
        return F.coalesce(*[F.when(or_blank(f"{s}.Title") != "", make(label, s))
                            for label, s in strategies])
    chosen = found.select(key, pick(lambda label, s: F.lit(label)).alias("strategy"),
                          pick(lambda label, s: F.col(s)).alias("p"))
    return chosen.select(
        key, "strategy", *[clean_value(f"p.{n}").alias(n) for n in FIELDS],
        F.when(F.col("strategy").isNull(),
               "Could not extract product data. The page may not be a product listing "
               "or may block scrapers.").alias("error"))
