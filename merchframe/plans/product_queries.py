"""Queries on product rows, listings and payloads."""

from pyspark.sql import functions as F

from merchframe import schema as S
from merchframe.functions import urls, values
from merchframe.functions.text import clean_value, slugify
from merchframe.functions.values import fixed2
from merchframe.operators import mapping, payloads, products
from merchframe.plans import inputs as I
from merchframe.plans.feed_queries import CONSTANT_SQL, QUOTED_NAME_SQL, _FEED_SQL, joined, quoted_feed_rows
from merchframe.plans.registry import register
from merchframe.plans.sql import generated, options, pick, slug, source, strip
from merchframe.session import settle, settle_parts, shared_folder, write_lean
from merchframe.sources.sinks import write_product_csv


def snake(target: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in target.lower()).strip("_").replace("__", "_")


def projected(spark, sf, continuation=True, bits=products.BLOCK_BITS):
    rows, mapped = products.prepare_feeds(I.supplier_feeds(spark, sf, continuation))
    return products.project_fields(products.place(rows, bits), mapped, bits=bits)


def product_rows(spark, sf, continuation=True):
    return products.generate_feeds(I.supplier_feeds(spark, sf, continuation))


def columns(*targets, continuation=True):
    """Product rows cut to some target columns."""
    def run(spark, sf):
        return product_rows(spark, sf, continuation).select(
            "feed_id", "pos", "variant_idx", *[F.col(f"`{t}`").alias(snake(t)) for t in targets])
    return run


GEN = f"WITH {generated(True)}"
ROW = "feed_id, pos, CAST(variant_idx AS INTEGER) AS variant_idx"
FIRST = "CASE WHEN is_first THEN {} ELSE '' END"
_CONST = f"({CONSTANT_SQL})"
# Expected text of every output column of the supplier feeds.
EXPECTED = {
    "Title": FIRST.format("title"),
    "URL handle": "handle",
    "Vendor": FIRST.format("vendor"),
    "Type": FIRST.format("kind"),
    "Published on online store": FIRST.format(f"CASE WHEN odd THEN {_CONST} ELSE 'TRUE' END"),
    "Status": f"CASE WHEN later OR odd THEN 'Active' ELSE {_CONST} END",
    "SKU": "sku",
    "Option1 name": "CASE WHEN o1 = '' THEN '' ELSE 'Size' END",
    "Option1 value": "o1",
    "Option2 name": "CASE WHEN o2 = '' THEN '' ELSE 'Color' END",
    "Option2 value": "o2",
    "Price": "price",
    "Charge tax": "'TRUE'",
    "Inventory tracker": "'shopify'",
    "Inventory quantity": "qty",
    "Continue selling when out of stock": "'DENY'",
    "Weight unit for display": "'g'",
    "Requires shipping": "'TRUE'",
    "Fulfillment service": "'manual'",
}


def columns_sql(*targets):
    return ", ".join(f"{EXPECTED.get(t, chr(39) * 2)} AS {snake(t)}" for t in targets)


def register_columns(name, *targets):
    register(name, columns(*targets), f"{GEN} SELECT {ROW}, {columns_sql(*targets)} FROM gen")


# --- generation -------------------------------------------------------------------------

def project_fields(spark, sf):
    return projected(spark, sf).select("feed_id", "pos", *[
        products.value(t).alias(snake(t)) for t in ("Title", "Vendor", "Option1 value", "Price", "Barcode")])


register("project_fields", project_fields, f"""WITH {source(True)}
SELECT feed_id, pos, title, vendor, sizes AS option1_value, price, '' AS barcode FROM src""")


def infer_option_names(spark, sf):
    return projected(spark, sf).select("feed_id", "pos", *[
        products.option_name(n).alias(f"option{n}_name") for n in (1, 2, 3)])


register("infer_option_names", infer_option_names, f"""WITH {source(True)}
SELECT feed_id, pos, 'Size' AS option1_name, 'Color' AS option2_name, '' AS option3_name FROM src""")


def carry_active_product(spark, sf):
    return products.attach_active_product(projected(spark, sf)).select(
        "feed_id", "pos", "titled", F.col("active.handle").alias("handle"))


register("carry_active_product", carry_active_product,
         f"{GEN} SELECT feed_id, pos, title <> '' AS titled, handle FROM sized")


def unique_handle(spark, sf):
    # Small blocks, so that numbering crosses block borders.
    rows = products.attach_active_product(projected(spark, sf, False, 6), bits=6)
    return rows.where("titled").select("feed_id", "pos", F.col("active.handle").alias("handle"))


register("unique_handle", unique_handle,
         f"WITH {generated(False)} SELECT feed_id, pos, handle FROM sized WHERE title <> ''")
register("split_option_values", lambda spark, sf: projected(spark, sf).select(
    "feed_id", "pos", joined(values.split_option_values(products.value("Option1 value"))).alias("sizes"),
    joined(values.split_option_values(products.value("Option2 value"))).alias("colours")), f"""
WITH {source(True)} SELECT feed_id, pos, array_to_string({options('sizes')}, '|') AS sizes,
  array_to_string({options('colours')}, '|') AS colours FROM src""")
register_columns("expand_variants", "Option1 value", "Option2 value", "SKU")
register_columns("first_row_fields", "Title", "Vendor", "Type", "Tags", "SEO title")
register_columns("carry_option_names", "Option1 name", "Option2 name", "Option3 name")
register_columns("variant_fields", "SKU", "Price", "Inventory quantity", "Option1 value", "Tax code")
register("continuation_rows", lambda spark, sf: product_rows(spark, sf).where("kind = 'continuation'").select(
    "feed_id", "pos", *[F.col(f"`{t}`").alias(snake(t)) for t in S.TARGET_COLUMNS]), f"""
{GEN} SELECT feed_id, pos, {columns_sql(*S.TARGET_COLUMNS)} FROM gen WHERE title = ''""")
register_columns("apply_defaults", *S.DEFAULTS)
register_columns("blank_unused_options", "Option1 name", "Option1 Linked To", "Option2 name",
                 "Option2 Linked To", "Option3 name", "Option3 Linked To")
register("order_output_columns", lambda spark, sf: product_rows(spark, sf).select(
    *[F.col(f"`{t}`").alias(snake(t)) for t in S.TARGET_COLUMNS]),
    f"{GEN} SELECT {columns_sql(*S.TARGET_COLUMNS)} FROM gen")
register("generation_totals", lambda spark, sf: products.generation_totals(product_rows(spark, sf)), f"""
{GEN} SELECT feed_id, count(*) FILTER (is_first) AS products, count(*) AS variants, count(*) AS rows
FROM gen GROUP BY feed_id""")


def image_rows(spark, sf):
    """A feed with image links in the shapes that suppliers send."""
    k = F.col("p_partkey")
    link = F.when(k % 3 == 0, F.concat(F.lit(" //cdn/"), "p_name", F.lit(".jpg "))).when(
        k % 3 == 1, F.concat(F.lit("https://cdn/"), "p_name", F.lit(".jpg"))).otherwise("")
    rows = I.table(spark, sf, "part").select(
        F.col("p_brand").alias("feed_id"), k.alias("pos"),
        F.array("p_name", clean_value(link), clean_value(link), F.when(k % 2 == 0, "S,M").otherwise("S")).alias("cells"))
    heads = rows.select("feed_id").distinct().withColumn("headers", I.strings(
        ["Name", "Image Src", "Variant image URL", "Size"]))
    return products.generate(rows, mapping.map_feeds(heads))


_IMG = """WITH p AS (SELECT p_brand AS feed_id, p_partkey AS pos, CASE p_partkey % 3
    WHEN 0 THEN 'https://cdn/' || p_name || '.jpg' WHEN 1 THEN 'https://cdn/' || p_name || '.jpg' ELSE '' END AS url,
    unnest(CASE WHEN p_partkey % 2 = 0 THEN [0, 1] ELSE [0] END) AS variant_idx FROM part)
SELECT feed_id, pos, CAST(variant_idx AS INTEGER) AS variant_idx,"""
register("absolute_image_url", lambda spark, sf: image_rows(spark, sf).select(
    "feed_id", "pos", "variant_idx", F.col("`Product image URL`").alias("product_image"),
    F.col("`Variant image URL`").alias("variant_image")), f"""{_IMG}
  CASE WHEN variant_idx = 0 THEN url ELSE '' END AS product_image, url AS variant_image FROM p""")
register("image_position", lambda spark, sf: image_rows(spark, sf).select(
    "feed_id", "pos", "variant_idx", F.col("`Image position`").alias("image_position")), f"""{_IMG}
  CASE WHEN variant_idx = 0 AND url <> '' THEN '1' ELSE '' END AS image_position FROM p""")

_FLAGS = ["Yes", " no ", "0", "ON", "unpublished", "", "maybe", "N"]
_STATES = ["draft", "ARCHIVED ", "active", "", "gone"]
_POLICIES = ["Continue", "deny", "TRUE", "do continue", ""]


def flag_cells(spark, sf):
    k = F.col("p_partkey")
    return I.table(spark, sf, "part").select(
        k.alias("k"), F.concat(I.pick(_FLAGS, k), F.lit("\t")).alias("flag"),
        I.pick(_STATES, k).alias("state"), I.pick(_POLICIES, k).alias("policy"))


register("norm_bool", lambda spark, sf: flag_cells(spark, sf).select(
    "k", values.norm_bool("flag").alias("yes"), values.norm_bool("flag", "FALSE").alias("no")), f"""
SELECT p_partkey AS k, {pick(['TRUE', 'FALSE', 'FALSE', 'TRUE', 'FALSE', 'TRUE', 'TRUE', 'FALSE'], 'p_partkey')} AS yes,
  {pick(['TRUE', 'FALSE', 'FALSE', 'TRUE', 'FALSE', 'FALSE', 'FALSE', 'FALSE'], 'p_partkey')} AS no FROM part""")
register("norm_status", lambda spark, sf: flag_cells(spark, sf).select("k", values.norm_status("state").alias("status")),
         f"SELECT p_partkey AS k, {pick(['Draft', 'Archived', 'Active', 'Active', 'Active'], 'p_partkey')} AS status FROM part")
register("norm_inventory_policy", lambda spark, sf: flag_cells(spark, sf).select(
    "k", values.norm_inventory_policy("policy").alias("policy")),
    f"SELECT p_partkey AS k, {pick(['CONTINUE', 'DENY', 'DENY', 'CONTINUE', 'DENY'], 'p_partkey')} AS policy FROM part")


def csv_round_trip(spark, sf):
    folder = shared_folder(spark, "products")
    write_product_csv(product_rows(spark, sf), folder)
    schema = ", ".join(f"`{t}` string" for t in S.TARGET_COLUMNS)
    back = spark.read.schema(schema).options(header=True, quote='"', escape='"').csv(folder)
    return back.select(*[F.coalesce(F.col(f"`{t}`"), F.lit("")).alias(snake(t)) for t in S.TARGET_COLUMNS])


register("write_product_csv", csv_round_trip,
         f"{GEN} SELECT {columns_sql(*S.TARGET_COLUMNS)} FROM gen")


def import_csv_files(spark, sf):
    """CSV files with line breaks in quotes all the way to one product CSV folder per feed, read back."""
    feed_rows = settle(quoted_feed_rows(spark, sf), "feed-rows")
    folder = shared_folder(spark, "products")
    write_product_csv(products.generate_feeds(feed_rows), folder, by_feed=True)
    schema = ", ".join(f"`{t}` string" for t in S.TARGET_COLUMNS)
    back = spark.read.schema(schema + ", feed_id string").options(
        header=True, quote='"', escape='"', multiLine=True).csv(folder)
    return back.select("feed_id", *[F.coalesce(F.col(f"`{t}`"), F.lit("")).alias(snake(t)) for t in (
        "Title", "URL handle", "Type", "Option1 name", "Option1 value", "Price", "Status")])


register("import_csv_files", import_csv_files, f"""
WITH r AS (SELECT {_FEED_SQL} AS feed_id, p_partkey, p_type, p_size, p_retailprice,
    rtrim({QUOTED_NAME_SQL}, chr(10)) AS title FROM part),
b AS (SELECT *, {slug('title')} AS base FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY feed_id, base ORDER BY p_partkey) AS use FROM b)
SELECT feed_id, title, base || CASE WHEN use > 1 THEN '-' || use ELSE '' END AS url_handle, p_type AS type,
  'Size' AS option1_name, CAST(p_size AS VARCHAR) AS option1_value, printf('%.2f', p_retailprice) AS price,
  'Active' AS status FROM n""")


def generate_given(spark, sf):
    rows = products.generate_given(I.supplier_feeds(spark, sf), I.given_mappings(spark, sf, S.SKIP_LABEL))
    return rows.select("feed_id", "pos", "variant_idx", *[F.col(f"`{t}`").alias(snake(t)) for t in (
        "Title", "URL handle", "Vendor", "Type", "Tags", "Price", "SKU", "Gift card", "Status")])


register("generate_given_mapping", generate_given, f"""WITH {source()},
b AS (SELECT *, coalesce(nullif({slug('title')}, ''), 'product') AS base FROM src WHERE title <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY feed_id, base ORDER BY pos) AS use FROM b)
SELECT feed_id, pos, CAST(0 AS INTEGER) AS variant_idx, title,
  base || CASE WHEN use > 1 THEN '-' || use ELSE '' END AS url_handle, CASE WHEN odd THEN 'House' ELSE vendor END AS vendor,
  kind AS type, colours AS tags, price, sku, CASE WHEN odd THEN 'FALSE' ELSE qty END AS gift_card, 'Active' AS status
FROM n""")

# --- listings ---------------------------------------------------------------------------

_NO = f"(o_orderkey // {I.ORDERS_PER_GROUP} * 4 + o_orderkey % 4)"
_URL = f"'https://shop' || {_NO} || CASE WHEN {_NO} % 2 = 0 THEN '.co.uk' ELSE '.com' END"
_LISTED = f"""o AS (SELECT *, {_NO} AS no, {_URL} AS store_url,
    CAST(o_orderkey % {I.ORDERS_PER_GROUP} // {I.PRODUCTS_PER_PAGE_SLOT} + 1 AS INTEGER) AS page FROM orders),
listed AS (SELECT *, CAST(row_number() OVER (PARTITION BY store_url, page ORDER BY o_orderkey) - 1 AS INTEGER) AS idx,
    'p-' || o_orderkey AS handle FROM o
  WHERE NOT (no % 3 = 0 AND page >= 150)),
handles AS (SELECT * FROM listed WHERE o_orderkey % 37 <> 0)"""
register("scan_listing_json", lambda spark, sf: payloads.listing_handles(I.listing_pages(spark, sf)), f"""
WITH {_LISTED} SELECT store_url, 'all' AS collection, page, idx, handle FROM handles""")
register("scan_product_json", lambda spark, sf: payloads.parse_products(I.product_payloads(spark, sf)).select(
    "store_url", "handle", F.col("product").isNotNull().alias("is_valid")), f"""
SELECT {_URL} AS store_url, 'p-' || o_orderkey AS handle, o_orderkey % 41 <> 0 AS is_valid
FROM orders""")
register("rejected_payloads", lambda spark, sf: payloads.parse_products(I.odd_payloads(spark, sf)).select(
    "handle", "reason"), f"""
SELECT 'p-' || o_orderkey AS handle, nullif({pick(['too deep', 'invalid', 'not an object', 'empty', '', 'invalid', ''], 'o_orderkey')}, '')
  AS reason FROM orders""")
register("validate_catalogue_payload", lambda spark, sf: I.probe_answers(spark, sf).select(
    "custkey", payloads.is_catalogue_response("status", "content_type", "body").alias("is_catalogue")), """
SELECT c_custkey AS custkey, c_custkey % 6 IN (0, 1, 5) AND NOT (
  c_custkey % 5 = 1 OR (c_custkey % 5 = 3 AND c_custkey % 3 = 1)) AS is_catalogue FROM customer""")


def crawl_urls(spark, sf):
    k = F.col("o_orderkey")
    rest = I.pick(["/collections/New_In?page=2", "/Collections/sale/products/Red-Ring#x", "/products/p;v=1",
                   "", "/about", "/collections/"], k)
    scheme = I.pick(["https://", " http://", "ftp://", "https://", "http://u@", "https://"], F.floor(k / 7))
    host = F.when(k % 50 == 0, "").otherwise(F.concat(F.lit("Shop"), (k % 9).cast("string"),
                                                     I.pick([".co.uk", ".uk:8080", ".com", ".co.ukx.net"], k)))
    return I.table(spark, sf, "orders").select(k.alias("k"), F.concat(scheme, host, rest).alias("url"))


_CRAWL = f"""u AS (SELECT o_orderkey AS k,
  {pick(['https://', 'http://', 'ftp://', 'https://', 'http://u@', 'https://'], 'o_orderkey // 7')} AS scheme,
  CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE 'Shop' || (o_orderkey % 9) || {pick(['.co.uk', '.uk:8080', '.com', '.co.ukx.net'], 'o_orderkey')} END AS host,
  nullif({pick(['New_In', '', '', '', '', ''], 'o_orderkey')}, '') AS coll,
  nullif({pick(['', 'Red-Ring', 'p', '', '', ''], 'o_orderkey')}, '') AS prod FROM orders),
v AS (SELECT *, CASE WHEN scheme = 'ftp://' THEN 'URL must start with http:// or https://'
  WHEN host = '' AND scheme <> 'http://u@' THEN 'Invalid URL.' END AS error FROM u)"""
register("parse_store_url", lambda spark, sf: crawl_urls(spark, sf).select(
    "k", urls.parse_store_url("url").alias("p")).select("k", "p.*"), f"""
WITH {_CRAWL} SELECT k, CASE WHEN error IS NULL THEN scheme || host END AS base_url,
  CASE WHEN error IS NULL THEN coll END AS collection, CASE WHEN error IS NULL THEN prod END AS product, error FROM v""")
register("is_uk_store", lambda spark, sf: crawl_urls(spark, sf).select(
    "k", urls.parse_store_url("url")["base_url"].alias("base_url")).where("base_url is not null").select(
    "k", urls.is_uk_store("base_url").alias("is_uk")), f"""
WITH {_CRAWL} SELECT k, host <> '' AND k % 4 IN (0, 3) AS is_uk FROM v WHERE error IS NULL""")

# --- payloads ---------------------------------------------------------------------------

def _joined_crawl(spark, sf):
    return payloads.join_listing_detail(
        payloads.listing_handles(I.listing_pages(spark, sf)), I.captured_payloads(spark, sf))


#: Payloads of about so many orders are shuffled at a time.
ORDERS_PER_JOB = 12_000_000


def _settled_drafts(spark, sf):
    """Drafts of all crawled stores as a table, from payloads that are joined by one job for each part of the handles.

    The jobs read the payloads from a table, which is emptied after the last of them.
    """
    jobs = I.table(spark, sf, "orders").count() // ORDERS_PER_JOB + 1
    part = F.pmod(F.xxhash64("store_url", "handle"), F.lit(jobs))
    listed = payloads.listing_handles(I.listing_pages(spark, sf))
    folder = shared_folder(spark, "payloads")
    captured = write_lean(I.captured_payloads(spark, sf).withColumn("_part", part), folder, by="_part")
    drafts = settle_parts((payloads.crawl_drafts(payloads.join_listing_detail(
        listed.where(part == n), captured.where(F.col("_part") == n))) for n in range(jobs)), "drafts")
    write_lean(spark.range(0), folder, mode="overwrite")
    return drafts


_ERR = """CASE WHEN o_orderkey % 47 = 0 THEN 'Request failed for ' || store_url || '/products/' || handle || '.js'
  WHEN o_orderkey % 43 = 0 THEN 'HTTP 404 for ' || store_url || '/products/' || handle || '.js'
  WHEN o_orderkey % 41 = 0 THEN 'Invalid product.js for ''' || handle || '''' END"""
_MADE = f"""{_LISTED}, j AS (SELECT *, {_ERR} AS why FROM handles),
l AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1
        AS INTEGER) AS vi, CAST(round(l_extendedprice * 100) AS BIGINT) AS m FROM lineitem),
d AS (SELECT j.*, l.*, coalesce(vi, 0) AS variant_idx, coalesce(vi, 0) = 0 AS is_first, no % 2 = 0 AS uk
      FROM j LEFT JOIN l ON l_orderkey = o_orderkey WHERE why IS NULL),
a AS (SELECT *,
    CASE WHEN m IS NULL THEN CAST(round(o_totalprice * 100) AS BIGINT) / 100.0::DOUBLE ELSE m / 100.0::DOUBLE END AS inc,
    CASE WHEN m IS NULL THEN NULL WHEN l_suppkey % 4 = 2 THEN (m * 11 // 10) / 100.0::DOUBLE
         WHEN l_suppkey % 4 = 3 THEN 0.0 END AS cmp FROM d),
drafts AS (SELECT store_url, page, idx, variant_idx, handle AS url_handle, is_first, o_orderkey, l_linenumber,
  o_orderpriority, o_orderstatus,
  CASE WHEN is_first THEN 'Order ' || o_orderkey || ' ' || o_orderpriority ELSE '' END AS title,
  CASE WHEN NOT is_first THEN '' WHEN o_orderkey % 3 = 0 THEN '<p>' || o_orderpriority || ', item</p>'
       WHEN o_orderkey % 3 = 1 THEN 'Line one' ELSE '<p>a,b</p>' END AS description,
  CASE WHEN is_first THEN o_orderstatus ELSE '' END AS vendor, '' AS product_category,
  CASE WHEN NOT is_first THEN '' WHEN o_orderkey % 2 = 0 THEN 'Even' ELSE 'Odd' END AS type,
  CASE WHEN NOT is_first THEN '' WHEN o_orderkey % 2 = 0 THEN 'a, b ' ELSE 'x, y' END AS tags,
  CASE WHEN m IS NULL THEN '' ELSE 'S-' || l_suppkey END AS sku,
  CASE WHEN m IS NULL OR NOT is_first OR l_partkey = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS barcode,
  CASE WHEN m IS NULL OR l_linenumber % 4 = 0 THEN '' ELSE l_returnflag END AS option1_value,
  CASE WHEN m IS NULL THEN '' ELSE l_linestatus END AS option2_value, '' AS option3_value, '' AS option3_name,
  CASE WHEN is_first AND option1_value <> '' THEN {pick(['Size', '', 'Flag'], 'o_orderkey')} ELSE '' END AS option1_name,
  CASE WHEN is_first AND option2_value <> '' THEN {pick(['Color', 'Mode', 'Mode'], 'o_orderkey')} ELSE '' END AS option2_name,
  CASE WHEN uk THEN printf('%.2f', inc / 1.2::DOUBLE) ELSE printf('%.2f', inc) END AS price,
  CASE WHEN uk THEN printf('%.2f', greatest(inc, coalesce(cmp, inc))) WHEN cmp IS NULL THEN ''
       ELSE printf('%.2f', cmp) END AS compare_at_price,
  CASE WHEN m IS NULL THEN '' WHEN l_linenumber % 5 = 0 THEN 'n/a'
       ELSE CAST(greatest(0, CAST(trunc(l_quantity) AS INTEGER) - 10) AS VARCHAR) END AS inventory_quantity,
  CASE WHEN NOT is_first THEN '' WHEN m IS NOT NULL AND l_linenumber % 2 = 0 THEN 'https://cdn/v' || l_linenumber || '.jpg'
       ELSE {pick(['https://cdn/f.jpg', 'https://cdn/s.jpg', 'https://cdn/i.jpg', 'https://cdn/l.jpg'], 'o_orderkey')} END
    AS product_image_url,
  CASE WHEN is_first THEN '1' ELSE '' END AS image_position, 'Active' AS status FROM a)"""

_DKEY = ["store_url", "page", "idx", "variant_idx"]


def register_drafts(name, *fields):
    def run(spark, sf):
        return payloads.crawl_drafts(_joined_crawl(spark, sf)).select(*_DKEY, *fields)
    register(name, run, f"WITH {_MADE} SELECT {', '.join(_DKEY)}, {', '.join(fields)} FROM drafts")


register("join_listing_detail", lambda spark, sf: _joined_crawl(spark, sf).select(
    "store_url", "page", "idx", "handle", "error"), f"""WITH {_LISTED}
SELECT store_url, page, idx, handle, 'Failed product ''' || handle || ''': ' || {_ERR} AS error FROM handles""")
register("crawl_errors", lambda spark, sf: payloads.crawl_errors(_joined_crawl(spark, sf)), f"""WITH {_LISTED}
SELECT store_url, 'all' AS collection, page, idx, handle, 'Failed product ''' || handle || ''': ' || {_ERR} AS error,
  CASE WHEN o_orderkey % 47 <> 0 AND o_orderkey % 43 <> 0 THEN 'invalid' END AS reason
FROM handles WHERE {_ERR} IS NOT NULL""")
register("crawl_summary", lambda spark, sf: payloads.crawl_summary(_joined_crawl(spark, sf)), f"""
WITH {_MADE}, c AS (SELECT store_url, count(*) AS row_count FROM drafts GROUP BY store_url),
e AS (SELECT store_url, count(why) AS error_count FROM j GROUP BY store_url)
SELECT store_url, coalesce(row_count, 0) AS row_count, error_count, CASE WHEN row_count IS NULL
  THEN 'No products found. Check the collection URL or try again.' ELSE '' END AS failure FROM e LEFT JOIN c USING (store_url)""")
register_drafts("draft_scalars", "title", "url_handle", "vendor", "type")
register_drafts("single_html_string", "description")
register_drafts("join_tags", "tags")
register_drafts("option_names", "option1_name", "option2_name", "option3_name")
register_drafts("explode_variants", "url_handle", "sku")
register_drafts("variant_options", "option1_value", "option2_value", "option3_value")
register_drafts("clamp_inventory", "inventory_quantity")
register_drafts("variant_image", "product_image_url")
register_drafts("first_variant_only", "title", "description", "barcode", "product_image_url", "image_position", "status")
register_drafts("normalize_prices", "price", "compare_at_price")


def pick_image(spark, sf):
    parsed = payloads.parse_products(I.product_payloads(spark, sf)).where("product is not null")
    rows = payloads.with_scalars(payloads.product_fields(parsed), payloads.image_values(), [])
    return rows.select("store_url", "handle", payloads.pick_image().alias("image"))


register("pick_image", pick_image, f"""
SELECT {_URL} AS store_url, 'p-' || o_orderkey AS handle,
  {pick(['https://cdn/f.jpg', 'https://cdn/s.jpg', 'https://cdn/i.jpg', 'https://cdn/l.jpg'], 'o_orderkey')} AS image
FROM orders WHERE o_orderkey % 41 <> 0""")


def to_major_units(spark, sf):
    value = payloads.json_get(payloads.parse_json("props"), "$.k")
    whole = values.to_major_units(payloads.json_kind(value), payloads.as_text(value))
    text = F.format_string("%.2f", "value")
    return I.table(spark, sf, "events").select(
        "event_id", fixed2(whole).alias("minor"),
        fixed2(values.to_major_units(F.lit("STRING"), F.concat(F.lit(" 1,"), text))).alias("dotted"),
        fixed2(values.to_major_units(F.lit("BOOLEAN"), F.lit("true"))).alias("flag"))


register("to_major_units", to_major_units, """
SELECT event_id, printf('%.2f', CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100) AS minor,
  printf('%.2f', CAST('1' || printf('%.2f', value) AS DOUBLE)) AS dotted, CAST(NULL AS VARCHAR) AS flag FROM events""")


def drafts_to_feed(spark, sf):
    feed = payloads.drafts_to_feed(payloads.crawl_drafts(_joined_crawl(spark, sf)))
    return feed.select("feed_id", "pos", joined("cells", "~").alias("cells"))


_CELLS = "[" + ", ".join(S.DRAFT_COLUMNS) + "]"
register("drafts_to_feed", drafts_to_feed, f"""WITH {_MADE}
SELECT store_url || '/collections/all' AS feed_id,
  row_number() OVER (PARTITION BY store_url ORDER BY page, idx, variant_idx) - 1 AS pos,
  array_to_string({_CELLS}, '~') AS cells FROM drafts""")


def crawl_products(spark, sf):
    """Crawled stores all the way to product rows.

    Each wide shuffle ends in a table, after which it leaves the disk: payloads, drafts, uses of handles.
    """
    feed = payloads.drafts_to_feed(_settled_drafts(spark, sf))
    mapped = settle(mapping.map_feeds(payloads.draft_headers(feed)), "mapped", lean=True)
    rows = products.generate(feed, mapped, apart=True)
    return rows.select("feed_id", "pos", *[F.col(f"`{t}`").alias(snake(t)) for t in (
        "Title", "URL handle", "Option1 name", "Option1 value", "Option2 name", "Price",
        "Inventory quantity", "Product image URL", "Status")])


register("crawl_products", crawl_products, f"""WITH {_MADE},
f AS (SELECT *, last_value(nullif(title, '') IGNORE NULLS) OVER w AS t,
  CASE WHEN option1_value = '' THEN '' ELSE first_value(CASE WHEN option1_name = '' THEN 'Size' ELSE option1_name END)
    OVER w END AS n1,
  CASE WHEN option2_value = '' THEN '' ELSE first_value(CASE WHEN option2_name = '' THEN 'Color' ELSE option2_name END)
    OVER w END AS n2 FROM drafts
  WINDOW w AS (PARTITION BY store_url, page, idx ORDER BY variant_idx))
SELECT store_url || '/collections/all' AS feed_id,
  row_number() OVER (PARTITION BY store_url ORDER BY page, idx, variant_idx) - 1 AS pos,
  title, url_handle, n1 AS option1_name, option1_value, n2 AS option2_name, price, inventory_quantity,
  product_image_url, status FROM f""")
