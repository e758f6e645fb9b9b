"""Queries on captured pages: product extraction and signals."""

from pyspark.sql import functions as F

from merchframe import schema as S
from merchframe.operators import pages, signals
from merchframe.plans import inputs as I
from merchframe.plans.feed_queries import joined
from merchframe.plans.registry import register
from merchframe.plans.sql import lit, pick

def page_col():
    return F.col("page")


# --- product extraction -----------------------------------------------------------------

def _parsed(spark, sf):
    return pages.parse_pages(I.all_product_pages(spark, sf))


def _snake(name):
    return name.lower().replace(" ", "_")


def _flat(fields):
    return [F.col(f"{fields}.`{n}`").alias(_snake(n)) for n in pages.FIELDS]


_PRICE = "printf('%.2f', p_retailprice)"
_K = "CAST(p_partkey AS VARCHAR)"
_P = "part_pages AS (SELECT *, 'part-' || p_partkey AS page_id, p_partkey % 4 AS how, (p_partkey // 4) % 6 AS shape FROM part)"
_LD = f"""'part-' || p_partkey AS page_id, p_name AS title, 'About, ' || p_type AS description, {_PRICE} AS price,
  'M' || p_partkey AS sku, '/i/' || p_partkey || '.jpg' AS product_image_url, p_brand AS vendor"""
_LONG = "'A paragraph of more than fifty characters about ' || p_name || ' & co.'"
# Titles of the crawled pages hold entities but no tags.
_TEXT = "replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
# A title may be cut within its last entity.
_H1 = "regexp_replace(trim(" + _TEXT.format("regexp_extract(html, '<h1>(.*?)</h1>', 1)") + "), '&amp$', '&')"

register("jsonld_blocks", lambda spark, sf: _parsed(spark, sf).select(
    "page_id", F.size(pages.jsonld_blocks(page_col())).alias("blocks")), """
SELECT 'part-' || p_partkey AS page_id, CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 0 END AS blocks FROM part
UNION ALL SELECT 'page-' || page_id, 0 FROM pages""")
register("jsonld_find_product", lambda spark, sf: pages.jsonld_products(_parsed(spark, sf), ["page_id"]).select(
    "page_id", "block_idx", F.get_json_object("product", "$.mpn").alias("mpn")), """
SELECT 'part-' || p_partkey AS page_id, 1 AS block_idx, 'M' || p_partkey AS mpn FROM part WHERE p_partkey % 4 = 0""")
register("jsonld_project", lambda spark, sf: pages.jsonld_fields(_parsed(spark, sf), ["page_id"]).select(
    "page_id", *_flat("found")), f"SELECT {_LD} FROM part WHERE p_partkey % 4 = 0")
register("og_product", lambda spark, sf: _parsed(spark, sf).select(
    "page_id", pages.og_product(page_col()).alias("og")).select("page_id", *_flat("og")), f"""
SELECT 'part-' || p_partkey AS page_id,
  CASE WHEN how THEN p_name ELSE '' END AS title, CASE WHEN how THEN 'D ' || p_type ELSE '' END AS description,
  CASE WHEN how THEN {_PRICE} ELSE '' END AS price, CASE WHEN how THEN 'R' || p_partkey ELSE '' END AS sku,
  CASE WHEN how THEN '/o/' || p_partkey || '.png' ELSE '' END AS product_image_url, '' AS vendor
FROM (SELECT *, p_partkey % 4 = 1 AS how FROM part)
UNION ALL SELECT 'page-' || page_id, '', '', '', '', '', '' FROM pages""")
register("html_title_h1", lambda spark, sf: _parsed(spark, sf).select(
    "page_id", pages.h1_title(page_col()).alias("title")), f"""
SELECT 'part-' || p_partkey AS page_id,
  CASE p_partkey % 4 WHEN 2 THEN p_name || ' x' WHEN 3 THEN '' ELSE 'Not this' END AS title FROM part
UNION ALL SELECT 'page-' || page_id, {_H1} FROM pages""")
register("html_price", lambda spark, sf: _parsed(spark, sf).select(
    "page_id", pages.html_price(page_col()).alias("price")), f"""
SELECT 'part-' || p_partkey AS page_id, CASE WHEN p_partkey % 4 = 2 THEN '1' || {_PRICE} ELSE '' END AS price FROM part
UNION ALL SELECT 'page-' || page_id, '' FROM pages""")
# Paragraphs of the crawled pages' articles; some paragraphs and articles are never closed.
_PARAGRAPHS = """list_transform(string_split(split_part(split_part(html, '<article>', 2), '</article>', 1), '<p>')[2:],
  lambda x: split_part(x, '</p>', 1))"""
_PLAIN = "trim(" + _TEXT.format("regexp_replace(x, '<[^>]*>', '', 'g')") + ")"
_PAGE_P = f"coalesce(list_filter(list_transform({_PARAGRAPHS}, lambda x: {_PLAIN}), lambda t: length(t) > 50)[1], '')"
register("html_description", lambda spark, sf: _parsed(spark, sf).select(
    "page_id", pages.html_description(page_col()).alias("description")), f"""
SELECT 'part-' || p_partkey AS page_id, CASE WHEN p_partkey % 4 = 2 THEN {_LONG} ELSE '' END AS description FROM part
UNION ALL SELECT 'page-' || page_id, {_PAGE_P} FROM pages""")
register("html_image", lambda spark, sf: _parsed(spark, sf).select(
    "page_id", pages.html_image(page_col()).alias("image")), """
SELECT 'part-' || p_partkey AS page_id,
  CASE WHEN p_partkey % 4 = 2 THEN '/p/' || p_partkey || '.webp' ELSE '' END AS image FROM part
UNION ALL SELECT 'page-' || page_id, '' FROM pages""")


def extract_cascade(spark, sf):
    return pages.extract_products(I.all_product_pages(spark, sf), "page_id").select(
        "page_id", "strategy", *[F.col(f"`{n}`").alias(_snake(n)) for n in pages.FIELDS], "error")


register("extract_cascade", extract_cascade, f"""
SELECT 'part-' || p_partkey AS page_id, {pick(['JSON-LD', 'Open Graph', 'Generic HTML', '-'], 'p_partkey')} AS s,
  nullif(s, '-') AS strategy,
  CASE h WHEN 3 THEN '' WHEN 2 THEN p_name || ' x' ELSE p_name END AS title,
  CASE h WHEN 0 THEN 'About, ' || p_type WHEN 1 THEN 'D ' || p_type WHEN 2 THEN {_LONG} ELSE '' END AS description,
  CASE h WHEN 3 THEN '' WHEN 2 THEN '1' || {_PRICE} ELSE {_PRICE} END AS price,
  CASE h WHEN 0 THEN 'M' || p_partkey WHEN 1 THEN 'R' || p_partkey ELSE '' END AS sku,
  CASE h WHEN 0 THEN '/i/' || p_partkey || '.jpg' WHEN 1 THEN '/o/' || p_partkey || '.png'
         WHEN 2 THEN '/p/' || p_partkey || '.webp' ELSE '' END AS product_image_url,
  CASE h WHEN 0 THEN p_brand ELSE '' END AS vendor,
  CASE h WHEN 3 THEN 'Could not extract product data. The page may not be a product listing or may block scrapers.' END
    AS error
FROM (SELECT *, p_partkey % 4 AS h FROM part)
UNION ALL SELECT 'page-' || page_id, '', 'Generic HTML', {_H1}, {_PAGE_P}, '', '', '', '', NULL FROM pages""".replace(
    "SELECT 'part-'", "SELECT * EXCLUDE (s) FROM (SELECT 'part-'", 1) + ")")

# --- static signals ---------------------------------------------------------------------


def _static(*fields):
    def run(spark, sf):
        homes = I.stores(spark, sf).select("store_url", "url", "html").unionByName(
            I.crawled_pages(spark, sf).select(F.col("page_id").alias("store_url"), "url", "html"))
        return signals.static_signals(homes, ["store_url"]).select("store_url", *fields)
    return run


_STORE = f"'https://www.store' || c_custkey || {pick(['.co.uk', '.com', '.shop'], 'c_custkey')}"
_BODY = "regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '<[^>]*>', ' ', 'g')"
_TITLE = _TEXT.format("regexp_extract(html, '<title>(.*?)</title>', 1)")


def register_static(name, fields, stores_sql, pages_sql):
    register(name, _static(*fields), f"""SELECT {_STORE} AS store_url, {stores_sql} FROM customer
UNION ALL SELECT 'page-' || page_id, {pages_sql} FROM pages""")


register_static("meta_title", ["has_meta_title", "meta_title"],
                "c_custkey % 3 = 0 AS has_meta_title, CASE WHEN c_custkey % 3 = 0 THEN 'Shopnumber ' || c_custkey ELSE '' END AS meta_title",
                f"{_TITLE} <> '', trim({_TITLE})")
register_static("meta_description", ["has_meta_description", "meta_description"], """
  c_custkey % 4 = 0 OR c_custkey % 6 = 0 AS has_meta_description,
  CASE WHEN c_custkey % 4 = 0 THEN 'All we sell' WHEN c_custkey % 6 = 0 THEN 'Shared text' ELSE '' END AS meta_description""",
                "false, ''")
_VENDORS = " OR ".join(f"contains(lower(html), {lit(w)})" for w in S.EMAIL_VENDOR_WORDS)
register_static("email_capture_static", ["has_email_capture_static"],
                "c_custkey % 6 = 0 OR c_custkey % 10 = 0 AS has_email_capture_static", f"({_VENDORS})")
_TRUST = " ".join(f"WHEN contains(lower({_BODY}), {lit(w)}) THEN {lit(w)}" for w in S.TRUST_WORDS)
register_static("trust_text", ["has_trust_text", "trust_text_match"],
                "c_custkey % 11 = 0 AS has_trust_text, CASE WHEN c_custkey % 11 = 0 THEN 'ssl' ELSE '' END AS trust_text_match",
                f"CASE {_TRUST} ELSE '' END <> '', CASE {_TRUST} ELSE '' END")
register_static("canonical_link", ["has_canonical", "canonical_href"],
                "c_custkey % 5 = 0 AS has_canonical, CASE WHEN c_custkey % 5 = 0 THEN '/home' ELSE '' END AS canonical_href",
                "false, ''")
register_static("robots_meta", ["has_robots_meta", "robots_meta"],
                "c_custkey % 7 = 0 AS has_robots_meta, CASE WHEN c_custkey % 7 = 0 THEN 'noindex' ELSE '' END AS robots_meta",
                "false, ''")


def product_links(spark, sf):
    return _static("product_urls_hint")(spark, sf).select(
        "store_url", joined("product_urls_hint", " ").alias("links"))


_LINKS = (f"CASE WHEN c_custkey % 2 = 0 THEN {_STORE} || '/products/one ' || {_STORE} || "
          "'/products/two?x=1 https://cdn.example/products/3' ELSE '' END")
register("product_links", product_links, f"""SELECT {_STORE} AS store_url, {_LINKS} AS links FROM customer
UNION ALL SELECT 'page-' || page_id, '' FROM pages""")

# --- rendered signals -------------------------------------------------------------------


def rendered(html, **found):
    """Signals of one derived view per customer."""
    def run(spark, sf):
        parsed = pages.parse_pages(I.view_pages(spark, sf, html()))
        return parsed.select("custkey", *[make(page_col()).alias(name) for name, make in found.items()])
    return run


def register_view(name, html, sql, **found):
    register(name, rendered(html, **found), f"SELECT c_custkey AS custkey, {sql} FROM customer")


def on(n, value="true", other="false"):
    return f"CASE WHEN c_custkey % {n} = 0 THEN {value} ELSE {other} END"


register("h1_signal", lambda spark, sf: pages.parse_pages(I.stores(spark, sf).select(
    "store_url", "html").unionByName(I.crawled_pages(spark, sf).select(
        F.col("page_id").alias("store_url"), "html"))).select(
    "store_url", signals.first(page_col(), lambda n: n["tag"] == "h1").isNotNull().alias("has_h1"),
    signals.h1_text(page_col()).alias("h1_text")), f"""
SELECT {_STORE} AS store_url, true AS has_h1, {on(3, "'Hello store'", "''")} AS h1_text FROM customer
UNION ALL SELECT 'page-' || page_id, contains(html, '<h1>'), {_H1} FROM pages""")
register("nav_link_count", lambda spark, sf: pages.parse_pages(I.stores(spark, sf).select(
    "store_url", "html").unionByName(I.crawled_pages(spark, sf).select(
        F.col("page_id").alias("store_url"), "html"))).select(
    "store_url", signals.nav_link_count(page_col()).alias("links"),
    (signals.nav_link_count(page_col()) > 3).alias("has_visible_nav")), f"""
SELECT {_STORE} AS store_url, {on(2, 4, 1)} AS links, c_custkey % 2 = 0 AS has_visible_nav FROM customer
UNION ALL SELECT 'page-' || page_id, n, n > 3 FROM (SELECT page_id,
  CAST(len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a ')) AS INTEGER) AS n FROM pages)""")
HOME, PRODUCT, MOBILE, CART = I.home_html, I.product_html, I.mobile_html, I.cart_html
register_view("hero_cta_count", HOME, f"{on(4, 2, 0)} AS n", n=signals.hero_cta_count)
register_view("announcement_bar", HOME, "c_custkey % 8 = 0 AS seen", seen=signals.announcement_bar)
register_view("trust_badge_count", HOME, f"{on(5, 4, 0)} AS n", n=signals.trust_badge_count)
register_view("email_input_count", HOME, f"{on(6, 2, 0)} AS n", n=signals.email_input_count)
register_view("carousel_signal", HOME, f"c_custkey % 9 = 0 AS seen, {on(9, 2, 0)} AS slides",
              seen=signals.has_carousel, slides=signals.carousel_slide_count)


def first_product_url(spark, sf):
    homes = pages.parse_pages(I.stores(spark, sf))
    links = homes.withColumn("links", signals.product_links(page_col(), F.col("url")))
    return links.select("store_url", signals.first_product_url(
        page_col(), F.col("url"), F.col("links")).alias("product_url"))


register("first_product_url", first_product_url, f"""SELECT {_STORE} AS store_url,
  CASE WHEN c_custkey % 2 = 0 THEN {_STORE} || '/products/one' END AS product_url FROM customer""")
register_view("atc_presence", PRODUCT, """c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0 AS desktop,
  c_custkey % 5 = 0 AS mobile""", desktop=lambda p: signals.desktop_atc(p).isNotNull(),
              mobile=lambda p: signals.mobile_atc(p).isNotNull())
# Desktop: form button first, then the named button, else the link by its text.
_Y = "CASE WHEN c_custkey % 2 = 0 THEN 640 WHEN c_custkey % 5 = 0 THEN 843 WHEN c_custkey % 3 = 0 THEN 900.5 END"
register_view("fold_and_tap", PRODUCT, f"""coalesce({_Y} < 800, false) AS desktop_fold, c_custkey % 5 = 0 AS mobile_fold,
  c_custkey % 2 = 0 AS desktop_tap, false AS mobile_tap""",
              desktop_fold=lambda p: signals.above_fold(signals.desktop_atc(p), S.DESKTOP_FOLD),
              mobile_fold=lambda p: signals.above_fold(signals.mobile_atc(p), S.MOBILE_FOLD),
              desktop_tap=lambda p: signals.tap_target_ok(signals.desktop_atc(p)),
              mobile_tap=lambda p: signals.tap_target_ok(signals.mobile_atc(p)))
register_view("product_image_count", PRODUCT, f"{on(4, 2, 0)} AS n", n=signals.product_image_count)
register_view("price_signal", PRODUCT, f"""c_custkey % 3 = 0 OR c_custkey % 9 = 0 AS visible,
  {on(3, "'7.50 GBP'", "''")} AS text""", visible=lambda p: signals.price_element(p).isNotNull(),
              text=lambda p: F.coalesce(signals.text_of(p, signals.price_element(p)), F.lit("")))
register_view("review_signal", PRODUCT, "c_custkey % 6 = 0 AND c_custkey % 12 <> 0 AS seen", seen=signals.has_reviews)
register_view("merch_blocks", PRODUCT, """c_custkey % 8 = 0 AS cross_sell, c_custkey % 9 = 0 AS volume,
  c_custkey % 10 = 0 AS sticky""", cross_sell=signals.has_cross_sell, volume=signals.has_volume_pricing,
              sticky=signals.has_sticky_atc)
register_view("mobile_menu", MOBILE, "c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0 AS seen",
              seen=signals.mobile_menu)
register_view("cart_signals", CART, """c_custkey % 2 = 0 OR c_custkey % 3 = 0 AS checkout, c_custkey % 4 = 0 AS trust,
  c_custkey % 5 = 0 AS upsell""", checkout=signals.cart_checkout, trust=signals.cart_trust,
              upsell=signals.cart_upsell)

_URGENT = " OR ".join(f"contains(lower({_BODY}), {lit(w)})" for w in S.URGENCY_WORDS)


def urgency_text(spark, sf):
    views = I.view_pages(spark, sf, PRODUCT()).select(
        F.concat(F.lit("store-"), F.col("custkey").cast("string")).alias("page_id"), "html")
    both = pages.parse_pages(views.unionByName(I.crawled_pages(spark, sf).select("page_id", "html")))
    text = both.withColumn("text", signals.visible_text(page_col()))
    return text.select("page_id", signals.has_urgency(F.col("text")).alias("urgent"))


register("urgency_text", urgency_text, f"""
SELECT 'store-' || c_custkey AS page_id, c_custkey % 7 = 0 AS urgent FROM customer
UNION ALL SELECT 'page-' || page_id, ({_URGENT}) FROM (SELECT page_id,
  regexp_replace(html, '(?s)<title>.*?</title>', '') AS html FROM pages)""")


def merge_signals(spark, sf):
    static = signals.static_signals(I.stores(spark, sf), ["store_url"]).withColumn(
        "homepage_load_time", F.lit(0.4))
    merged = signals.merge_signals(static, signals.rendered_signals(I.captures(spark, sf)))
    return merged.select(
        "store_url", "homepage_load_time", "has_meta_title", "has_canonical", "h1_text", "hero_cta_count",
        "nav_links_count", "has_visible_nav", "has_email_capture", "carousel_slide_count", "product_url",
        "atc_y_position", "atc_above_fold", "product_image_count", "price_visible", "mobile_has_hamburger",
        "mobile_atc_above_fold", "cart_has_checkout_btn", "cart_flow_error")


register("merge_signals", merge_signals, f"""
SELECT {_STORE} AS store_url, 0.4::DOUBLE AS homepage_load_time, c_custkey % 3 = 0 AS has_meta_title,
  c_custkey % 5 = 0 AS has_canonical, CASE WHEN r AND c_custkey % 3 = 0 THEN 'Hello store' ELSE '' END AS h1_text,
  CASE WHEN r AND c_custkey % 4 = 0 THEN 2 ELSE 0 END AS hero_cta_count,
  CASE WHEN NOT r THEN 0 WHEN c_custkey % 2 = 0 THEN 4 ELSE 1 END AS nav_links_count,
  r AND c_custkey % 2 = 0 AS has_visible_nav,
  c_custkey % 6 = 0 OR c_custkey % 10 = 0 AS has_email_capture,
  CASE WHEN r AND c_custkey % 9 = 0 THEN 2 ELSE 0 END AS carousel_slide_count,
  CASE WHEN r AND c_custkey % 2 = 0 THEN {_STORE} || '/products/one' END AS product_url,
  CAST(CASE WHEN r THEN coalesce({_Y}, 9999) ELSE 9999 END AS DOUBLE) AS atc_y_position,
  r AND coalesce({_Y} < 800, false) AS atc_above_fold,
  CASE WHEN r AND c_custkey % 4 = 0 THEN 2 ELSE 0 END AS product_image_count,
  r AND c_custkey % 3 = 0 AS price_visible,
  r AND (c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0) AS mobile_has_hamburger,
  r AND c_custkey % 5 = 0 AS mobile_atc_above_fold,
  r AND (c_custkey % 2 = 0 OR c_custkey % 3 = 0) AS cart_has_checkout_btn,
  CASE WHEN NOT r THEN '' WHEN c_custkey % 5 <> 0 THEN 'ATC button not found for cart flow'
       WHEN c_custkey % 13 = 0 THEN 'timeout' ELSE '' END AS cart_flow_error
FROM (SELECT *, c_custkey % 4 <> 3 AS r FROM customer)""")
