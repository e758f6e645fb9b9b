"""Conversion signals of captured pages, one expression per signal.

Every function takes a parsed page (see functions.html) and stays JVM-side. Rendered positions come
as attributes that the capture wrote on the elements: data-y, data-width, data-height and
data-visible.
"""

from pyspark.sql import Column, DataFrame, functions as F

from merchframe.functions.html import (
    any_of, at, attr, body_text, class_has, class_is, first, has_attr, parse_html, select,
    sweep_inside, text_of,
)
from merchframe.functions.text import (
    col, contains_any, first_text, first_word_found, or_blank, strip,
)
from merchframe.functions.urls import join_url, path
from merchframe.schema import (
    DESKTOP_FOLD, EMAIL_VENDOR_WORDS, FAR_DOWN, MOBILE_FOLD, TAP_TARGET,
    TRUST_WORDS, URGENCY_WORDS,
)


def _tag(*names):
    return lambda n: n["tag"].isin(*names)


# --- static page ------------------------------------------------------------------------

def meta_title(page: Column) -> Column:
    return or_blank(text_of(page, first(page, _tag("title")), ""))


def meta_description(page: Column) -> Column:
    by_name = first(page, lambda n: (n["tag"] == "meta")
                    & (F.lower(attr(n, "name")) == "description"))
    by_property = first(page, lambda n: (n["tag"] == "meta")
                        & F.lower(attr(n, "property")).contains("og:description"))
    return strip(attr(F.coalesce(by_name, by_property), "content"))


def email_capture_static(page: Column, html: Column) -> Column:
    field = any_of(page, lambda n: (n["tag"] == "input") & (attr(n, "type") == "email"))
    return field | contains_any(F.lower(html), EMAIL_VENDOR_WORDS)


def trust_text(text: Column) -> Column:
    """First trust word, in list order, of a page's lower-case text; blank when none."""
    return or_blank(first_word_found(text, TRUST_WORDS))


def canonical_href(page: Column) -> Column:
    link = first(page, lambda n: (n["tag"] == "link")
                 & F.lower(attr(n, "rel")).contains("canonical"))
    return attr(link, "href")


def robots_meta(page: Column) -> Column:
    return attr(first(page, lambda n: (n["tag"] == "meta")
                      & (F.lower(attr(n, "name")) == "robots")), "content")


def product_links(page: Column, url: Column, limit: int | None = None) -> Column:
    """Distinct absolute product links, in page order; at most `limit`, if given."""
    anchors = select(page, lambda n: (n["tag"] == "a") & has_attr(n, "href"))
    links = F.transform(anchors, lambda n: F.substring_index(join_url(url, attr(n, "href")), "#", 1))
    wanted = F.filter(links, lambda u: path(u).contains("/products/"))
    links = F.array_distinct(wanted)
    return links if limit is None else F.slice(links, 1, limit)


# --- rendered homepage ------------------------------------------------------------------

def h1_text(page: Column) -> Column:
    return or_blank(text_of(page, first(page, _tag("h1"))))


def hero_cta_count(page: Column) -> Column:
    return sweep_inside(
        page, lambda n: class_has(n, "hero", "banner"),
        lambda n, zoned: (n["tag"] == "button") | class_is(n, "btn") | (
            (n["tag"] == "a") & (zoned | class_is(n, "button"))))["n"]


def nav_link_count(page: Column) -> Column:
    return sweep_inside(page, _tag("nav", "header"), lambda n, barred: (n["tag"] == "a") & barred)["n"]


def announcement_bar(page: Column) -> Column:
    return any_of(page, lambda n: class_has(n, "announcement", "promo-bar"))


def trust_badge_count(page: Column) -> Column:
    """Matches over all badge patterns; an element may count more than once."""
    def count(test):
        return F.size(select(page, test))

    return (count(lambda n: class_has(n, "trust")) + count(lambda n: class_has(n, "badge"))
            + count(lambda n: class_has(n, "review")) + count(lambda n: class_has(n, "rating"))
            + count(lambda n: class_is(n, "trustpilot")))


def email_input_count(page: Column) -> Column:
    return F.size(select(page, lambda n: (n["tag"] == "input")
                         & (F.lower(attr(n, "type")) == "email")))


def has_carousel(page: Column) -> Column:
    return any_of(page, lambda n: class_has(n, "carousel", "slider") | class_is(n, "swiper"))


def carousel_slide_count(page: Column) -> Column:
    return F.when(has_carousel(page), F.size(select(page, lambda n: class_has(n, "slide")))
                  ).otherwise(0)


def first_product_url(page: Column, url: Column, links: Column) -> Column:
    """First static product link, else the first link that mentions a product."""
    link = first(page, lambda n: (n["tag"] == "a") & attr(n, "href").contains("/products/"))
    return F.coalesce(F.get(links, F.lit(0)), F.when(
        link.isNotNull(), join_url(url, attr(link, "href"))))


# --- product page -----------------------------------------------------------------------

def _visible(n: Column) -> Column:
    return attr(n, "data-visible") != "false"


def _label(page: Column, n: Column) -> Column:
    return first_text(text_of(page, n), attr(n, "value"))


def desktop_atc(page: Column) -> Column:
    """Add-to-cart element by selector, else by its text; NULL when there is none."""
    by_selector = at(page, sweep_inside(
        page, lambda n: (n["tag"] == "form") & attr(n, "action").contains("/cart/add"),
        lambda n, formed: (((n["tag"] == "button") & (formed | (attr(n, "name") == "add") | class_has(n, "atc")))
                           | class_has(n, "add-to-cart") | class_is(n, "product-form__submit")))["first"])
    clickable = lambda n: n["tag"].isin("button", "a") | (
        (n["tag"] == "input") & (F.lower(attr(n, "type")) == "submit"))
    by_text = first(page, lambda n: clickable(n) & _visible(n) & _label(page, n).rlike(
        "(?i)add to cart|buy now|add to bag"))
    return F.coalesce(by_selector, by_text)


def mobile_atc(page: Column) -> Column:
    by_selector = first(page, lambda n: (
        ((n["tag"] == "button") & (attr(n, "name") == "add"))
        | class_has(n, "add-to-cart") | class_is(n, "product-form__submit")))
    by_text = first(page, lambda n: (n["tag"] == "button") & text_of(page, n).rlike(
        "(?i)add to cart|buy now"))
    return F.coalesce(by_selector, by_text)


def measured(node: Column, name: str) -> Column:
    return attr(node, f"data-{name}").try_cast("double")


def above_fold(node: Column, fold: int) -> Column:
    return F.coalesce(measured(node, "y") < fold, F.lit(False))


def tap_target_ok(node: Column) -> Column:
    return F.coalesce((measured(node, "width") >= TAP_TARGET)
                      & (measured(node, "height") >= TAP_TARGET), F.lit(False))


def product_image_count(page: Column) -> Column:
    images = select(page, lambda n: (n["tag"] == "img")
                    & (attr(n, "src").contains("cdn.shopify") | attr(n, "src").contains("shopify.com"))
                    & _visible(n) & F.coalesce(measured(n, "width") > 100, F.lit(False)))
    return F.size(F.array_distinct(F.transform(images, lambda n: attr(n, "src"))))


def price_element(page: Column) -> Column:
    return first(page, lambda n: class_has(n, "price") & ~class_has(n, "compare"))


def has_reviews(page: Column) -> Column:
    widget = any_of(page, lambda n: (
        class_is(n, "stamped-badge", "yotpo", "judge-me-widget", "spr-badge")
        | class_has(n, "review-count", "rating-count")
        | ((n["tag"] == "span") & class_has(n, "reviews")) | has_attr(n, "data-rating")))
    counter = first(page, lambda n: class_has(n, "review-count") | class_is(
        n, "stamped-badge-caption"))
    count = text_of(page, counter)
    none_yet = F.coalesce(count.contains("0") & (F.length(count) < 5), F.lit(False))
    return widget & ~none_yet


def visible_text(page: Column) -> Column:
    """Lower-case text of the page's body."""
    return F.lower(or_blank(text_of(page, first(page, _tag("body")))))


def has_urgency(text: Column) -> Column:
    return contains_any(text, URGENCY_WORDS)


def has_cross_sell(page: Column) -> Column:
    return any_of(page, lambda n: class_has(
        n, "related", "upsell", "cross-sell", "recommended", "complementary"))


def has_volume_pricing(page: Column) -> Column:
    return any_of(page, lambda n: class_has(n, "volume", "tier", "bulk"))


def has_sticky_atc(page: Column) -> Column:
    return any_of(page, lambda n: class_has(n, "sticky-add") | (
        class_has(n, "sticky") & class_has(n, "cart", "atc")))


def mobile_menu(page: Column) -> Column:
    return any_of(page, lambda n: (
        class_has(n, "hamburger", "menu-toggle", "nav-toggle")
        | ((n["tag"] == "button") & F.lower(attr(n, "aria-label")).contains("menu"))
        | ((n["tag"] == "summary") & class_is(n, "header__icon--menu"))))


# --- cart page --------------------------------------------------------------------------

def cart_checkout(page: Column) -> Column:
    return any_of(page, lambda n: (
        (attr(n, "name") == "checkout")
        | ((n["tag"] == "button") & (class_has(n, "checkout")
                                     | F.lower(text_of(page, n)).contains("checkout")))
        | ((n["tag"] == "a") & attr(n, "href").contains("/checkout"))))


def cart_trust(page: Column) -> Column:
    return any_of(page, lambda n: class_has(n, "trust", "secure", "guarantee"))


def cart_upsell(page: Column) -> Column:
    return any_of(page, lambda n: class_has(n, "upsell", "recommend", "cross"))


# --- signal tables ----------------------------------------------------------------------

def static_signals(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The static signals of homepages (url, html): one parse per page, no shuffle."""
    parsed = pages.withColumn("page", parse_html("html")).withColumn(
        "_text", F.lower(body_text(F.col("page"))))
    page = F.col("page")
    found = parsed.select(
        *keep,
        meta_title(page).alias("title"), meta_description(page).alias("description"),
        email_capture_static(page, F.col("html")).alias("has_email_capture_static"),
        trust_text(F.col("_text")).alias("trust_text_match"),
        canonical_href(page).alias("canonical_href"),
        robots_meta(page).alias("robots_meta"),
        product_links(page, F.col("url")).alias("product_urls_hint"))
    return found.select(
        *keep, (F.col("title") != "").alias("has_meta_title"),
        F.col("title").alias("meta_title"),
        (F.col("description") != "").alias("has_meta_description"),
        F.col("description").alias("meta_description"),
        "has_email_capture_static",
        (F.col("trust_text_match") != "").alias("has_trust_text"), "trust_text_match",
        (F.col("canonical_href") != "").alias("has_canonical"), "canonical_href",
        (F.col("robots_meta") != "").alias("has_robots_meta"), "robots_meta",
        "product_urls_hint")


def homepage_columns(page: Column, url: Column) -> list[Column]:
    h1 = first(page, _tag("h1"))
    return [
        h1.isNotNull().alias("has_h1"), h1_text(page).alias("h1_text"),
        (h1_text(page) != "").alias("h1_has_content"),
        hero_cta_count(page).alias("hero_cta_count"),
        nav_link_count(page).alias("nav_links_count"),
        (nav_link_count(page) > 3).alias("has_visible_nav"),
        announcement_bar(page).alias("has_announcement_bar"),
        trust_badge_count(page).alias("trust_badge_count"),
        email_input_count(page).alias("email_capture_count"),
        (email_input_count(page) > 0).alias("has_email_capture"),
        has_carousel(page).alias("has_carousel"),
        carousel_slide_count(page).alias("carousel_slide_count"),
        first_product_url(page, url, product_links(page, url)).alias("product_url"),
    ]


def product_columns(page: Column) -> list[Column]:
    atc, price = desktop_atc(page), price_element(page)
    return [
        F.coalesce(measured(atc, "y"), F.lit(FAR_DOWN)).alias("atc_y_position"),
        above_fold(atc, DESKTOP_FOLD).alias("atc_above_fold"),
        product_image_count(page).alias("product_image_count"),
        price.isNotNull().alias("price_visible"),
        or_blank(text_of(page, price)).alias("price_text"),
        has_reviews(page).alias("product_has_reviews"),
        has_urgency(visible_text(page)).alias("has_urgency"),
        has_cross_sell(page).alias("has_cross_sell"),
        has_volume_pricing(page).alias("has_volume_pricing"),
        has_sticky_atc(page).alias("has_sticky_atc"),
        mobile_atc(page).isNotNull().alias("cart_reachable"),
    ]


def mobile_home_columns(page: Column) -> list[Column]:
    return [mobile_menu(page).alias("mobile_has_hamburger")]


def mobile_product_columns(page: Column) -> list[Column]:
    atc = mobile_atc(page)
    return [above_fold(atc, MOBILE_FOLD).alias("mobile_atc_above_fold"),
            tap_target_ok(atc).alias("mobile_atc_tap_target_ok")]


def cart_columns(page: Column) -> list[Column]:
    return [cart_checkout(page).alias("cart_has_checkout_btn"),
            cart_trust(page).alias("cart_has_trust"), cart_upsell(page).alias("cart_has_upsell")]


RENDERED_DEFAULTS = {
    "has_h1": False, "h1_text": "", "h1_has_content": False, "hero_cta_count": 0,
    "nav_links_count": 0, "has_visible_nav": False, "has_announcement_bar": False,
    "trust_badge_count": 0, "email_capture_count": 0, "has_email_capture": False,
    "has_carousel": False, "carousel_slide_count": 0, "product_url": None,
    "atc_y_position": FAR_DOWN, "atc_above_fold": False, "product_image_count": 0,
    "price_visible": False, "price_text": "", "product_has_reviews": False,
    "has_urgency": False, "has_cross_sell": False, "has_volume_pricing": False,
    "has_sticky_atc": False, "mobile_has_hamburger": False, "mobile_atc_above_fold": False,
    "mobile_atc_tap_target_ok": False, "cart_has_checkout_btn": False, "cart_has_trust": False,
    "cart_has_upsell": False, "cart_flow_error": "",
}
STATIC_DEFAULTS = {
    "homepage_load_time": 999.0, "has_meta_title": False, "meta_title": "",
    "has_meta_description": False, "meta_description": "", "has_email_capture_static": False,
    "has_trust_text": False, "trust_text_match": "", "has_canonical": False,
    "canonical_href": "", "has_robots_meta": False, "robots_meta": "",
}


def rendered_signals(captures: DataFrame) -> DataFrame:
    """One row per store from captures (store_url, view, html, error).

    Views: home, product, mobile_home, mobile_product, cart. Each capture is parsed once and
    reduced to a few flags before the shuffle to its store.
    """
    parsed = captures.select("store_url", "view", "error", parse_html("html").alias("page"))
    page, view = F.col("page"), F.col("view")
    views = {
        "home": homepage_columns(page, F.col("store_url")),
        "product": product_columns(page),
        "mobile_home": mobile_home_columns(page),
        "mobile_product": mobile_product_columns(page),
        "cart": cart_columns(page),
    }
    per_view = parsed.select(
        "store_url", "view", "error",
        *[F.when(view == v, F.struct(*cols)).alias(v) for v, cols in views.items()])
    wide = per_view.groupBy("store_url").agg(
        *[F.first(v, ignorenulls=True).alias(v) for v in views],
        F.max(F.when(view == "cart", F.col("error"))).alias("_cart_error"))
    flow = F.when(F.col("product").isNull(), "").when(
        ~F.col("product.cart_reachable"), "ATC button not found for cart flow").otherwise(
        or_blank("_cart_error"))
    flat = wide.select("store_url", *[f"{v}.*" for v in views], flow.alias("cart_flow_error"))
    return flat.drop("cart_reachable")


def merge_signals(static: DataFrame, rendered: DataFrame) -> DataFrame:
    """One row of signals per store; a rendered value wins, gaps take the defaults."""
    both = static.join(rendered, "store_url", "full")
    filled = both.select("store_url", *[
        (F.coalesce(c, F.lit(d)) if d is not None else F.col(c)).alias(c)
        for c, d in {**STATIC_DEFAULTS, **RENDERED_DEFAULTS}.items() if c in both.columns])
    email = F.col("has_email_capture") | F.col("has_email_capture_static")
    return filled.withColumn("has_email_capture", email)
