"""URL columns: parts, joining, store and file names."""

from pyspark.sql import Column, functions as F

from merchframe.functions.text import (
    col, filename_slug, first_text, or_blank, strip, upload_filename_slug,
)
from merchframe.schema import TWO_PART_TLDS

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)"


def _part(c, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(col(c), pattern, group)


def netloc(c) -> Column:
    return _part(c, _AUTHORITY)


def path(c) -> Column:
    """Path without query, fragment or the last segment's parameters."""
    whole = _part(c, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)")
    return F.regexp_replace(whole, r";[^/]*$", "")


def is_valid_url(c) -> Column:
    text = strip(or_blank(c))
    return text.startswith("http://") | text.startswith("https://")


def _with_scheme(c) -> Column:
    text = strip(or_blank(c))
    return F.when(F.contains(text, F.lit("://")), text).otherwise(
        F.concat(F.lit("https://"), text))


def store_name_from_url(c) -> Column:
    host = F.lower(netloc(_with_scheme(c)))
    host = F.substring_index(F.substring_index(host, "@", -1), ":", 1)
    host = F.regexp_replace(host, r"^www\.", "")
    two_part = "(" + "|".join(t.replace(".", r"\.") for t in TWO_PART_TLDS) + ")$"
    name = F.when(host.rlike(two_part), F.regexp_replace(host, two_part, "")).otherwise(
        F.regexp_replace(host, r"\.[^.]{2,6}$", ""))
    return first_text(filename_slug(name), F.lit("store"))


def collection_handle_from_url(c) -> Column:
    segment = _part(path(_with_scheme(c)), r"(?i)/collections/([^/?#]+)")
    return first_text(filename_slug(segment), F.lit("products"))


def output_filename_from_url(c) -> Column:
    return F.concat(store_name_from_url(c), F.lit("_"), collection_handle_from_url(c),
                    F.lit("_products.csv"))


def basename(c) -> Column:
    return _part(c, r"([^/]+)/*$")


def stem(c) -> Column:
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]+$", "")


def suffix(c) -> Column:
    """Lower-case file suffix with its dot, or an empty string."""
    return F.lower(_part(basename(c), r".(\.[^.]+)$"))


def output_filename_from_upload(c) -> Column:
    return F.concat(first_text(upload_filename_slug(stem(c)), F.lit("upload")),
                    F.lit("_products.csv"))


def clean_domain(c) -> Column:
    domain = F.replace(first_text(netloc(c), path(c)), F.lit("www."), F.lit(""))
    return F.regexp_replace(domain, r"(?U)[^\w\-.]", "_")


def report_name(store_url, audit_date) -> Column:
    domain = F.replace(netloc(store_url), F.lit("www."), F.lit(""))
    day = F.coalesce(F.to_date(F.try_to_timestamp(col(audit_date))), F.current_date())
    return F.concat(F.lit("CRO_Audit_"), F.regexp_replace(domain, r"(?U)[^\w\-]", "_"),
                    F.lit("_"), F.date_format(day, "yyyy-MM-dd"), F.lit(".docx"))


def store_title(store_url) -> Column:
    """First label of the host with a capital first letter; "Store" without a host."""
    domain = F.replace(netloc(store_url), F.lit("www."), F.lit(""))
    label = F.substring_index(domain, ".", 1)
    # A word restarts after every character that isn't a letter.
    spaced = F.regexp_replace(label, r"(?U)([^\p{L}]+)", "$1 ")
    titled = F.replace(F.initcap(spaced), F.lit(" "), F.lit(""))
    return F.when(domain == "", "Store").otherwise(titled)


def parse_store_url(c) -> Column:
    """struct(base_url, collection, product, error); a product handle beats a collection."""
    text = strip(or_blank(c))
    host = netloc(text)
    product = strip(_part(path(text), r"(?i)/products/([^/?#]+)"))
    collection = strip(_part(path(text), r"(?i)/collections/([^/?#]+)"))
    error = F.when(~is_valid_url(text), "URL must start with http:// or https://").when(
        host == "", "Invalid URL.")
    good = error.isNull()
    return F.struct(
        F.when(good, F.rtrim(F.concat(_part(text, _SCHEME), F.lit("://"), host), F.lit("/")))
        .alias("base_url"),
        F.when(good & (product == ""), F.nullif(collection, F.lit(""))).alias("collection"),
        F.when(good, F.nullif(product, F.lit(""))).alias("product"),
        error.alias("error"),
    )


def is_uk_store(base_url) -> Column:
    return F.lower(netloc(base_url)).rlike(r"\.uk$|\.co\.uk")


def _drop_dots(p: Column) -> Column:
    """Resolve "." and ".." segments of a path that starts with a slash."""
    parts = F.split(F.substr(p, F.lit(2)), "/")
    last = F.element_at(parts, -1)
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(
            done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == ".", done).otherwise(F.concat(done, F.array(s))),
    )
    closing = F.when(last.isin(".", ".."), "/").otherwise("")
    joined = F.concat(F.lit("/"), F.array_join(folded, "/"), closing)
    return F.when(joined == "//", "/").otherwise(joined)


def join_url(base, href) -> Column:
    """Absolute URL of a link on a page."""
    base, href = col(base), col(href)
    scheme = _part(base, _SCHEME)
    root = F.concat(scheme, F.lit("://"), netloc(base))
    base_path = _part(base, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)")
    folder = first_text(F.regexp_replace(base_path, r"[^/]*$", ""), F.lit("/"))
    href_path = _part(href, r"^([^?#]*)")
    tail = _part(href, r"^[^?#]*(.*)$")
    query = _part(base, r"(\?[^#]*)")
    return (
        F.when(href.rlike(_SCHEME), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href == "", base)
        .when(href.startswith("#"), F.concat(root, base_path, query, href))
        .when(href.startswith("?"), F.concat(root, base_path, href))
        .when(href.startswith("/"), F.concat(root, _drop_dots(href_path), tail))
        .otherwise(F.concat(root, _drop_dots(F.concat(folder, href_path)), tail))
    )


def absolute_image_url(c) -> Column:
    text = strip(or_blank(c))
    return F.when(text.startswith("//"), F.concat(F.lit("https:"), text)).otherwise(text)
