"""Inputs of the registered queries, derived by Spark from the driver tables.

Row counts follow the tables: `part` gives feeds and product pages, `orders` and `lineitem` give
listings and payloads, `customer` gives stores with captured pages and signals.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HEADERS_EVEN = ["Product Name", "Brand", "Product type", "Size", "Colour", "Price", "SKU", "Status",
                "Qty on hand", "Unnamed: 9", "Notes", "Notes"]
HEADERS_ODD = ["Title", "Manufacturer", "Category", "Pack Size", "Main color", "Retail Price",
               "Item SKU", "Published on online store", "Stock level", "unnamed: 9", "Notes", ""]
NUMBERS_ROW = ["1", "2.5", "1,000", "-3", "4e2", ".5", "7", "8", "9", "10", "11", "12"]
HEADER_WORDS = [
    "URL_Handle", "  product NAME ", "Description / Specification", "was price", "KG net",
    "EAN code", "Colour", "meta title", "Raw  Min  Price", "brand", "cost per unit", "Scent",
    "STOCK on hand", "SEO desc", "Body (HTML)", "status", "photo url", "Labels", "", "misc",
]
SHEET_NAMES = [
    ["Overview", "Raw Merged Stuff", "Products", "Notes"],
    ["Summary", "Old products", "My data", "Readme"],
    ["Overview", "Sheet1", "Sheet2", "Notes"],
    ["Overview", "Summary", "Notes", "Readme"],
    ["Template A", "Alpha", "Beta", "Gamma"],
]
FILE_SUFFIXES = [".csv", ".XLSX", ".xls", ".txt", "", ".Csv"]
PICTURE_SUFFIXES = [".jpg", ".JPEG", ".png", ".webp", ".bmp", ".tiff", ".tif", ".gif", ""]
FEED_CHUNK = 2000
PRODUCTS_PER_PAGE_SLOT = 20
ORDERS_PER_GROUP = 5000
#: Tasks for each core over which rows are spread that cost much each.
TASKS_PER_CORE = 4


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores, for work that costs much a row.

    A file is read by as many tasks as it has row groups: a narrow table of a million rows may be one of them. Call
    it on the table as read, before columns are made of its few.
    """
    return rows.repartition(TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def pick(values, n: Column) -> Column:
    """Element `n` modulo the list length."""
    return F.get(strings(values), (n % len(values)).cast("int"))


def _k() -> Column:
    return F.col("p_partkey")


def _brand_no() -> Column:
    return F.substring("p_brand", 7, 10).cast("int")


# --- supplier feeds ---------------------------------------------------------------------

def supplier_cells(continuation: bool) -> Column:
    k, odd = _k(), _brand_no() % 2 == 1
    title = F.when(k % 11 == 0, F.concat(F.lit("  "), "p_name", F.lit(" \t"))).otherwise(F.col("p_name"))
    if continuation:
        title = F.when(k % 4 == 0, title).otherwise("")
    size = F.when(k % 5 == 0, "nan").when(k % 7 == 0, "S; M ;L").otherwise(
        F.array_join(F.slice(strings(["S", "M", "L"]), 1, F.col("p_size") % 3 + 1), ","))
    colour = F.when(k % 9 == 0, "<b>x, y</b>").when(k % 2 == 0, "red;blue").otherwise("")
    flag = F.when(odd, pick(["no", "", "Yes "], k)).otherwise(pick(["draft", "", "ACTIVE "], k))
    cells = F.array(
        title, "p_brand", "p_type", size, colour, F.format_string("%.2f", "p_retailprice"),
        F.concat(F.lit("SKU-"), k.cast("string")), flag, F.col("p_size").cast("string"),
        F.lit("x"), F.lit("None"), F.when(k % 13 == 0, "fragile").otherwise(""))
    short = F.when((k % 6 == 0) & (k % 13 != 0), F.slice(cells, 1, 11)).otherwise(cells)
    return F.when(k % 97 == 0, strings([" "] + [""] * 11)).otherwise(short)


def _row(pos: Column, cells: Column) -> Column:
    return F.struct(pos.cast("bigint").alias("pos"), cells.alias("cells"))


def supplier_feeds(spark, sf, continuation: bool = False) -> DataFrame:
    """feed_rows of one feed per brand: junk row, odd feeds a row of numbers, header, parts."""
    part = table(spark, sf, "part")
    body = part.select(F.col("p_brand").alias("feed_id"), (_k() + 3).alias("pos"),
                       supplier_cells(continuation).alias("cells"))
    odd = _brand_no() % 2 == 1
    top = part.select("p_brand").distinct().select(F.col("p_brand").alias("feed_id"), F.inline(F.array(
        _row(F.lit(0), F.array(F.concat(F.lit("Supplier list of "), "p_brand"))),
        _row(F.when(odd, 2).otherwise(1),
             F.when(odd, strings(HEADERS_ODD)).otherwise(strings(HEADERS_EVEN))),
        _row(F.when(odd, 1), strings(NUMBERS_ROW)))))
    return body.unionByName(top.where("pos is not null"))


GIVEN_TARGETS = ["Title", "Vendor", "Type", "Title", "Tags", "Price", "SKU", "-- Skip this column --", "Gift card", "Vendor", ""]


def given_mappings(spark, sf, skip: str) -> DataFrame:
    """(feed_id, col_idx, target_field, constant_value): mappings by hand of the supplier feeds' columns.

    Two columns share a target, one is skipped and one blank; odd feeds give a constant vendor and gift card.
    """
    odd = _brand_no() % 2 == 1
    targets = F.array(*[F.lit(skip if t.startswith("--") else t) for t in GIVEN_TARGETS])
    rows = table(spark, sf, "part").select("p_brand").distinct().select(
        F.col("p_brand").alias("feed_id"), odd.alias("odd"), F.posexplode(targets).alias("col_idx", "target_field"))
    constant = F.when(F.col("odd") & (F.col("col_idx") == 1), "House").when(
        F.col("odd") & (F.col("col_idx") == 9), "Later").when(F.col("odd") & (F.col("col_idx") == 8), "FALSE")
    return rows.select("feed_id", "col_idx", "target_field", constant.alias("constant_value"))


def nation_feeds(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(feeds, feed_rows): one feed per nation and one per region; some hold no data."""
    nation, supplier = table(spark, sf, "nation"), table(spark, sf, "supplier")
    name = F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string"))
    feeds = nation.select(name.alias("feed_id")).unionByName(
        table(spark, sf, "region").select(F.concat(F.lit("region-"), "r_name").alias("feed_id")))
    head = nation.select(name.alias("feed_id"), F.lit(0).cast("bigint").alias("pos"),
                         strings(["Supplier", "Balance"]).alias("cells"))
    blank = F.col("s_nationkey") % 5 == 0
    body = supplier.select(
        F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("feed_id"),
        (F.col("s_suppkey") + 1).alias("pos"),
        F.when(blank, strings([" ", "NaN"])).otherwise(
            F.array("s_name", F.format_string("%.2f", "s_acctbal"))).alias("cells"))
    return feeds, head.unionByName(body)


def header_texts(spark, sf) -> DataFrame:
    """(header_id, header): client headers made of part names and known words."""
    k = _k()
    word = pick(HEADER_WORDS, k)
    mixed = F.when(k % 3 == 0, F.concat(F.col("p_name"), F.lit(" "), word)).otherwise(word)
    return table(spark, sf, "part").select(k.alias("header_id"), mixed.alias("header"))


def header_feeds(spark, sf) -> DataFrame:
    """(feed_id, headers): twelve neighbouring header texts per feed."""
    rows = header_texts(spark, sf).select(
        F.floor(F.col("header_id") / 12).alias("feed_id"),
        F.struct("header_id", "header").alias("h"))
    return rows.groupBy("feed_id").agg(F.transform(
        F.array_sort(F.collect_list("h")), lambda h: h["header"]).alias("headers"))


def workbooks(spark, sf) -> DataFrame:
    """sheet_rows: forty parts per workbook on four sheets; names cover every selection tier."""
    k = _k()
    book = F.floor(k / 40).cast("bigint")
    sheet_idx = (k % 4).cast("int")
    names = F.array(*[strings(n) for n in SHEET_NAMES])
    width = F.col("p_size") % 4 + 2
    filled = F.array_repeat(F.col("p_name"), width)
    blank = F.array_repeat(F.lit(" "), width)
    return table(spark, sf, "part").select(
        F.concat(F.lit("book-"), book.cast("string")).alias("feed_id"), sheet_idx.alias("sheet_idx"),
        F.get(F.get(names, (book % len(SHEET_NAMES)).cast("int")), sheet_idx).alias("sheet"),
        k.alias("pos"), F.when(F.col("p_size") % 5 == 0, blank).otherwise(filled).alias("cells"))


def file_paths(spark, sf, suffixes, folder: str) -> DataFrame:
    k = _k()
    return table(spark, sf, "part").select(F.concat(
        F.lit(f"/{folder}/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/"),
        F.replace("p_name", F.lit(" "), F.lit("_")), (k % 50).cast("string"),
        pick(suffixes, k)).alias("path"), k.alias("file_id"))


def csv_lines(spark, sf) -> DataFrame:
    """(feed, pos, line): parts as delimited text, quoted, ragged and with a title line."""
    k, no = _k(), _brand_no()
    feed = F.concat(F.lit("b"), no.cast("string"), F.lit("-"),
                    F.floor(k / FEED_CHUNK).cast("string"))
    sep = pick([",", "\t", "|", ";"], no)
    name = F.concat(F.lit('"'), "p_name", sep, F.lit(' ""x"""'))
    tail = F.when(k % 6 == 0, "").otherwise(F.concat(sep, F.lit("note"), k.cast("string")))
    line = F.concat(name, sep, "p_type", sep, F.format_string("%.2f", "p_retailprice"), sep,
                    F.col("p_size").cast("string"), tail)
    rows = table(spark, sf, "part").select(feed.alias("feed"), (k + 2).alias("pos"), sep.alias("sep"),
                                           line.alias("line"))
    top = rows.select("feed", "sep").distinct().select("feed", "sep", F.inline(F.array(
        _row(F.lit(0), F.lit("Price list")),
        _row(F.lit(1), F.concat_ws("\x01", *map(F.lit, ["Name", "Type", "Price", "Size", "Note"]))))))
    top = top.select("feed", "sep", "pos", F.replace("cells", F.lit("\x01"), F.col("sep")).alias("line"))
    return rows.unionByName(top).drop("sep")


def write_csv_files(spark, sf, folder: str) -> str:
    """One CSV file per feed of at most FEED_CHUNK parts."""
    lines = csv_lines(spark, sf).repartition("feed").sortWithinPartitions("feed", "pos")
    lines.select("feed", "line").write.partitionBy("feed").text(folder)
    return folder


def write_quoted_csv_files(spark, sf, folder: str) -> str:
    """CSV files like those of `write_csv_files`, with separators, quotes and line breaks in quoted names."""
    k, no = _k(), _brand_no()
    feed = F.concat(F.lit("b"), no.cast("string"), F.lit("-"), F.floor(k / FEED_CHUNK).cast("string"))
    sep = pick([",", "\t", "|", ";"], no)
    name = F.when(k % 7 == 0, F.concat(F.lit('"'), "p_name", sep, F.lit(' ""x""\nsecond, line\n"'))).otherwise(F.col("p_name"))
    line = F.concat_ws("\x01", name, "p_type", F.format_string("%.2f", "p_retailprice"), F.col("p_size").cast("string"),
                       F.when(k % 3 == 0, '5" wide').otherwise(""))
    rows = table(spark, sf, "part").select(feed.alias("feed"), (k + 2).alias("pos"), sep.alias("sep"), line.alias("line"))
    top = rows.select("feed", "sep").distinct().select("feed", "sep", F.inline(F.array(
        _row(F.lit(0), F.lit("Price list")),
        _row(F.lit(1), F.concat_ws("\x01", *map(F.lit, ["Name", "Type", "Price", "Size", "Note"]))))))
    every_line = rows.unionByName(top.withColumnRenamed("cells", "line")).select(
        "feed", "pos", F.replace("line", F.lit("\x01"), F.col("sep")).alias("line"))
    every_line.repartition("feed").sortWithinPartitions("feed", "pos").select("feed", "line").write.partitionBy(
        "feed").text(folder)
    return folder


# --- listings and payloads --------------------------------------------------------------

def _order_store() -> tuple[Column, Column]:
    """(store number, store url) of an order; every other store is British."""
    o = F.col("o_orderkey")
    no = F.floor(o / ORDERS_PER_GROUP) * 4 + o % 4
    return no, F.concat(F.lit("https://shop"), no.cast("string"),
                        F.when(no % 2 == 0, ".co.uk").otherwise(".com"))


def listing_pages(spark, sf) -> DataFrame:
    """(store_url, collection, page, body): listing JSON with blank handles and an empty page."""
    o = F.col("o_orderkey")
    no, url = _order_store()
    page = (F.floor(o % ORDERS_PER_GROUP / PRODUCTS_PER_PAGE_SLOT) + 1).cast("int")
    handle = F.when(o % 37 == 0, "  ").otherwise(F.concat(F.lit(" p-"), o.cast("string")))
    rows = table(spark, sf, "orders").select(
        url.alias("store_url"), page.alias("page"), o.alias("o"),
        ((no % 3 == 0) & (page == 150)).alias("cut"), handle.alias("handle"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o", "handle"))),
                         lambda x: F.struct(x["handle"].alias("handle")))
    return rows.groupBy("store_url", "page", "cut").agg(listed.alias("products")).select(
        "store_url", F.lit("all").alias("collection"), "page",
        F.when(F.col("cut"), '{"products": []}').otherwise(
            F.to_json(F.struct("products"))).alias("body"))


def _json(**fields) -> Column:
    """JSON object text of already encoded values; NULL fields are left out."""
    pairs = [F.concat(F.lit(f'"{k}": '), v) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))


def _quoted(c) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def minor_units() -> Column:
    return F.round(F.col("l_extendedprice") * 100).cast("bigint")


def _variant_json() -> Column:
    m, ln = minor_units(), F.col("l_linenumber")
    major = F.concat(F.floor(m / 100).cast("string"), F.lit("."),
                     F.lpad((m % 100).cast("string"), 2, "0"))
    price = F.when(F.col("l_partkey") % 3 == 0, m.cast("string")).when(
        F.col("l_partkey") % 3 == 1, _quoted(major)).otherwise(_quoted(m.cast("string")))
    compare = F.when(F.col("l_suppkey") % 4 == 0, "null").when(F.col("l_suppkey") % 4 == 1, "0").when(
        F.col("l_suppkey") % 4 == 2, F.floor(m * 11 / 10).cast("string")).otherwise('"0.00"')
    return _json(
        sku=_quoted(F.concat(F.lit(" S-"), F.col("l_suppkey").cast("string"))),
        barcode=F.concat(F.col("l_partkey").cast("string")),
        option1=_quoted(F.when(ln % 4 == 0, "Default Title").otherwise(F.col("l_returnflag"))),
        option2=_quoted(F.col("l_linestatus")),
        price=price, compare_at_price=compare,
        inventory_quantity=F.when(ln % 5 == 0, '"n/a"').otherwise(
            (F.col("l_quantity").cast("int") - 10).cast("string")),
        featured_image=F.when(ln % 2 == 0, F.concat(
            F.lit('{"src": "//cdn/v'), ln.cast("string"), F.lit('.jpg"}'))))


def product_payloads(spark, sf) -> DataFrame:
    """(store_url, handle, status, is_uk, body): one payload per order, lineitems as variants.

    Types vary as they do in the wild. Some bodies are broken and some answers are errors.
    """
    o = F.col("o_orderkey")
    no, url = _order_store()
    # Lines are shuffled as they are read; their JSON, which is longer, is made at the order's place.
    line = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag",
        "l_linestatus").repartition("l_orderkey").select(
        "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", _variant_json().alias("j"))
        .alias("v"))
    variants = line.groupBy("l_orderkey").agg(
        F.array_join(F.sort_array(F.collect_list("v"))["j"], ", ").alias("variants"))
    body = _json(
        title=_quoted(F.concat(F.lit(" Order "), o.cast("string"), F.lit(" "), "o_orderpriority")),
        handle=_quoted(F.when(o % 5 == 0, "").otherwise(F.concat(F.lit("p-"), o.cast("string")))),
        body_html=F.when(o % 3 == 0, _quoted(F.concat(
            F.lit("<p>"), "o_orderpriority", F.lit(",\\r\\n\\r\\nitem</p>")))).when(
            o % 3 == 2, '["<p>a,", null, "b</p>"]'),
        description=F.lit('"Line\\none "'),
        vendor=_quoted(F.col("o_orderstatus")),
        type=F.when(o % 2 == 0, '"Even"').otherwise('""'),
        product_type=F.lit('"Odd"'),
        tags=F.when(o % 2 == 0, '"a, b "').otherwise('["x", "", 0, "y"]'),
        options=pick(['["Size", "Color"]', '[{"name": "Title"}, {"name": "Mode"}]',
                      '[{"name": "Flag"}, {"name": "Mode"}, "Third", "Fourth"]'], o),
        featured_image=F.when(o % 4 == 0, '"//cdn/f.jpg"').when(o % 4 == 1, '{"src": "//cdn/s.jpg"}'),
        images=F.when(o % 4 == 2, '[{"src": "https://cdn/i.jpg"}]').when(
            o % 4 == 3, '["//cdn/l.jpg", "//cdn/m.jpg"]'),
        price=F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string"),
        variants=F.concat(F.lit("["), F.coalesce("variants", F.lit("")), F.lit("]")))
    joined = table(spark, sf, "orders").join(
        variants, F.col("l_orderkey") == o, "left")
    return joined.select(
        url.alias("store_url"), F.concat(F.lit("p-"), o.cast("string")).alias("handle"),
        F.when(o % 43 == 0, 404).otherwise(200).alias("status"), (no % 2 == 0).alias("is_uk"),
        F.when(o % 41 == 0, '{"title": ').otherwise(body).alias("body"))


def captured_payloads(spark, sf) -> DataFrame:
    """Payloads as a crawl landed them, with `captured_at`: some handles have none, some an older capture too."""
    key = F.substring("handle", 3, 20).cast("bigint")
    rows = product_payloads(spark, sf).where(key % 47 != 0)
    old = F.struct(F.lit("2024-01-01").alias("captured_at"), F.lit(200).alias("status"), F.lit('{"title": "Old"}').alias("body"))
    new = F.struct(F.lit("2024-02-01").alias("captured_at"), "status", "body")
    return rows.select("store_url", "handle", "is_uk", F.inline(
        F.when(key % 10 == 0, F.array(new, old, new)).otherwise(F.array(new))))


def odd_payloads(spark, sf) -> DataFrame:
    """(handle, body) of every order: nested too deep, cut off, a list, blank, brackets within a string, such a string
    cut off, or sound."""
    k = F.col("o_orderkey").cast("string")
    many = F.repeat(F.lit("["), F.lit(1200))
    bodies = [F.concat(F.lit('{"a": '), many, k, F.repeat(F.lit("]"), F.lit(1200)), F.lit("}")),
              F.concat(F.lit('{"title": "'), k), F.concat(F.lit("["), k, F.lit("]")), F.lit(" "),
              F.concat(F.lit('{"a": "\\"'), many, k, F.lit('"}')), F.concat(F.lit('{"a": "'), many, k),
              F.concat(F.lit(' {"a": [['), k, F.lit("]]} "))]
    body = F.get(F.array(*bodies), (F.col("o_orderkey") % len(bodies)).cast("int"))
    return table(spark, sf, "orders").select(F.concat(F.lit("p-"), k).alias("handle"), body.alias("body"))


def probe_answers(spark, sf) -> DataFrame:
    """(custkey, status, content_type, body): answers of stores to a catalogue probe."""
    k = F.col("c_custkey")
    body = pick(['{"products": []}', '{"products": [{"handle": "a"}]}', '{"errors": "x"}', '[]',
                 '<html>', '{"products": null}'], k)
    return table(spark, sf, "customer").select(
        k.alias("custkey"), pick(["200", "404", "200", "503", "301"], k).cast("int").alias("status"),
        pick(["application/JSON; charset=utf-8", "text/html", "application/json"], k)
        .alias("content_type"), body.alias("body"))


# --- product pages ----------------------------------------------------------------------

def product_pages(spark, sf) -> DataFrame:
    """(page_id, url, html): product pages of parts, by linked data, Open Graph, markup, nothing."""
    k, price = _k(), F.format_string("%.2f", "p_retailprice")
    ks = k.cast("string")
    product = F.concat(
        F.lit('{"@type": "Product", "name": "'), "p_name", F.lit('", "description": "About, '), "p_type",
        F.lit('", "mpn": "M'), ks, F.lit('", "brand": {"name": "'), "p_brand",
        F.lit('"}, "image": [{"url": "/i/'), ks, F.lit('.jpg"}], "offers": [{"lowPrice": "'), price,
        F.lit('"}]}'))
    shape = F.floor(k / 4) % 6
    block = (
        F.when(shape == 0, product)
        .when(shape == 1, F.concat(F.lit('[{"@type": "Person"}, '), product, F.lit("]")))
        .when(shape == 2, F.concat(F.lit('{"@graph": [{"@type": "WebSite"}, '), product, F.lit("]}")))
        .when(shape == 3, F.concat(F.lit('{"@type": "ItemList", "itemListElement": [{"item": '),
                                   product, F.lit("}]}")))
        .when(shape == 4, F.concat(F.lit('{"mainEntityOfPage": {"mainEntity": '), product, F.lit("}}")))
        .otherwise(F.replace(product, F.lit('"Product"'), F.lit('["Thing", "PRODUCT"]'))))
    ld = '<script type="application/ld+json">'
    linked = F.concat(
        F.lit(f"<html><head>{ld}{{broken</script>{ld}  </script>"
              f'{ld}{{"@type": "Person", "name": "N"}}</script>{ld}'),
        block, F.lit("</script></head><body><h1>Not this</h1></body></html>"))
    graph = F.concat(
        F.lit('<html><head><meta property="og:title" content=" '), "p_name",
        F.lit('"><meta name="og:description" content="D '), "p_type",
        F.lit('"><meta property="og:image" content="/o/'), ks,
        F.lit('.png"/><meta property="product:price:amount" content="'), price,
        F.lit('"><meta property="product:retailer_item_id" content="R'), ks,
        F.lit('"></head><body><h1>Not this</h1></body></html>'))
    long = F.concat(F.lit("A paragraph of more than fifty characters about "), "p_name", F.lit(" &amp; co."))
    plain = F.concat(
        F.lit("<html><body><p>"), long, F.lit(" outside</p><h1> "), "p_name",
        F.lit(' <b>x</b></h1><img src="data:abc"><img src="/logo.png"><img data-src="/p/'), ks,
        F.lit('.webp"><span class="Price-label">Price</span><div class="big PRICE">GBP <i>1,'), price,
        F.lit("</i> now</div><article><p>short<p>"), long, F.lit("</article></body></html>"))
    html = F.when(k % 4 == 0, linked).when(k % 4 == 1, graph).when(k % 4 == 2, plain).otherwise(
        "<html><body><h2>Nothing here</h2></body></html>")
    return spread(table(spark, sf, "part")).select(
        F.concat(F.lit("part-"), ks).alias("page_id"),
        F.concat(F.lit("https://shop.example/products/"), ks).alias("url"), html.alias("html"))


def crawled_pages(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "pages")).select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("page_id"), "url", "html")


def all_product_pages(spark, sf) -> DataFrame:
    return product_pages(spark, sf).unionByName(crawled_pages(spark, sf))


# --- stores -----------------------------------------------------------------------------

def _c() -> Column:
    return F.col("c_custkey")


def every(n: int, text: str, other: str = "") -> Column:
    """Text on every n-th customer."""
    return F.when(_c() % n == 0, text).otherwise(other)


def store_url() -> Column:
    return F.concat(F.lit("https://www.store"), _c().cast("string"),
                    pick([".co.uk", ".com", ".shop"], _c()))


def home_html() -> Column:
    c = _c().cast("string")
    return F.concat(
        F.lit("<!doctype html><html><head>"),
        F.when(_c() % 3 == 0, F.concat(
            F.lit("<title> Shop <!-- c -->number "), c, F.lit("</title>"))).otherwise(""),
        every(4, '<meta name="Description" content=" All we sell ">'),
        every(6, '<meta property="og:description" content="Shared text">'),
        every(5, '<link rel="stylesheet" href="/x.css"><link rel="alternate Canonical" href="/home">'),
        every(7, '<meta name="ROBOTS" content="noindex">'),
        F.lit("<script>var guarantee = '<b>';</script></head><body><header>"),
        every(2, '<nav><a href="/a">a</a><a href="/b">b</a><a href="/c">c</a></nav>'),
        F.lit('<a href="/cart">cart</a></header>'),
        every(8, '<div class="announcement-bar">Free post</div>'),
        every(3, "<h1> Hello <i>store</i> </h1>", "<h1> </h1>"),
        every(4, '<section class="hero-wide"><a href="#">Go</a><button class="btn x">Buy</button></section>'),
        every(5, '<div class="trustpilot trust-badge">ok</div><i class="star-rating"></i>'),
        every(6, '<input type="email"><input type="EMAIL">'),
        every(9, '<div class="main-carousel"><i class="slide a"></i><i class="slide"></i></div>'),
        every(10, '<p>Join our Newsletter</p>'),
        every(11, "<p>Safe Checkout, no hassle.</p>"),
        every(2, '<a href="/products/one#top">1</a><a href="products/two?x=1">2</a>'
                 '<a href="../products/one">1</a><a href="//cdn.example/products/3">3</a>'
                 '<a href="?q=/products/9">q</a>'),
        F.lit("</body></html>"))


def product_html() -> Column:
    return F.concat(
        F.lit("<html><body><h1>Thing</h1>"),
        every(2, '<form action="/cart/add"><div><button data-y="640" data-width="120" '
                 'data-height="48">Add</button></div></form>'),
        every(3, '<a class="x" data-y="900.5" href="#">BUY NOW</a>'),
        every(5, '<button name="add" data-y="843" data-width="44" data-height="43.5">Add to cart</button>'),
        every(4, '<img src="https://cdn.shopify.com/1.jpg" data-width="300"><img '
                 'src="https://cdn.shopify.com/1.jpg" data-width="300"><img '
                 'src="https://cdn.shopify.com/2.jpg" data-width="90"><img '
                 'src="https://x.shopify.com/3.jpg" data-width="101" data-visible="false"><img '
                 'src="https://x.shopify.com/4.jpg" data-width="101">'),
        every(3, '<s class="price compare-at">9</s><b class="price"> 7.50 <i>GBP</i></b>'),
        every(6, '<span class="product-reviews">many</span>'),
        every(12, '<i class="review-count">0</i>'),
        every(7, "<p>Hurry, ends soon</p>"),
        every(8, '<div class="related-items"></div>'), every(9, '<div class="bulk-price"></div>'),
        every(10, '<div class="sticky-bar my-cart"></div>'),
        F.lit("<script>var a = 'low stock';</script></body></html>"))


def mobile_html() -> Column:
    return F.concat(
        F.lit("<html><body>"), every(2, '<button aria-label="Open Menu">=</button>'),
        every(3, '<summary class="icon header__icon--menu"></summary>'),
        every(5, '<div class="js-nav-toggle"></div>'), F.lit("</body></html>"))


def cart_html() -> Column:
    return F.concat(
        F.lit("<html><body>"), every(2, "<button>Go to CHECKOUT</button>"),
        every(3, '<a href="/checkout?step=1">pay</a>'), every(4, '<i class="secure-icon"></i>'),
        every(5, '<div class="cross-items"></div>'), F.lit("</body></html>"))


def stores(spark, sf) -> DataFrame:
    """(store_url, url, html): captured homepages, one per customer."""
    return spread(table(spark, sf, "customer")).select(
        _c().alias("custkey"), store_url().alias("store_url"), store_url().alias("url"),
        home_html().alias("html"))


def view_pages(spark, sf, html: Column) -> DataFrame:
    return spread(table(spark, sf, "customer")).select(_c().alias("custkey"), html.alias("html"))


def captures(spark, sf) -> DataFrame:
    """(store_url, view, html, error): the five rendered views of every second store."""
    views = {"home": home_html(), "product": product_html(), "mobile_home": mobile_html(),
             "mobile_product": product_html(), "cart": cart_html()}
    rows = spread(table(spark, sf, "customer").where(_c() % 4 != 3)).select(
        store_url().alias("store_url"), F.when(_c() % 13 == 0, "timeout").alias("cart_error"),
        F.inline(F.array(*[F.struct(F.lit(v).alias("view"), h.alias("html"))
                           for v, h in views.items()])))
    return rows.select("store_url", "view", "html",
                       F.when(F.col("view") == "cart", F.col("cart_error")).alias("error"))


def store_signals(spark, sf, wide: bool = False) -> DataFrame:
    """One row of signals per customer; `wide` spreads them for work that costs much a row."""
    k = _c()
    customers = table(spark, sf, "customer")
    flag = lambda n, name: (k % n == 0).alias(name)
    load = F.round(F.abs("c_acctbal") / 2000, 2)
    return (spread(customers) if wide else customers).select(
        store_url().alias("store_url"),
        F.when(k % 9 != 0, F.concat(store_url(), F.lit("/products/p"), k.cast("string")))
        .alias("product_url"),
        load.alias("homepage_load_time"),
        flag(2, "atc_above_fold"), F.when(k % 2 == 0, 512.0).when(k % 3 == 0, 801.25).otherwise(9999.0)
        .alias("atc_y_position"),
        flag(3, "product_has_reviews"), (k % 6).cast("int").alias("product_image_count"),
        flag(4, "has_urgency"), flag(5, "has_cross_sell"), flag(7, "has_sticky_atc"),
        (k % 3 != 0).alias("price_visible"),
        F.when(k % 3 != 0, F.concat(F.lit("GBP "), k.cast("string"))).otherwise("").alias("price_text"),
        (k % 4 != 0).alias("cart_has_checkout_btn"), flag(3, "cart_has_trust"),
        flag(5, "cart_has_upsell"),
        F.when(k % 11 == 0, "timeout").otherwise("").alias("cart_flow_error"),
        flag(2, "mobile_atc_above_fold"), flag(3, "mobile_atc_tap_target_ok"),
        flag(5, "mobile_has_hamburger"), flag(4, "has_carousel"),
        (k % 5).cast("int").alias("carousel_slide_count"),
        flag(6, "has_email_capture"), (k % 3).cast("int").alias("email_capture_count"),
        flag(9, "has_email_capture_static"), (k % 4).cast("int").alias("trust_badge_count"),
        flag(8, "has_trust_text"), F.when(k % 8 == 0, "secure").otherwise("").alias("trust_text_match"),
        flag(3, "has_announcement_bar"), (k % 10 != 0).alias("has_h1"),
        (k % 5 != 0).alias("h1_has_content"),
        F.when(k % 5 != 0, F.concat(F.lit("Welcome to "), "c_name", F.lit(" and all of its goods")))
        .otherwise("").alias("h1_text"),
        (k % 3).cast("int").alias("hero_cta_count"), (k % 2 == 1).alias("has_visible_nav"),
        (k % 7 != 0).alias("has_meta_title"),
        F.when(k % 7 != 0, F.col("c_name")).otherwise("").alias("meta_title"),
        flag(2, "has_meta_description"),
        F.when(k % 2 == 0, F.concat(F.lit("All about "), "c_mktsegment")).otherwise("")
        .alias("meta_description"),
        flag(5, "has_canonical"), F.when(k % 5 == 0, store_url()).otherwise("").alias("canonical_href"),
        F.when(k % 2 == 0, F.create_map(
            F.lit("homepage"), F.lit("homepage_desktop.png"), F.lit("product"),
            F.lit("product_desktop.png"), F.lit("mobile"), F.lit("homepage_mobile.png"),
            F.lit("cart"), F.lit("cart_after_atc.png"))).alias("screenshots"))
