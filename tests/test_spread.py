"""Work that costs much a row runs on all cores, whatever a file's layout; plain tags read like the library's."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from merchframe.functions.html import _Elements
from merchframe.plans import inputs as I


class _Tolerant(_Elements):
    """The elements by the library's own reading of every tag."""

    parse_starttag, parse_endtag = HTMLParser.parse_starttag, HTMLParser.parse_endtag


def _tables(spark, folder):
    """Tables of one file with one row group each."""
    spark.range(400).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name")).coalesce(1).write.parquet(
        f"{folder}/customer.parquet")
    spark.range(400).select(
        F.col("id").alias("p_partkey"), F.lit("a part").alias("p_name"), F.lit("Brand#11").alias("p_brand"),
        F.lit("T").alias("p_type"), F.lit(1.5).alias("p_retailprice")).coalesce(1).write.parquet(f"{folder}/part.parquet")
    spark.range(40).select(F.col("id").alias("page_id"), F.lit("https://x/").alias("url"),
                           F.lit("<p>x").alias("html")).coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def _most_in_a_task(df):
    return max(r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())


def test_pages_of_one_row_group_spread_over_tasks(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    assert _most_in_a_task(I.stores(spark, sf)) <= 200
    assert _most_in_a_task(I.view_pages(spark, sf, I.cart_html())) <= 200
    assert _most_in_a_task(I.captures(spark, sf)) <= 1000
    assert _most_in_a_task(I.product_pages(spark, sf)) <= 200
    assert _most_in_a_task(I.crawled_pages(spark, sf)) <= 20
    assert I.stores(spark, sf).count() == 400 and I.crawled_pages(spark, sf).count() == 40


def test_plain_tags_read_like_the_library():
    pages = ['<div class="a b"><p id="x">one<p>two</div>', '<script type="application/ld+json"></script><b>x</b>',
             '<script>a<b</script>t', '<a href="x&amp;y" href="z">k</a>', '<A HREF=x>k</A >', '<i x="1"y="2">t</i>', '<br/>u',
             '<title>a<b></title>', '</p>', '<p class="">', '<style>p{}</style><p a="b">t</p', '<p a="<">q']
    draw = random.Random(5)
    pages += ["".join(draw.choice(pages + ["<", ">", '"', "/", "&", " ", "</div>"]) for _ in range(4)) for _ in range(300)]
    pages += [p[:draw.randrange(len(p))] for p in pages if p]
    for page in pages:
        fast, slow = _Elements().finish(page), _Tolerant().finish(page)
        assert (fast.texts, fast.nodes) == (slow.texts, slow.nodes), page
