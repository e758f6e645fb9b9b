"""Containers on a page: one walk gives what comparing every element with every container gives."""

import random
import time

from pyspark.sql import functions as F

from merchframe.functions.html import parse_html
from merchframe.operators import pages, signals

LONG = "A paragraph that is certainly longer than fifty characters, number "


def random_page(draw):
    out, open_tags = [], []
    for k in range(draw.randint(0, 40)):
        kind = draw.random()
        if kind < 0.25 and open_tags:
            out.append(f"</{open_tags.pop()}>")
        elif kind < 0.6:
            tag, more = draw.choice([("div", ' class="hero"'), ("div", ' class="product-box"'), ("main", ""), ("article", ""), ("nav", ""),
                                     ("header", ""), ("form", ' action="/cart/add"'), ("section", ""), ("form", "")])
            out.append(f"<{tag}{more}>")
            open_tags.append(tag)
        else:
            out.append(draw.choice([f"<p>{LONG}{k}</p>", "<p>short</p>", f'<p class="product">{LONG}{k}</p>', f'<a href="/{k}">x</a>',
                                    f'<a class="button" href="/{k}">x</a>', f'<button data-y="{k}">b</button>', f'<i class="btn">{k}</i>',
                                    f'<b class="add-to-cart" data-y="{k}">c</b>']))
    return "".join(out)


def brute(page):
    nodes, texts = page["nodes"], page["texts"]
    cls = lambda n: n["attrs"].get("class", "")
    text = lambda n: " ".join(texts[n["t0"]:n["t1"]])
    inner = lambda n, boxes: any(b["idx"] < n["idx"] <= b["last"] for b in boxes)
    roots = [n for n in nodes if n["tag"] in ("main", "article") or "product" in cls(n)]
    long = [n for n in nodes if n["tag"] == "p" and len(text(n)) > 50]
    held = [p for r in roots for p in long if inner(p, [r])] if roots else long
    zones = [n for n in nodes if "hero" in cls(n) or "banner" in cls(n)]
    bars = [n for n in nodes if n["tag"] in ("nav", "header")]
    forms = [n for n in nodes if n["tag"] == "form" and "/cart/add" in n["attrs"].get("action", "")]
    atc = [n for n in nodes if n["tag"] == "button" and inner(n, forms) or cls(n) == "add-to-cart"]
    return (text(held[0]) if held else "",
            sum(n["tag"] == "button" or cls(n) == "btn" or n["tag"] == "a" and (cls(n) == "button" or inner(n, zones)) for n in nodes),
            sum(n["tag"] == "a" and inner(n, bars) for n in nodes), atc[0]["idx"] if atc else None)


def found(spark, htmls):
    parsed = spark.createDataFrame(list(enumerate(htmls)), "k int, html string").select("k", parse_html("html").alias("page"))
    page = F.col("page")
    return parsed.select("k", "page", pages.html_description(page).alias("d"), signals.hero_cta_count(page).alias("h"),
                         signals.nav_link_count(page).alias("n"), signals.desktop_atc(page)["idx"].alias("a"))


def test_walks_equal_brute_force(spark):
    draw = random.Random(8)
    rows = found(spark, [random_page(draw) for _ in range(400)] + ["", None, "<main></main>"]).collect()
    assert len(rows) == 403
    for r in rows:
        assert (r.d, r.h, r.n, r.a) == brute(r.page), r.k
    assert len({r.d for r in rows}) > 30 and {r.n for r in rows} >= {0, 1, 2} and any(r.a is None for r in rows)


def test_many_containers_and_paragraphs(spark):
    boxes = '<div class="product hero"><nav></nav></div>' * 10_000
    html = boxes + f"<p>{LONG}</p>" * 10_000 + '<a href="/x">x</a>' * 10_000
    began = time.time()
    r = found(spark, [html]).select("d", "h", "n", "a").first()
    # None of the paragraphs lies in a box, so a description by pairs would compare 100 million of them.
    assert (r.d, r.h, r.n, r.a) == ("", 0, 0, None)
    assert time.time() - began < 30
    deep = '<div class="product">' * 900 + f"<p>{LONG}</p>"
    assert found(spark, [deep]).first().d == LONG.strip()
