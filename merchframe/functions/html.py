"""Captured pages as rows of elements.

One Arrow UDF turns a page into its text fragments and its elements in document order. An
element keeps two intervals instead of copies of text and ancestors: the fragments it spans
(`t0`, `t1`) and the last element inside it (`last`). Output size is linear in the page, and
every signal is then a built-in expression on the arrays.
"""

import re
import sys
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

from merchframe.functions.text import or_blank

# Ship the UDFs by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ELEMENT = (
    T.StructType().add("idx", "integer").add("tag", "string")
    .add("attrs", T.MapType(T.StringType(), T.StringType()))
    .add("t0", "integer").add("t1", "integer").add("last", "integer").add("script", "string"))
PAGE = T.StructType().add("texts", T.ArrayType(T.StringType())).add("nodes", T.ArrayType(ELEMENT))

# Element names of the HTML standard with special parsing.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
LINKED_DATA = "application/ld+json"
SILENT = {"script", "style", "template", "rt", "rp"}
CLOSES_P = {"p", "div", "ul", "ol", "dl", "table", "form", "h1", "h2", "h3", "h4", "h5", "h6",
            "section", "article", "aside", "nav", "header", "footer", "main", "pre", "hr",
            "blockquote", "fieldset", "address"}
SAME_KIND = {"li", "option", "tr", "td", "th", "dt", "dd"}

# Tags written in the usual way, which need no tolerant reading; the names the library reads text under are left to it.
_START = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z][a-z0-9:-]*="[^"<>&]*")*)>')
_ATTR = re.compile(r' ([a-z][a-z0-9:-]*)="([^"]*)"')
_END = re.compile(r"</([a-z][a-z0-9]*)>")
_RAW = {"plaintext", *HTMLParser.CDATA_CONTENT_ELEMENTS, *getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ())}


class _Elements(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts, self.nodes, self.open, self.pending = [], [], [], []
        # How many elements of each name, and how many silent ones, are open.
        self.depths, self.silent = {}, 0

    def flush_text(self):
        text = "".join(self.pending)
        self.pending = []
        inner = self.nodes[self.open[-1]] if self.open else None
        if self.silent:
            if inner[0] == "script" and inner[1].get("type") == LINKED_DATA:
                inner[5] = text
        elif text.strip():
            self.texts.append(text.strip())

    def close_from(self, depth):
        while len(self.open) > depth:
            node = self.nodes[self.open.pop()]
            self.depths[node[0]] -= 1
            self.silent -= node[0] in SILENT
            node[3], node[4] = len(self.texts), len(self.nodes) - 1

    def close_open(self, name):
        """Close the innermost open element of a name and all inside it, if there is one."""
        if self.depths.get(name):
            depth = len(self.open) - 1
            while self.nodes[self.open[depth]][0] != name:
                depth -= 1
            self.close_from(depth)

    def updatepos(self, i, j):
        return j  # no line numbers are wanted

    def parse_starttag(self, i):
        plain = _START.match(self.rawdata, i)
        if plain is None or plain[1] in _RAW:
            return super().parse_starttag(i)
        self.handle_starttag(plain[1], _ATTR.findall(plain[2]) if plain[2] else ())
        return plain.end()

    def parse_endtag(self, i):
        plain = _END.match(self.rawdata, i) if self.cdata_elem is None else None
        if plain is None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1])
        return plain.end()

    def handle_starttag(self, tag, attrs):
        if self.pending or self.silent:
            self.flush_text()
        if tag in CLOSES_P:
            self.close_open("p")
        elif tag in SAME_KIND and self.open and self.nodes[self.open[-1]][0] == tag:
            self.close_from(len(self.open) - 1)
        found = {}
        for name, value in attrs:
            found.setdefault(name, value or "")
        at = len(self.texts)
        self.nodes.append([tag, found, at, at, len(self.nodes), None])
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)
            self.depths[tag] = self.depths.get(tag, 0) + 1
            self.silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.close_from(len(self.open) - 1)

    def handle_endtag(self, tag):
        # An empty script has a blank text of its own.
        if self.pending or self.silent:
            self.flush_text()
        self.close_open(tag)

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self.flush_text()

    def finish(self, html):
        self.feed(html)
        self.close()
        self.flush_text()
        self.close_from(0)
        return self


@F.arrow_udf(PAGE)
def _parse(htmls: pa.Array) -> pa.Array:
    texts, text_at = [], [0]
    rows, row_at = [], [0]
    for html in htmls:
        page = _Elements().finish(html.as_py() or "")
        texts.extend(page.texts)
        text_at.append(len(texts))
        rows.extend((i, *node) for i, node in enumerate(page.nodes))
        row_at.append(len(rows))
    idx, tag, attrs, t0, t1, last, script = zip(*rows) if rows else ([],) * 7
    elements = pa.StructArray.from_arrays(
        [pa.array(idx, pa.int32()), pa.array(tag, pa.string()),
         pa.array([list(a.items()) for a in attrs], pa.map_(pa.string(), pa.string())),
         pa.array(t0, pa.int32()), pa.array(t1, pa.int32()), pa.array(last, pa.int32()),
         pa.array(script, pa.string())],
        names=["idx", "tag", "attrs", "t0", "t1", "last", "script"])
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(pa.array(text_at, pa.int32()), pa.array(texts, pa.string())),
         pa.ListArray.from_arrays(pa.array(row_at, pa.int32()), elements)],
        names=["texts", "nodes"])


def parse_html(html) -> Column:
    """struct(texts, nodes) of a page; NULL reads as an empty page."""
    return _parse(or_blank(html))


# --- expressions on a parsed page -------------------------------------------------------

def attr(node: Column, name: str) -> Column:
    return or_blank(node["attrs"][name])


def has_attr(node: Column, name: str) -> Column:
    return F.map_contains_key(node["attrs"], name)


def class_has(node: Column, *words: str) -> Column:
    """Class attribute contains any of the words as a substring."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(attr(node, "class"), F.lit(word))
    return found


def class_is(node: Column, *names: str) -> Column:
    """One of the class names is exactly one of the given names."""
    return attr(node, "class").rlike(r"(^|\s)(" + "|".join(names) + r")(\s|$)")


def text_of(page: Column, node: Column, sep: str = " ") -> Column:
    return F.array_join(F.slice(page["texts"], node["t0"] + 1, node["t1"] - node["t0"]), sep)


def body_text(page: Column) -> Column:
    return F.array_join(page["texts"], " ")


def select(page: Column, test) -> Column:
    return F.filter(page["nodes"], test)


def first(page: Column, test) -> Column:
    """First element in document order that passes the test, or NULL."""
    return F.get(select(page, test), F.lit(0))


def any_of(page: Column, test) -> Column:
    return F.coalesce(F.exists(page["nodes"], test), F.lit(False))


def sweep_inside(page: Column, container, test) -> Column:
    """struct(n, first): how many elements pass `test(element, inside)`, and idx of the first one.

    `inside` says whether the element lies in an element that passes `container`. One walk over the page keeps the
    furthest end of the containers met so far, so that time is linear however many there are.
    """
    start = F.struct(F.lit(-1).alias("until"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("first"))

    def step(state, node):
        hit = F.coalesce(test(node, node["idx"] <= state["until"]), F.lit(False))
        return F.struct(
            F.when(container(node), F.greatest(state["until"], node["last"])).otherwise(state["until"]).alias("until"),
            (state["n"] + hit.cast("int")).alias("n"),
            F.when(hit, F.coalesce(state["first"], node["idx"])).otherwise(state["first"]).alias("first"))
    return F.aggregate(page["nodes"], start, step, lambda s: F.struct(s["n"].alias("n"), s["first"].alias("first")))


def first_in_containers(page: Column, container, test) -> Column:
    """idx of the first element that passes the test within the first container that holds one; without any
    container on the page, of the first such element at all. NULL if there is none.

    The page is walked from its end: at a container, the last match met is the first one behind its start, and a
    container further in front takes the place of those behind it. So no container meets all elements.
    """
    none = F.lit(None).cast("int")
    start = F.struct(none.alias("next"), none.alias("held"), F.lit(False).alias("boxed"))

    def step(state, node):
        box = F.coalesce(container(node), F.lit(False))
        return F.struct(
            F.when(F.coalesce(test(node), F.lit(False)), node["idx"]).otherwise(state["next"]).alias("next"),
            F.when(box & (state["next"] <= node["last"]), state["next"]).otherwise(state["held"]).alias("held"),
            (state["boxed"] | box).alias("boxed"))
    return F.aggregate(F.reverse(page["nodes"]), start, step,
                       lambda s: F.when(s["boxed"], s["held"]).otherwise(s["next"]))


def at(page: Column, idx: Column) -> Column:
    """The element with that idx; NULL for none."""
    return F.get(page["nodes"], idx)
