"""Linked-data blocks: the first product node of a JSON document."""

import json
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

# Ship the UDFs by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NESTING = ("@graph", "mainEntity", "mainEntityOfPage")


def _children(node):
    """Nodes below a node, in the order they are searched."""
    if isinstance(node, list):
        yield from node
        return
    kinds = node.get("@type", "")
    kinds = kinds if isinstance(kinds, list) else [kinds]
    if "itemlist" in [str(k).lower() for k in kinds]:
        entries = node.get("itemListElement")
        for entry in entries if isinstance(entries, list) else ():
            if isinstance(entry, dict):
                yield entry.get("item") or entry
    for key in _NESTING:
        if key in node:
            yield node[key]


def _is_product(node):
    kinds = node.get("@type", "")
    kinds = kinds if isinstance(kinds, list) else [kinds]
    return any(str(k).lower() == "product" for k in kinds)


def first_product(text):
    """JSON text of the first product node, depth first, or None; also None for text nested too deep to read."""
    try:
        waiting = [json.loads(text)]
    except (TypeError, ValueError, RecursionError):
        return None
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict) and _is_product(node):
            return json.dumps(node, ensure_ascii=False)
        if isinstance(node, (dict, list)):
            waiting.extend(reversed(list(_children(node))))
    return None


@F.arrow_udf(T.StringType())
def find_product(blocks: pa.Array) -> pa.Array:
    return pa.array([first_product(b.as_py()) for b in blocks], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def find_products(blocks: pa.Array) -> pa.Array:
    """Product nodes of all blocks of a page, blocks without one left out."""
    return pa.array(
        [[p for p in map(first_product, row or []) if p is not None] for row in blocks.to_pylist()],
        pa.list_(pa.string()))
