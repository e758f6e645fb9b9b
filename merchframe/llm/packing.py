"""Packing by power-of-two decomposition.

A document's ids (byte-level BPE, then the end id 0) are cut into pieces of 1024 and the binary
parts of what is left, so that every sequence is one piece of one document, has a power of two as
its length and needs no padding. Sequences are numbered by length, longest first, so equal lengths
lie together and make dense batches.

Numbers come from counts: a task numbers its pieces of each length, and a running sum over the
tasks' counts (tasks times eleven lengths) shifts them. No piece is shuffled.
"""

import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from merchframe.llm.common import settle, ship_package, small_side

MAX_TOKENS = 1024
END_ID = 0
#: Texts with longer runs without white space go to the library whose merges cost n log n.
LONG_RUN = 20_000
#: Ids of words that a worker keeps, and documents whose pieces it holds at once.
CACHE_WORDS, OUT_ROWS = 250_000, 500

# The Unicode characters that count as white space; a token never goes on from another character to one of them.
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class Encoder:
    """Ids of the byte-level BPE vocabulary; strings of special tokens are ordinary text."""

    _made: dict = {}

    @classmethod
    def get(cls, name: str = "byte_bpe_50k") -> "Encoder":
        if name not in cls._made:
            cls._made[name] = cls(name)
        return cls._made[name]

    def __init__(self, name: str):
        import base64
        import re

        import public_tokenizers
        import tiktoken

        self.json = public_tokenizers.path(f"{name}.json")
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
        self.long_run = re.compile(f"[{_SPACE}]{{{LONG_RUN}}}|[^{_SPACE}]{{{LONG_RUN}}}")
        self.known: dict = {}
        self.slow = None

    def ids(self, text: str) -> np.ndarray:
        if len(text) >= LONG_RUN and self.long_run.search(text):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.json)
                self.slow.encode_special_tokens = True
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        known, parts = self.known, []
        for word in self.words.findall(text):
            part = known.get(word)
            if part is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                part = known[word] = array("I", self.fast.encode_ordinary(word)).tobytes()
            parts.append(part)
        return np.frombuffer(b"".join(parts), "<u4")


def cut(n: int, most: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: as many of `most` as fit, then falling powers of two."""
    out = [(at * most, most) for at in range(n // most)]
    at, rest, length = n - n % most, n % most, most // 2
    while rest:
        if rest >= length:
            out.append((at, length))
            at, rest = at + length, rest - length
        length //= 2
    return out


def _pieces(with_ids: bool):
    def run(batches):
        encoder, task, seen = Encoder.get(), TaskContext.get().partitionId(), {}
        for pdf in (batch[at:at + OUT_ROWS] for batch in batches for at in range(0, len(batch), OUT_ROWS)):
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.append(encoder.ids(text or ""), np.uint32(END_ID)).astype("<u4")
                for start, length in cut(len(ids)):
                    piece = ids[start:start + length]
                    number = seen[length] = seen.get(length, -1) + 1
                    rows.append((doc_id, start, length, zlib.crc32(piece.tobytes()), len(ids), task, number)
                                + ((piece.astype("i4"),) if with_ids else ()))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "number"]
                               + ["ids"] * with_ids).astype({"doc_id": "Int64"})
    return run


def pack(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per piece of `docs` (doc_id, text, ...): doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (always 0) and, if asked for, ids.

    A null or empty text is the end id alone. Repeated rows are documents of their own. Sequence ids
    run from 0 without gaps, longer sequences first.
    """
    ship_package(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, number long"
    pieces = settle(docs.select("doc_id", "text").mapInPandas(
        _pieces(with_ids), schema + ", ids array<int>" * with_ids), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    by_length = counts.groupBy("length").agg(F.sum("n").alias("all"))
    order = W.orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, -1)  # eleven rows
    base = by_length.select("length", F.coalesce(F.sum("all").over(order), F.lit(0)).alias("base"))
    tasks = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    shift = settle(counts.withColumn("before", F.coalesce(F.sum("n").over(tasks), F.lit(0))).join(base, "length").select(
        "length", "task", (F.col("base") + F.col("before")).alias("shift")), "shifts")
    return pieces.join(small_side(shift), ["length", "task"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("shift") + F.col("number")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else []))
