"""Alignment of two tokenizers' tokens, by lockstep merging of byte offsets.

Tokenizer A (byte-level BPE) and tokenizer B (SentencePiece BPE) both spell a blank and the text.
Offsets at which a token of each ends cut the tokens into groups; an A and a B occurrence of one group
are linked. A pair of ids counts in how many documents of the corpus it is linked.

1. In each batch a document is cut in front of blanks that follow other signs. Both tokenizers
   always end a token there (A's pattern never runs over such a place, and no piece of B holds a blank
   behind another sign, which is checked), so a cut changes no id and no group crosses it. Units that
   repeat in a batch are encoded and aligned once.
2. All distinct units of a batch are merged in lockstep: a state vector holds each unit's places in its A and B
   tokens and their byte ends. A step moves the pointer with the smaller end, closes a group
   where the ends meet, and drops finished units from the vector.
3. Links of closed groups are summed up by pair of ids, first within a unit, then within a document.
4. Pairs are counted over all documents with partial sums, and joined back to the documents' pairs.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from merchframe.llm.common import settle, ship_package, small_side
from merchframe.llm.fill_middle import blocks
from merchframe.llm.packing import LONG_RUN, Encoder

#: Text bytes that are aligned together (a longer text is a block of its own).
BLOCK_BYTES = 4 << 20
#: Groups with more links than this are summed up by distinct ids before they are multiplied out.
WIDE = 4_096
#: Bits of a B id in the number of a pair.
B_BITS = 15

_SCHEMA = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pairs array<int>, times array<long>")


class Tokenizers:
    """Both vocabularies of a worker, with the bytes of every token."""

    _made: dict = {}

    @classmethod
    def get(cls, a: str, b: str) -> "Tokenizers":
        if (a, b) not in cls._made:
            cls._made[a, b] = cls(a, b)
        return cls._made[a, b]

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.a = Encoder.get(a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds a blank behind another sign: texts can't be cut at blanks")
        if len(pieces) > 1 << B_BITS or self.a.fast.n_vocab > 1 << (31 - B_BITS):
            raise ValueError("a pair of ids doesn't fit into 31 bits")
        self.blank = self.b.piece_to_id("▁")
        self.a_bytes = self._spelled([self.a.fast.decode_single_token_bytes(i) for i in range(self.a.fast.n_vocab)])
        self.b_bytes = self._spelled([
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else
            b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)])

    @staticmethod
    def _spelled(tokens):
        return pa.array(tokens, pa.large_binary()), np.array([len(t) for t in tokens], "i8")

    def encode(self, units: list[str]):
        """(ids, offsets) of both tokenizers for units that each begin with a blank."""
        # Units are distinct, so the encoder's memory of words has no use for short ones.
        fast = self.a.fast.encode_ordinary
        of_a = [fast(u) if len(u) < LONG_RUN else self.a.ids(u) for u in units]
        of_b = [ids if u != " " else [self.blank] for u, ids in zip(units, self.b.encode(
            [u[1:] for u in units], num_threads=1))]  # the model puts the blank back in front
        return _flat(of_a, "i8"), _flat(of_b, "i8")


def _flat(lists, kind):
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype="i8")])
    return (np.concatenate(lists).astype(kind) if len(lists) else np.empty(0, kind)), offsets


def cut_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Units of each text with a blank in front: the flat units, and how many each text has."""
    spelled = pc.binary_join_element_wise(
        pa.scalar(" ", pa.large_string()), texts.cast(pa.large_string()), pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(spelled.buffers()[1], "i8")[spelled.offset:spelled.offset + len(spelled) + 1]
    data = np.frombuffer(spelled.buffers()[2], "u1")[offsets[0]:offsets[-1]]
    starts = offsets[:-1] - offsets[0]
    white = np.zeros(256, bool)
    white[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
    places = np.flatnonzero(data[1:] == 32) + 1
    places = places[~white[data[places - 1]]]
    # Signs of two or three bytes that count as white space; a cut behind one is left out.
    one, two, three = (data[np.maximum(places - k, 0)] for k in (1, 2, 3))
    wide = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    wide |= (three == 0xE1) & (((two == 0x9A) & (one == 0x80)) | ((two == 0xA0) & (one == 0x8E)))
    wide |= (three == 0xE2) & (two == 0x80) & ((one <= 0x8B) | np.isin(one, [0xA8, 0xA9, 0xAF]))
    wide |= (three == 0xE2) & (two == 0x81) & (one == 0x9F) | (three == 0xE3) & (two == 0x80) & (one == 0x80)
    first = np.zeros(len(data), bool)
    first[places[~wide]] = True
    first[starts] = True
    ends = np.append(np.flatnonzero(first), len(data)).astype("i8")
    units = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return units, np.diff(np.append(np.searchsorted(ends, starts), len(ends) - 1))


def lockstep(a_sizes, a_at, b_sizes, b_at):
    """Groups of all units: (unit, end in A, end in B), by unit and place.

    `a_sizes` are the byte sizes of all A tokens, `a_at` the first token of each unit and the total; B likewise.
    The sizes of a unit add up to the same number on both sides.
    """
    unit = np.flatnonzero((np.diff(a_at) > 0) & (np.diff(b_at) > 0))
    a, b = a_at[unit].copy(), b_at[unit].copy()
    a_to, b_to = a_at[unit + 1], b_at[unit + 1]
    a_end, b_end = a_sizes[a], b_sizes[b]
    found = []
    while len(unit):
        meet = a_end == b_end
        step_a, step_b = a_end <= b_end, b_end <= a_end
        a, b = a + step_a, b + step_b
        if meet.any():
            found.append((unit[meet], a[meet], b[meet]))
            alive = ~(meet & (a == a_to))
            if not alive.all():
                unit, a, b, a_to, b_to = unit[alive], a[alive], b[alive], a_to[alive], b_to[alive]
                a_end, b_end, step_a, step_b = a_end[alive], b_end[alive], step_a[alive], step_b[alive]
        a_end = a_end + np.where(step_a, a_sizes[a], 0) if len(unit) else a_end
        b_end = b_end + np.where(step_b, b_sizes[b], 0) if len(unit) else b_end
    if not found:
        return (np.empty(0, "i8"),) * 3
    units, a, b = (np.concatenate(part) for part in zip(*found))
    order = np.lexsort((a, units))
    return units[order], a[order], b[order]


def group_links(units, a_ids, b_ids, a_from, a_to, b_from, b_to):
    """Links of groups by pair of ids: (unit, pair, times), a pair perhaps in several rows of a unit."""
    n_a, n_b = a_to - a_from, b_to - b_from
    wide = n_a * n_b > WIDE
    plain = np.flatnonzero(~wide)
    n = (n_a * n_b)[plain]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    width = np.repeat(n_b[plain], n)
    a = a_ids[np.repeat(a_from[plain], n) + within // width] if len(n) else np.empty(0, "i8")
    b = b_ids[np.repeat(b_from[plain], n) + within % width] if len(n) else np.empty(0, "i8")
    out = [(np.repeat(units[plain], n), a << B_BITS | b, np.ones(len(a), "i8"))]
    for g in np.flatnonzero(wide):
        of_a, times_a = np.unique(a_ids[a_from[g]:a_to[g]], return_counts=True)
        of_b, times_b = np.unique(b_ids[b_from[g]:b_to[g]], return_counts=True)
        pairs = (of_a[:, None] << B_BITS | of_b[None, :]).ravel()
        out.append((np.full(len(pairs), units[g]), pairs, (times_a[:, None] * times_b[None, :]).ravel()))
    return tuple(np.concatenate(part) for part in zip(*out))


def _summed(owner, pair, times):
    """Sums of times by (owner, pair), sorted; owners and pairs are below 2^31."""
    key = owner << 31 | pair
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, "i8")
    return key[first] >> 31, key[first] & (2**31 - 1), np.add.reduceat(times[order], first) if len(first) else times[:0]


def _expand(chosen, offsets):
    """Positions of all members of the chosen lists, and how many each has."""
    n = offsets[chosen + 1] - offsets[chosen]
    return np.repeat(offsets[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


def _group_texts(tok, a_ids, b_ids, a_from, a_to, b_from, b_to, count):
    """Text `a1,a2|b1;a3|b2` of each unit's groups."""
    a, b = a_ids.tolist(), b_ids.tolist()
    out, groups = [], iter(zip(a_from.tolist(), a_to.tolist(), b_from.tolist(), b_to.tolist()))
    for n in count.tolist():
        parts = []
        for _ in range(n):
            i, j, k, m = next(groups)
            if j - i == 1 and m - k == 1:
                parts.append(f"{a[i]}|{b[k]}")
            else:
                parts.append(",".join(map(str, a[i:j])) + "|" + ",".join(map(str, b[k:m])))
        out.append(";".join(parts))
    return out


def _align_block(block: pa.RecordBatch, tok: Tokenizers) -> pa.RecordBatch:
    rows = len(block)
    full = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(block["text"]), 0), False).to_numpy(zero_copy_only=False))
    flat, per_text = cut_units(pc.take(block["text"], pa.array(full, pa.int64())))
    coded = flat.dictionary_encode()
    distinct = coded.dictionary
    use = coded.indices.to_numpy(zero_copy_only=False).astype("i8")
    text_of = np.repeat(np.arange(len(full)), per_text)

    units = distinct.cast(pa.large_string()).to_pylist()
    (a_ids, a_at), (b_ids, b_at) = tok.encode(units)
    sizes = np.diff(np.frombuffer(distinct.buffers()[1], "i8")[distinct.offset:distinct.offset + len(distinct) + 1])
    good = np.ones(len(units), bool)
    for ids, at, (spelled, widths) in ((a_ids, a_at, tok.a_bytes), (b_ids, b_at, tok.b_bytes)):
        total = np.concatenate([[0], np.cumsum(widths[ids])])
        good &= np.diff(total[at]) == sizes
        if good.all() and _joined(spelled.take(pa.array(ids))) == _joined(distinct):
            continue
        for k in np.flatnonzero(good).tolist():  # only where some unit isn't spelled as it stands
            good[k] = b"".join(spelled.take(pa.array(ids[at[k]:at[k + 1]])).to_pylist()) == units[k].encode()

    # Units that aren't spelled the same way drop out, and so do their texts below.
    a_at, b_at, a_ids, b_ids = *(_kept_offsets(at, good) for at in (a_at, b_at)), *(
        ids[np.repeat(good, np.diff(at))] for ids, at in ((a_ids, a_at), (b_ids, b_at)))
    unit, a_to, b_to = lockstep(tok.a_bytes[1][a_ids], a_at, tok.b_bytes[1][b_ids], b_at)
    starts = np.append(True, unit[1:] != unit[:-1]) if len(unit) else np.empty(0, bool)
    a_from = np.where(starts, a_at[unit], np.append(0, a_to[:-1])[:len(unit)])
    b_from = np.where(starts, b_at[unit], np.append(0, b_to[:-1])[:len(unit)])
    n_groups = np.bincount(unit, minlength=len(units))
    texts = _group_texts(tok, a_ids, b_ids, a_from, a_to, b_from, b_to, n_groups)
    owner, pair, times = _summed(*group_links(unit, a_ids, b_ids, a_from, a_to, b_from, b_to))
    pair_at = np.searchsorted(owner, np.arange(len(units) + 1))

    bad = np.bincount(text_of, weights=~good[use], minlength=len(full)) > 0
    use, text_of = use[~bad[text_of]], text_of[~bad[text_of]]

    def total(per_unit):
        out = np.zeros(rows, "i8")
        out[full] = _sum_by(text_of, per_unit[use], len(full))
        return out

    links = _sum_by(owner, times, len(units))
    key, often = np.unique(text_of * max(len(units), 1) + use, return_counts=True)
    whose, which = key // max(len(units), 1), key % max(len(units), 1)
    places, n = _expand(which, pair_at)
    doc, doc_pair, doc_times = _summed(np.repeat(whose, n), pair[places], times[places] * np.repeat(often, n))
    doc_at = np.zeros(rows + 1, "i8")
    doc_at[1:][full] = np.bincount(doc, minlength=len(full))
    doc_at = np.cumsum(doc_at)

    hashes, ends = [""] * rows, np.searchsorted(text_of, np.arange(len(full) + 1))
    use = use.tolist()
    for k, row in enumerate(full.tolist()):
        if ends[k] < ends[k + 1]:
            hashes[row] = hashlib.sha256(";".join([texts[u] for u in use[ends[k]:ends[k + 1]]]).encode()).hexdigest()
    use = np.array(use, "i8")
    lists = [pa.ListArray.from_arrays(pa.array(doc_at, pa.int32()), pa.array(values, kind))
             for values, kind in ((doc_pair, pa.int32()), (doc_times, pa.int64()))]
    return pa.record_batch(
        [block["row"], block["doc_id"], pa.array(total(np.diff(a_at))), pa.array(total(np.diff(b_at))),
         pa.array(total(n_groups)), pa.array(total(links)), pa.array(hashes, pa.string()), *lists],
        names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def _sum_by(owner, values, n):
    """Exact sums of integers by owner; owners ascend."""
    total = np.concatenate([[0], np.cumsum(values)])
    at = np.searchsorted(owner, np.arange(n + 1))
    return total[at[1:]] - total[at[:-1]]


def _kept_offsets(at, good):
    return np.concatenate([[0], np.cumsum(np.diff(at) * good)])


def _joined(values: pa.Array) -> bytes:
    at = np.frombuffer(values.buffers()[1], "i8")[values.offset:values.offset + len(values) + 1]
    return values.buffers()[2].slice(at[0], at[-1] - at[0]).to_pybytes() if len(values) and values.buffers()[2] else b""


def _align(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizers.get(a, b)
        for batch in batches:
            for block in blocks(batch, BLOCK_BYTES):
                yield _align_block(block, tok)
    return run


def alignments(docs: DataFrame, a: str = "byte_bpe_50k", b: str = "piece_bpe_32k.model") -> DataFrame:
    """Per row of `docs` (doc_id, text, ...): a number of the row, doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256, and the linked pairs of ids (A id above 15 bits of B id) with their links.

    Texts that are null, empty or not spelled alike by both tokenizers have no tokens: zeros, an
    empty hash and no pairs. Repeated rows are documents of their own, other columns are ignored, and a
    very long text is a block of its own. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(_align(a, b), _SCHEMA)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs, best): in how many documents a pair is linked, and whether its A id has no pair of more."""
    counts = settle(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(
        F.count(F.lit(1)).alias("docs")), "pair-counts")
    most = counts.groupBy(F.shiftright("pair", B_BITS).alias("a")).agg(F.max("docs").alias("most"))
    return counts.withColumn("a", F.shiftright("pair", B_BITS)).join(most, "a").select(
        "pair", "docs", (F.col("docs") == F.col("most")).cast("long").alias("best"))


def align(docs: DataFrame, a: str = "byte_bpe_50k", b: str = "piece_bpe_32k.model") -> DataFrame:
    """Per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best counts the links whose pair is in the most documents for its A id, count_sum sums the
    documents of the links' pairs. The counts are joined by broadcast while they are few, else by a
    shuffle of the documents' distinct pairs; both give the same.
    """
    aligned = settle(alignments(docs, a, b), "alignments")
    counts = settle(pair_counts(aligned), "pair-weights")
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select(
        "row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    sums = links.join(small_side(counts), "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    nothing = F.lit(0).cast("long")
    return aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(
        sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", nothing).alias("n_best"),
        F.coalesce("count_sum", nothing).alias("count_sum"), "groups_sha256")
