"""Fill-in-the-middle forms of documents, one pyarrow.compute pipeline per batch.

A text is cut into units (a word with the white space in front of it; white space at the end is a
unit of its own). Two cuts between units, drawn from a hash of doc_id, part it into prefix, middle
and suffix, which are written in one of two orders behind marks:

    psm  <P>prefix<S>suffix<M>middle
    spm  <S>suffix<P>prefix<M>middle

Half of the documents stay plain, and so does a text that is empty or holds a mark, so the marks of
a formed text are its only ones and `restored` gives back the exact text.

Per batch: a separator byte that UTF-8 never holds goes in front of each unit and splits the texts
into lists; the flat units with the index of their document and their ordinal in it get a role;
units are filtered by role, put back into lists and joined. No unit is touched by Python.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from merchframe.llm.common import ship_package

#: Marks of prefix, suffix and middle. Fixed values.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Seed of the draws, share of plain documents in hundredths, share of spm among the others.
SEED, PLAIN, SPM = 42, 50, 80
#: Text bytes that a step of the pipeline holds at once (a longer text is a step of its own).
BLOCK_BYTES = 16 << 20

_SPACE = r"\t-\r "
_SEPARATOR = b"\xff"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def split_units(texts: pa.Array) -> pa.Array:
    """list<large_binary> of the units of each text; an empty text has none."""
    raw = texts.cast(pa.large_string()).cast(pa.large_binary())
    # A unit starts where white space follows a character that is none; such pairs never overlap.
    marked = pc.replace_substring_regex(
        raw, pattern=f"([^{_SPACE}])([{_SPACE}])", replacement=b"\\1" + _SEPARATOR + b"\\2")
    lists = pc.split_pattern(marked, pattern=_SEPARATOR)
    # Only an empty text gives an empty part.
    return _regroup(pc.list_flatten(lists), pc.list_parent_indices(lists), len(texts),
                    pc.greater(pc.binary_length(pc.list_flatten(lists)), 0))


def _regroup(values: pa.Array, parents: pa.Array, n: int, keep: pa.Array) -> pa.Array:
    """Lists of the kept values by their parent, for n parents."""
    counts = np.bincount(pc.filter(parents, keep).to_numpy(zero_copy_only=False), minlength=n)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pc.filter(values, keep))


def _form_block(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = pc.fill_null(batch["text"], "")
    size = len(texts)
    lists = split_units(texts)
    units, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    starts = lists.offsets.to_numpy(zero_copy_only=False)[:-1]
    ordinals = pc.subtract(pa.array(np.arange(len(units))), pc.take(pa.array(starts), parents))
    draws = [batch[f"h{k}"].to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4)]
    first, second = draws[0] % (n + 1), draws[1] % (n + 1)
    low, high = (pc.take(pa.array(f(first, second)), parents) for f in (np.minimum, np.maximum))
    in_prefix, in_suffix = pc.less(ordinals, low), pc.greater_equal(ordinals, high)
    in_middle = pc.invert(pc.or_(in_prefix, in_suffix))
    prefix, middle, suffix = (
        pc.binary_join(_regroup(units, parents, size, keep), pa.scalar(b"", pa.large_binary())).cast(
            pa.large_string(), safe=False) for keep in (in_prefix, in_middle, in_suffix))

    marked = pc.match_substring_regex(texts, "|".join((PREFIX, SUFFIX, MIDDLE)))
    plain = pc.or_(pc.or_(pc.equal(texts, ""), marked), pa.array(draws[2] % 100 >= PLAIN))
    spm = pa.array(draws[3] % 100 < SPM)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))

    def joined(*parts):
        return pc.binary_join_element_wise(*[
            pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in parts],
            pa.scalar("", pa.large_string()))

    output = pc.if_else(plain, texts.cast(pa.large_string()), pc.if_else(
        spm, joined(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle),
        joined(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))

    def chars(part):
        return pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(part).cast(pa.int64()))

    return pa.record_batch(
        [batch["doc_id"], pa.array(n, pa.int64()), form, chars(prefix), chars(middle), output.cast(pa.string())],
        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def blocks(batch: pa.RecordBatch, most: int = BLOCK_BYTES):
    """The batch in slices whose texts hold at most `most` bytes, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype("i8"))
    at = 0
    while at < len(batch):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def _form(batches):
    for batch in batches:
        for block in blocks(batch):
            yield _form_block(block)


def draw(n: int) -> Column:
    """The n-th group of eight hexadecimal digits of the hash of a document's id, as a number."""
    name = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(name, 256), 8 * n - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text, ...): doc_id, n units, form, prefix_chars, middle_chars, output.

    A null text is an empty one: no units, plain. Documents without doc_id share the draws of an
    empty id. Repeated rows give repeated results, and other columns are ignored. Very long texts
    are blocks of their own; memory is bounded by the longest text. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    rows = docs.select("doc_id", "text", *[draw(k).alias(f"h{k}") for k in (1, 2, 3, 4)])
    return rows.mapInArrow(_form, SCHEMA)


def restored(form="form", output="output") -> Column:
    """The exact text of a formed document."""
    form, output = F.col(form), F.col(output)
    inner = F.substr(output, F.lit(len(PREFIX) + 1))
    psm, spm = F.split(inner, f"{SUFFIX}|{MIDDLE}"), F.split(inner, f"{PREFIX}|{MIDDLE}")
    return (F.when(form == "plain", output)
            .when(form == "psm", F.concat(F.get(psm, F.lit(0)), F.get(psm, F.lit(2)), F.get(psm, F.lit(1))))
            .when(form == "spm", F.concat(F.get(spm, F.lit(1)), F.get(spm, F.lit(2)), F.get(spm, F.lit(0)))))


def digest(formed: DataFrame) -> DataFrame:
    """Formed documents with hashes of the output and of the text rebuilt from it instead of the texts."""
    return formed.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                         F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
