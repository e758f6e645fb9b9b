"""One-permutation MinHash fingerprints in SQL functions.

The 64-bit hashes of a text's 5-word shingles fall into 256 bins by their upper byte; each bin keeps
its smallest hash. Empty bins copy a full one by optimal densification: bin b tries the bins that a
hash of (b, attempt) names, the same for all texts, until one is full. The lower byte of each bin is
stored. Two fingerprints agree by chance in 1 of 256 bins, which the likeness corrects.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from merchframe.llm.common import shuffle_partitions

BINS, BITS = 256, 8
SHINGLE_WORDS = 5
#: Attempts made one by one; bins still empty then take the full bin of least hash (b, bin).
ATTEMPTS = 8
#: Ranges of doc_id, at most; their bounds reach the driver.
MAX_RANGES = 1024
_LOW = (1 << 56) - 1


def with_fingerprint(df: DataFrame, text: str, to: str) -> DataFrame:
    """`df` with the binary column `to`: 256 bytes, or none for a text without words (or null)."""
    clean = F.coalesce(F.lower(text), F.lit(""))
    for c in "\n\t\r\x0b\x0c":
        clean = F.replace(clean, F.lit(c), F.lit(" "))
    kept = df.columns
    df = df.withColumn("_words", F.array_remove(F.split(clean, " "), ""))
    width = F.least(F.size("_words"), F.lit(SHINGLE_WORDS))
    # Missing words of a short text are null, which the hash passes over.
    hashes = F.expr("transform(sequence(0, greatest(size(_words) - %d, 0)), i -> xxhash64(%s))" % (
        SHINGLE_WORDS, ", ".join(f"get(_words, i + {k})" for k in range(SHINGLE_WORDS))))
    empty = F.expr(f"transform(sequence(0, {BINS - 1}), b -> shiftleft(CAST(b AS BIGINT), 56) | {_LOW})")
    df = df.select(*kept, width.alias("_n"), F.sort_array(F.concat(hashes, empty)).alias("_sorted"))
    # The first hash of every bin; of an empty bin that is the mark for empty. Bins in order of their
    # signed upper byte.
    df = df.select(*kept, "_n", F.expr(
        "filter(_sorted, (h, i) -> i = 0 OR shiftright(h, 56) != shiftright(_sorted[i - 1], 56))").alias("_bins"))
    df = df.withColumn("_full", F.expr(f"transform(_bins, h -> (h & {_LOW}) != {_LOW})"))
    df = df.withColumn("_filled", F.expr(f"filter(sequence(0, {BINS - 1}), b -> _full[b])"))
    tries = f"filter(sequence(1, {ATTEMPTS}), a -> _full[CAST(xxhash64(b, a) & {BINS - 1} AS INT)])"
    least = "array_min(transform(_filled, f -> named_struct('h', xxhash64(b, 0, f), 'f', f))).f"
    hit = f"get(transform({tries}, a -> CAST(xxhash64(b, a) & {BINS - 1} AS INT)), 0)"
    place = f"CASE WHEN _full[b] THEN b ELSE coalesce({hit}, {least}) END"
    bytes_ = F.expr(f"transform(sequence(0, {BINS - 1}), b -> substring(hex(_bins[{place}]), -2, 2))")
    packed = F.unhex(F.array_join(F.transform(bytes_, lambda h: F.lpad(h, 2, "0")), ""))
    return df.select(*kept, F.when(F.col("_n") > 0, packed).otherwise(F.unhex(F.lit(""))).alias(to))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1. Two texts without words are alike,
    one without words is unlike any other."""
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))))
    chance = 1.0 / (1 << BITS)
    estimate = F.greatest((same / BINS - chance) / (1 - chance), F.lit(0.0))
    return F.when((F.octet_length(a) == 0) | (F.octet_length(b) == 0), (a == b).cast("double")).otherwise(estimate)


def _with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`docs` with next_<column>: that of the next row by falling doc_id, of the first for the last.

    Rows are dealt into ranges of doc_id. The head of a range is also dealt to the range before it,
    so every row finds its successor within one range. Equal doc_ids go by text hash.
    """
    spark = docs.sparkSession
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    n = max(1, min(MAX_RANGES, 2 * shuffle_partitions(spark)))
    ids = docs.select(key.alias("key"))
    bounds = ids.agg(F.percentile_approx("key", [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0] or []
    bounds = sorted(set(bounds))
    literal = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    in_range = F.size(F.filter(literal, lambda b: b <= F.col("key")))
    heads = {r["range"]: r["head"] for r in ids.withColumn("range", in_range).groupBy("range").agg(
        F.max("key").alias("head")).collect()}
    if not heads:
        return docs.select("*", *[F.lit(None).cast(docs.schema[c].dataType).alias("next_" + c) for c in columns])
    falling = sorted(heads, reverse=True)
    before = {r: falling[k - 1] for k, r in enumerate(falling)}  # the first range follows the last
    table = {k: F.array(*[F.lit(v.get(r)).cast("long") for r in range(len(bounds) + 1)]) for k, v in (("head", heads), ("before", before))}
    dealt = docs.withColumn("key", key).withColumn("range", in_range.cast("long"))
    is_head = F.get(table["head"], F.col("range").cast("int")) == F.col("key")
    dealt = dealt.withColumn("deal", F.explode(F.when(is_head, F.array(
        F.struct(F.col("range").alias("to"), F.lit(0).alias("copy")),
        F.struct(F.get(table["before"], F.col("range").cast("int")).alias("to"), F.lit(1).alias("copy")))).otherwise(
        F.array(F.struct(F.col("range").alias("to"), F.lit(0).alias("copy"))))))
    w = W.partitionBy("deal.to").orderBy("deal.copy", F.desc("key"), "_hash")
    out = dealt.withColumn("_hash", F.xxhash64("text")).select(
        *docs.columns, "deal", *[F.lead(c).over(w).alias("next_" + c) for c in columns])
    return out.where("deal.copy = 0").drop("deal")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text, ...): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint (hex), near_edited, near_next.

    The edited text ends with the first floor(n_chars / 3) code points of the next document (falling
    doc_id, nulls last, then the first again) in place of its own last ones. A null text is empty; a
    text without words has an empty fingerprint.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = with_fingerprint(texts, "text", "print")
    pairs = _with_next(own, ["text", "print"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = pairs.select("doc_id", n.cast("long").alias("n_chars"), "print", "next_print", F.concat(
        F.substr("text", F.lit(1), n - third), F.substr("next_text", F.lit(1), third)).alias("edited"))
    both = with_fingerprint(edited, "edited", "edited_print")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.lower(F.hex("print")).alias("fingerprint"),
        F.lower(F.hex("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"))
