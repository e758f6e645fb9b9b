"""Removal of repeated and nearly repeated lines by an exact set-similarity join, in SQL functions.

A line's tokens are its distinct lower-cased words, ordered by rarity; runs of a script that is
written without blanks give their overlapping groups of three characters instead. A line goes if an
earlier line (smaller doc_id, then smaller line number) has Jaccard similarity 0.8 or more. Blank
lines have no tokens and always stay.

1. Token counts over all lines, by slots of a hash, give classes of frequency. Any fixed order keeps
   the join exact; a good one keeps prefixes rare.
2. Lines with equal token sets collapse to their first occurrence, aggregated before the shuffle.
   Lines of up to three tokens are similar to equal sets only, so this settles them.
3. Prefix filter: similar lines share one of the first floor(n / 5) + 1 tokens. Candidates must also
   pass the length filter, the positional filter and a parity bitmap, which bounds the symmetric
   difference of two sets from below.
4. Each line first meets lines with one of three sketches like its own: the two smallest, the next two and
   the two largest hashes of its tokens, which near copies mostly share. Of the first and the four preceding
   lines of a sketch the closest is verified. This settles members of large groups with one candidate
   a line instead of all pairs, and takes three rows a line, however large the input. Lines still open
   are joined with all earlier lines on all prefix tokens.
5. Candidates are verified on their whole token sets.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from merchframe.llm.common import settle, small_side

#: Lines of fewer tokens stay where a caller doesn't pass another value.
MIN_TOKENS = 5
#: Sets of fewer tokens have similarity 0.8 with equal sets only.
MIN_JOINED = 4
#: Characters of scripts written without blanks.
_DENSE = "[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}\\p{IsTibetan}\u30fc]"
#: One range without most signs and letters of other scripts: a quick test that all of them pass.
_MAYBE_DENSE = "[\u0e00-\u1fff\u2e80-\U0010ffff]"
#: Slots of the table of token frequencies: a bound on its size.
FREQUENCY_SLOTS = 65_536
#: Lines that a line meets on each of its sketches: the first one and those just before it.
MATES = 5
#: A sketch of more lines is crowded; its lines meet in parts of about PART_LINES.
CROWD, PART_LINES = 10_000, 10_000
#: Hashes of a sketch.
SKETCH = 2

_NO_DOC = "-9223372036854775808L"


def _clean(text: Column) -> Column:
    """Lower-cased text with every white space of a line as a blank."""
    text = F.coalesce(F.lower(text), F.lit(""))
    for c in "\t\r\x0b\x0c":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _keys(docs: DataFrame) -> DataFrame:
    """doc: doc_id, or the largest number where it is null; version tells rows of one doc_id apart."""
    return docs.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), F.xxhash64("text").alias("version"), "text")


def _words(line: Column) -> Column:
    """Words of a cleaned line or text, some of them empty; dense runs as groups of three characters
    (shorter runs as they are)."""
    groups = F.concat(
        F.split(F.regexp_replace(line, f"{_DENSE}+", " "), " "),
        F.regexp_extract_all(line, F.lit(f"(?=({_DENSE}{{3}}))"), F.lit(1)),
        F.regexp_extract_all(line, F.lit(f"(?<!{_DENSE}){_DENSE}{{1,2}}(?!{_DENSE})"), F.lit(0)))
    # A dense character takes three bytes or more, so most lines need no pattern; the scripts of a
    # character are costly to look up.
    dense = (F.octet_length(line) >= F.char_length(line) + 2) & line.rlike(_MAYBE_DENSE) & line.rlike(_DENSE)
    return F.when(dense, groups).otherwise(F.split(line, " "))


def _frequency_classes(docs: DataFrame) -> list[int]:
    """For each slot of the token hashes, 1 plus the base-2 logarithm of the number of its tokens."""
    words = docs.select(F.explode(_words(F.replace(_clean("text"), F.lit("\n"), F.lit(" ")))).alias("w"))
    slot = F.xxhash64("w").bitwiseAND(F.lit(FREQUENCY_SLOTS - 1)).alias("slot")
    classes = [0] * FREQUENCY_SLOTS
    # At most FREQUENCY_SLOTS rows reach the driver.
    for at, n in words.where("w != ''").select(slot).groupBy("slot").count().collect():
        classes[at] = n.bit_length()
    return classes


def _tokens(line: Column, classes: Column) -> Column:
    """Distinct tokens as numbers that sort by rarity: frequency class above 57 bits of a hash."""
    hashes = F.transform(F.array_remove(_words(line), ""), lambda w: F.xxhash64(w))

    def numbered(h):
        slot = h.bitwiseAND(F.lit(FREQUENCY_SLOTS - 1)).cast("int")
        rarity = F.ascii(F.substring(classes, slot + 1, F.lit(1)).cast("string")).cast("long")
        return F.shiftleft(rarity, 57).bitwiseOR(h.bitwiseAND(F.lit((1 << 57) - 1)))

    return F.sort_array(F.transform(F.array_distinct(hashes), numbered))


def _table(classes: list[int]) -> Column:
    """The classes as a binary literal of a byte for each slot, so that plans stay small in the driver."""
    return F.lit(bytearray(classes))


def _bitmap(odd: int) -> Column:
    return F.expr(f"aggregate(tokens, 0L, (a, t) -> IF((t & 1) = {odd}, a ^ shiftleft(1L, CAST((t >> 1) & 63 AS INT)), a))")


def _occurrences(docs: DataFrame, classes: list[int], least: int) -> DataFrame:
    """Every compared line: position, 128-bit key of its token set, size, prefix and bitmaps."""
    lines = _keys(docs).select("doc", "version", F.posexplode(F.split(_clean("text"), "\n")).alias("line", "words"))
    sets = lines.select("doc", "version", "line", _tokens(F.col("words"), _table(classes)).alias("tokens")).withColumn(
        "size", F.size("tokens")).where(F.col("size") >= max(least, 1))
    hashes = F.array_sort(F.transform("tokens", lambda t: t.bitwiseAND(F.lit((1 << 57) - 1))))
    sets = sets.withColumn("hashes", F.when(F.col("size") >= MIN_JOINED, hashes))
    return sets.select(
        "doc", "version", "line", F.xxhash64("tokens").alias("k1"), F.xxhash64(F.lit(1), "tokens").alias("k2"), "size",
        F.transform(F.slice("tokens", 1, F.when(F.col("size") < MIN_JOINED, 0).otherwise(
            F.floor(F.col("size") / 5).cast("int") + 1)), lambda t: t.bitwiseAND(F.lit(2**31 - 1)).cast("int")).alias("prefix"),
        _bitmap(0).alias("b0"), _bitmap(1).alias("b1"),
        F.array(*[F.hash(F.slice("hashes", at, SKETCH)) for at in (1, 1 + SKETCH, -SKETCH)]).alias("sketches"))


#: Least symmetric difference of x and y by their bitmaps.
_APART = "(bit_count(x.b0 ^ y.b0) + bit_count(x.b1 ^ y.b1))"
#: What sizes and bitmaps let pass; then what the places of a shared prefix token do.
_NEAR = f"5 * least(x.size, y.size) >= 4 * greatest(x.size, y.size) AND 9 * {_APART} <= x.size + y.size"
_PLACED = "9 * (1 + least(x.size - x.place DIV 2 - 1, y.size - y.place DIV 2 - 1)) >= 4 * (x.size + y.size)"


def _met(firsts: DataFrame) -> DataFrame:
    """A row for each sketch of a line: which of the three, its hash, and the part in which the line meets others."""
    posts = firsts.where(F.col("size") >= MIN_JOINED).select(
        "k1", "doc", "line", "size", "b0", "b1", F.posexplode("sketches").alias("which", "sketch"))
    counts = posts.groupBy("which", "sketch").agg(F.count(F.lit(1)).alias("n"))  # before the shuffle as well
    crowds = settle(counts.where(F.col("n") > CROWD).select(
        "which", "sketch", F.ceil(F.col("n") / PART_LINES).alias("parts")), "line-crowds")
    return posts.join(small_side(crowds), ["which", "sketch"], "left").withColumn(
        "part", F.pmod(F.xxhash64("doc"), F.coalesce("parts", F.lit(1))))


def _closest(firsts: DataFrame) -> DataFrame:
    """Pairs (x, y): for each line the closest of the lines that it meets on its sketches, if any."""
    w = W.partitionBy("which", "sketch", "part").orderBy("doc", "line", "k1")
    x = F.struct("k1", "size", "b0", "b1")
    met = _met(firsts).select(x.alias("x"), F.first(x).over(w).alias("y0"),
                              *[F.lag(x, k).over(w).alias(f"y{k}") for k in range(1, MATES)])

    def candidate(y):
        ok, apart = (e.replace("y.", y + ".") for e in (_NEAR, _APART))
        return F.expr(f"CASE WHEN {y}.k1 != x.k1 AND {ok} THEN struct({apart} AS apart, {y}.k1 AS k1) END")

    met = met.select(F.col("x.k1").alias("x"), F.least(*[candidate(f"y{k}") for k in range(MATES)]).alias("y"))
    return met.where("y IS NOT NULL").groupBy("x").agg(F.min_by("y.k1", "y.apart").alias("y"))


def _verified(pairs: DataFrame, firsts: DataFrame, docs: DataFrame, classes: list[int]) -> DataFrame:
    """Keys of lines x that have an earlier line y among the pairs (x, y) with similarity 0.8."""
    pairs = settle(pairs, "line-pairs")
    wanted = pairs.select(F.col("x").alias("k1")).union(pairs.select("y")).distinct()
    places = settle(firsts.join(wanted, "k1").select("k1", "k2", "doc", "version", "line"), "line-places")
    every = _keys(docs).select("doc", "version", F.posexplode(F.split(_clean("text"), "\n")).alias("line", "words"))
    lines = every.join(small_side(places), ["doc", "version", "line"]).select(
        "k1", "k2", "doc", "version", "line", _tokens(F.col("words"), _table(classes)).alias("tokens"))
    # Repeated rows give a line twice.
    lines = settle(lines.dropDuplicates(["k1", "k2"]), "line-tokens")
    x = lines.select(F.col("k1").alias("x"), F.col("k2").alias("x2"), F.struct("doc", "version", "line").alias("px"),
                     F.col("tokens").alias("tx"))
    y = lines.select(F.col("k1").alias("y"), F.struct("doc", "version", "line").alias("py"), F.col("tokens").alias("ty"))
    return (pairs.join(x, "x").join(y, "y").where("py < px")
            .where("9 * size(array_intersect(tx, ty)) >= 4 * (size(tx) + size(ty))").select("x", "x2").distinct())


def repeated_lines(docs: DataFrame, least: int = MIN_TOKENS) -> DataFrame:
    """Lines of `docs` (doc_id, text, ...) that have an earlier similar one: doc, version, lines.

    `lines` is the sorted array of line numbers (from 0) of a row; doc stands for doc_id (largest
    number if null) and version is a hash of the text. Lines of fewer than `least` tokens and blank
    lines never count. Rows equal in doc_id and text share their lines' positions, so they keep or lose
    the same lines; among versions of one doc_id the smaller hash is earlier.
    """
    classes = _frequency_classes(docs)
    seen = settle(_occurrences(docs, classes, least), "line-sets")
    firsts = settle(
        seen.groupBy("k1", "k2").agg(F.min(F.struct("doc", "version", "line", "size", "prefix", "b0", "b1", "sketches")).alias("f"),
                                     F.count(F.lit(1)).alias("n")).select("k1", "k2", "n", "f.*"), "line-firsts")
    found = settle(_verified(_closest(firsts), firsts, docs, classes), "lines-found")
    # Lines still open against all earlier ones. Both sides use the same columns, so that one
    # exchange of the postings serves both; `place` tells a token's place in the prefix and, if odd,
    # that its line is open; what is asked of it is the same for both sides.
    marked = firsts.join(found.select(F.col("x").alias("k1"), F.col("x2").alias("k2"), F.lit(True).alias("done")),
                         ["k1", "k2"], "left")
    posts = marked.select("k1", "doc", "size", "b0", "b1", F.col("done").isNull().alias("open"),
                          F.posexplode("prefix").alias("at", "token"))
    posts = posts.select("token", "k1", "doc", "size", "b0", "b1", (2 * F.col("at") + F.col("open").cast("int")).alias("place"))
    pairs = posts.alias("x").join(posts.alias("y"), F.expr(
        f"""x.token = y.token AND IF(x.place % 2 = 1, x.doc, {_NO_DOC}) >= y.doc
            AND x.doc >= IF(y.place % 2 = 1, y.doc, {_NO_DOC}) AND x.k1 != y.k1 AND {_NEAR} AND {_PLACED}""")).select(
        F.col("x.k1").alias("x"), F.col("y.k1").alias("y")).distinct()
    rest = _verified(pairs, firsts, docs, classes)
    similar = found.union(rest).select(F.col("x").alias("k1"), F.col("x2").alias("k2"), F.lit(True).alias("similar")).distinct()
    first = firsts.join(similar, ["k1", "k2"], "left").where("similar OR n > 1").select(
        "k1", "k2", "similar", F.struct("doc", "version", "line").alias("first"))
    gone = seen.select("k1", "k2", "doc", "version", "line").join(first, ["k1", "k2"]).where(
        F.col("similar") | (F.col("first") != F.struct("doc", "version", "line")))
    return gone.groupBy("doc", "version").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def dedup_lines(docs: DataFrame, least: int = MIN_TOKENS) -> DataFrame:
    """`docs` without repeated lines of `least` tokens or more: text holds the lines that stay, n_chars
    (if a column) its length, n_removed counts the lines that went (in place of a column of that name). Every
    row stays, also one that loses all its lines; a null text stays null. Other columns may have any name."""
    gone = settle(repeated_lines(docs, least), "repeated-lines")
    taken = {c.lower() for c in docs.columns}

    def free(name):
        while name in taken:
            name += "_"
        return name

    doc, version, numbers = free("_doc"), free("_version"), free("_lines")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(numbers, i)), "\n")
    out = (docs.withColumns({doc: F.coalesce("doc_id", F.lit(2**63 - 1)), version: F.xxhash64("text")})
           .join(small_side(gone.select(F.col("doc").alias(doc), F.col("version").alias(version),
                                        F.col("lines").alias(numbers))), [doc, version], "left"))
    out = out.withColumn("text", F.when(F.col(numbers).isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(numbers).isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast("long")))
    return out.select(*[c for c in docs.columns if c.lower() != "n_removed"],
                      F.coalesce(F.size(numbers), F.lit(0)).alias("n_removed"))
