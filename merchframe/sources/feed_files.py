"""Feed files: route by suffix, choose delimiter and encoding, read rows without a header.

A quoted cell may hold line breaks, so a line of a file isn't always a record. Whether a line begins inside
quotes depends on all lines above it, which may be in other splits. Each line therefore gets a transfer map: the
state that it leaves (0 outside quotes, 1 inside) for either state that it may begin in. Maps compose, so splits
are read in parallel: the maps of a split's lines give the split's own map, a running
composition over the splits of a file gives the state in which each begins, and only then lines are put together.
Splits without such lines are parsed as they are, without a shuffle.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from merchframe.functions.urls import suffix
from merchframe.schema import DELIMITERS, FEED_SUFFIXES
from merchframe.session import settle

BAD_SUFFIX = "Unsupported file type. Please use .csv, .xlsx, or .xls"
# Quoted text of a line, also where the quotes close on a later line only.
_QUOTED = '"[^"]*("|$)'
# Row numbers within a partition are the low bits of Spark's increasing ids.
_ROW_BITS = 33


def route_by_suffix(files: DataFrame, path: str = "path") -> DataFrame:
    """Add `format` (csv, excel or NULL) and `reject_reason` to a table of paths."""
    kind = F.create_map(*[F.lit(x) for pair in FEED_SUFFIXES.items() for x in pair])[suffix(path)]
    return files.withColumn("format", kind).withColumn(
        "reject_reason", F.when(kind.isNull(), BAD_SUFFIX))


# --- dialects ---------------------------------------------------------------------------

def _lines(spark: SparkSession, paths) -> DataFrame:
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("feed_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), "value")


def file_dialects(spark: SparkSession, paths) -> DataFrame:
    """(feed_id, delimiter, valid_utf8) from all lines of every file, in one scan.

    The delimiter whose count per line is steadiest wins; ties go to the higher count, then to
    the fixed order. Files without any candidate read as comma-separated. Counts are summed up
    before the shuffle, so what moves is a row for each file, delimiter and count.
    """
    texts = _lines(spark, paths).select(
        "feed_id", F.regexp_replace("value", _QUOTED, "").alias("text"), F.is_valid_utf8("value").alias("valid"))
    hits = texts.select("feed_id", "valid", (F.col("text") != "").alias("filled"), F.posexplode(F.array(*[
        F.length("text") - F.length(F.replace("text", F.lit(d), F.lit(""))) for d in DELIMITERS
    ])).alias("rank", "hits"))
    lines = hits.groupBy("feed_id", "rank", "hits").agg(
        F.count_if("filled").alias("lines"), F.bool_and("valid").alias("valid"))
    usual = lines.groupBy("feed_id", "rank").agg(
        F.max_by("hits", F.struct("lines", "hits")).alias("usual"),
        F.max("lines").alias("steady"), F.bool_and("valid").alias("valid"))
    best = usual.groupBy("feed_id").agg(F.max_by("rank", F.struct(
        F.col("usual") > 0, F.when(F.col("usual") > 0, F.col("steady")).otherwise(0),
        F.col("usual"), -F.col("rank"))).alias("rank"), F.bool_and("valid").alias("valid_utf8"))
    return best.select("feed_id", F.get(F.array(*[F.lit(d) for d in DELIMITERS]), F.col("rank")).alias("delimiter"),
                       "valid_utf8")


def sniff_delimiter(spark: SparkSession, paths) -> DataFrame:
    """(feed_id, delimiter) from all lines of every file."""
    return file_dialects(spark, paths).select("feed_id", "delimiter")


# --- quotes -----------------------------------------------------------------------------

def _by_delimiter(delimiter: Column, make) -> Column:
    """`make(d)` for the row's delimiter: one branch of constants per dialect."""
    first, *others = DELIMITERS
    chosen = F.when(delimiter == others[0], make(others[0]))
    for d in others[1:]:
        chosen = chosen.when(delimiter == d, make(d))
    return chosen.otherwise(make(first))


def _field(d: str) -> str:
    """Pattern of a complete field: quoted (text behind the closing quote counts), plain or empty.

    Possessive, so that neither time nor stack grows with anything but the length of the line.
    """
    other = f"[^\\x{ord(d):02x}]"
    return f'(?:"(?:[^"]|"")*+"{other}*+|[^"\\x{ord(d):02x}]{other}*+|)'


def leaves_quotes_open(line: Column, delimiter: Column, inside: bool) -> Column:
    """Whether a line that begins outside or inside quotes ends inside quotes."""
    def pattern(d):
        sep = f"\\x{ord(d):02x}"
        rest = f'(?:{_field(d)}{sep})*+"(?:[^"]|"")*+$'
        if inside:
            return f'(?s)^(?:[^"]|"")*+(?:$|"[^{sep}]*+{sep}{rest})'
        return f"(?s)^{rest}"
    quoted = F.contains(line, F.lit('"'))
    return F.when(quoted, _by_delimiter(delimiter, lambda d: line.rlike(pattern(d)))).otherwise(inside)


def _left_state(order, *keys) -> tuple[Column, Column]:
    """State left behind by a row and all rows before it, begun outside and begun inside quotes.

    Rows hold their transfer maps as columns `from_out` and `from_in` (0 or 1). A map either forgets its state
    (equal columns), keeps it or flips it; so the last forgetting row and the flips since then tell the state.
    """
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    flips = F.sum(F.when((F.col("from_out") == 1) & (F.col("from_in") == 0), 1).otherwise(0)).over(w)
    forgets = F.col("from_out") == F.col("from_in")
    known = F.last(F.when(forgets, F.struct(F.col("from_out").alias("state"), flips.alias("flips"))),
                   ignorenulls=True).over(w)

    def begun(state):
        return F.when(known.isNull(), (state + flips) % 2).otherwise(
            (known["state"] + flips - known["flips"]) % 2).cast("int")
    return begun(0), begun(1)


def split_states(lines: DataFrame) -> DataFrame:
    """Splits that a quoted line break touches: (feed_id, block, owner, lead_to).

    `lines` has feed_id, block, pos, from_out, from_in. Lines of a split up to position `lead_to` end a
    record that an earlier split, the `owner`, began; a split may consist of such lines only.
    """
    turns = lines.where("from_out = 1 OR from_in = 0").select("feed_id", "block", "pos", "from_out", "from_in")
    out, into = _left_state("pos", "feed_id", "block")
    left = turns.withColumns({"out": out, "into": into})
    maps = left.groupBy("feed_id", "block").agg(
        F.max_by("out", "pos").alias("from_out"), F.max_by("into", "pos").alias("from_in"),
        F.min(F.when(F.col("from_in") == 0, F.col("pos"))).alias("closes"))
    blocks = lines.select("feed_id", "block").distinct().join(maps, ["feed_id", "block"], "left").withColumns({
        "turns": F.col("from_out").isNotNull(),
        "from_out": F.coalesce("from_out", F.lit(0)), "from_in": F.coalesce("from_in", F.lit(1))})
    # One row per split of a file, so these windows stay small.
    after, _ = _left_state("block", "feed_id")
    in_order = W.partitionBy("feed_id").orderBy("block")
    states = blocks.withColumn("after", after).withColumn(
        "inside", F.coalesce(F.lag("after").over(in_order), F.lit(0)) == 1)
    swallowed = F.col("inside") & F.col("closes").isNull()
    owner = F.last(F.when(~swallowed, F.col("block")), ignorenulls=True).over(
        in_order.rowsBetween(W.unboundedPreceding, -1))
    return states.select(
        "feed_id", "block", owner.alias("owner"),
        F.when(F.col("inside"), F.coalesce("closes", F.lit(2**63 - 1))).otherwise(-1).alias("lead_to"),
        (F.col("turns") | F.col("inside")).alias("touched")).where("touched").drop("touched")


# --- records ----------------------------------------------------------------------------

def landed_lines(spark: SparkSession, paths) -> DataFrame:
    """(feed_id, delimiter, block, pos, line, from_out, from_in): decoded lines with their transfer maps.

    `pos` is where the line's split begins plus the line's row in its partition. A partition holds no more
    bytes than a split may have and a line takes at least one, so positions increase down a file and are unique.
    """
    dialects = settle(file_dialects(spark, paths), "dialects")
    text = F.when(F.col("valid_utf8"), F.col("value")).otherwise(
        F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    lines = _lines(spark, paths).join(dialects, "feed_id").select(
        "feed_id", "delimiter", "block",
        (F.col("block") + F.col("seq").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).alias("pos"), text.alias("line"))
    return settle(lines.withColumns({
        "from_out": leaves_quotes_open(F.col("line"), F.col("delimiter"), False).cast("int"),
        "from_in": leaves_quotes_open(F.col("line"), F.col("delimiter"), True).cast("int")}), "lines")


def whole_records(lines: DataFrame) -> DataFrame:
    """(feed_id, delimiter, pos, record): lines put together where quotes hold line breaks.

    Only the splits that such quotes touch are shuffled, by split; a record of several splits moves to the one
    that it begins in. Quotes that never close take the rest of their file into one record.
    """
    touched = settle(split_states(lines), "split-states")
    plain = lines.join(touched.select("feed_id", "block"), ["feed_id", "block"], "left_anti").select(
        "feed_id", "delimiter", "pos", F.col("line").alias("record"))
    home = F.when(F.col("pos") <= F.col("lead_to"), F.col("owner")).otherwise(F.col("block"))
    moved = lines.join(touched, ["feed_id", "block"]).withColumn("home", home)
    after, _ = _left_state("pos", "feed_id", "home")
    in_order = W.partitionBy("feed_id", "home").orderBy("pos")
    states = moved.withColumn("after", after)
    begins = F.coalesce(F.lag("after").over(in_order), F.lit(0)) == 0
    numbered = states.withColumn("begins", begins).withColumn("number", F.sum(F.col("begins").cast("int")).over(
        in_order.rowsBetween(W.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("pos", "line")))
    joined = numbered.groupBy("feed_id", "home", "number").agg(
        F.first("delimiter").alias("delimiter"), F.min("pos").alias("pos"), parts.alias("parts"),
        F.max_by("after", "pos").alias("open"))
    text = F.array_join(F.transform("parts", lambda p: p["line"]), "\n")
    return plain.unionByName(joined.select(
        "feed_id", "delimiter", "pos",
        F.when(F.col("open") == 1, F.concat(text, F.lit('"'))).otherwise(text).alias("record")))


def record_cells(record: Column, delimiter: Column) -> Column:
    """Cells of a record; quotes around a cell go, doubled ones inside become one. An empty line has no cells."""
    def unquoted(cell):
        quoted = '(?s)^"((?:[^"]|"")*+)"(.*)$'
        inner = F.replace(F.regexp_extract(cell, quoted, 1), F.lit('""'), F.lit('"'))
        return F.when(cell.startswith('"'), F.concat(inner, F.regexp_extract(cell, quoted, 2))).otherwise(cell)

    def split(d):
        sep = f"\\x{ord(d):02x}"
        fields = F.regexp_extract_all(F.concat(record, F.lit(d)), F.lit(f"(?s)\\G({_field(d)}){sep}"), F.lit(1))
        return F.when(F.contains(record, F.lit('"')), F.transform(fields, unquoted)).otherwise(
            F.split(record, sep, -1))
    return F.when(record == "", F.array().cast("array<string>")).otherwise(_by_delimiter(delimiter, split))


def scan_feed_csv(spark: SparkSession, paths) -> DataFrame:
    """`feed_rows` (feed_id, pos, cells) of CSV files: no header is assumed and ragged rows survive.

    All files are one plan whatever their number, delimiter or encoding: the dialect is a column that the
    lines are joined with. Files split over tasks, also where quoted cells hold line breaks (which read as a line
    feed). `pos` increases down each file, with gaps.
    """
    records = whole_records(landed_lines(spark, paths))
    return records.select("feed_id", "pos", record_cells(F.col("record"), F.col("delimiter")).alias("cells"))
