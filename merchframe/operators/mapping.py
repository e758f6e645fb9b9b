"""Column mapping: match client headers to the 39 target columns.

The rule tables are a few dozen constants, so they are literals inside the expressions: nothing is
joined, and a feed's whole mapping is one fold over its header array.
"""

from pyspark.sql import Column, DataFrame, functions as F

from merchframe.functions.text import (
    col, contains_any, normalize_header, or_blank, strip,
)
from merchframe.operators.ordered import join_feed
from merchframe.schema import (
    HEADER_ALIASES, KEYWORD_RULES, SAMPLE_FALSE_WORDS, SAMPLE_TRUE_WORDS, SKIP_LABEL,
    STATUS_WORDS, SUGGESTION_RULES, TARGET_COLUMNS,
)

STATUS = "Status"
PUBLISHED = "Published on online store"


def _norm_py(text: str) -> str:
    """normalize_header for the constant tables."""
    text = "/".join(p.strip() for p in text.lower().replace("_", " ").split("/"))
    return " ".join(text.split())


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


_EXACT = {_norm_py(t): t for t in TARGET_COLUMNS}
_ALIAS = {}
for _target, _names in HEADER_ALIASES.items():
    for _name in _names:
        _ALIAS.setdefault(_norm_py(_name), _target)


def _rules() -> Column:
    """The substring rules as one constant array of struct(words, target)."""
    return F.array(*[
        F.struct(_strings([_norm_py(w) for w in words]).alias("words"), F.lit(target).alias("target"))
        for words, target in KEYWORD_RULES])


def match_exact(header) -> Column:
    """Target with the same normalised name, or NULL."""
    return _lookup(_EXACT, normalize_header(header))


def match_alias(header) -> Column:
    """Target that lists the normalised header as an alias, or NULL."""
    return _lookup(_ALIAS, normalize_header(header))


def _keyword_targets(text: Column) -> Column:
    hits = F.filter(_rules(), lambda r: F.exists(r["words"], lambda w: F.contains(text, w)))
    return F.transform(hits, lambda r: r["target"])


def match_keyword(header) -> Column:
    """Targets of every substring rule that hits, in rule order."""
    return _keyword_targets(normalize_header(header))


def candidates(normalized: Column) -> Column:
    """Targets a normalised header may take, best first.

    A name or alias hit is the only candidate, so that a taken target isn't replaced by a rule.
    """
    named = _lookup({**_ALIAS, **_EXACT}, normalized)
    return F.coalesce(
        F.when(normalized == "", _strings([])),
        F.when(named.isNotNull(), F.array(named)),
        _keyword_targets(normalized))


def take_in_order(choices) -> Column:
    """First free candidate of every header (blank where none), in header order."""
    return F.aggregate(
        col(choices), _strings([]),
        lambda taken, wanted: F.concat(taken, F.array(F.coalesce(F.get(
            F.filter(wanted, lambda t: ~F.array_contains(taken, t)), F.lit(0)), F.lit("")))))


def auto_map(df: DataFrame, headers: str = "headers", out: str = "auto_targets") -> DataFrame:
    """Add the target per header, each target used at most once."""
    normal = df.withColumn("_normal", F.transform(headers, normalize_header))
    return normal.withColumn("_choices", F.transform("_normal", candidates)).withColumn(
        out, take_in_order("_choices")).drop("_normal", "_choices")


def mapping_confidence(client_col, target) -> Column:
    target = or_blank(target)
    same = F.lower(strip(or_blank(client_col))) == F.lower(strip(target))
    return F.when(target.isin("", SKIP_LABEL), "low").when(same, "high").otherwise("medium")


def suggest_fields(header) -> Column:
    """Ranked options for one header; the skip label comes last."""
    text = F.lower(strip(or_blank(header)))
    every = _strings(TARGET_COLUMNS)
    exact = _lookup({t.lower(): t for t in TARGET_COLUMNS}, text)
    chosen = F.when(exact.isNotNull(), F.concat(F.array(exact), F.array_remove(every, exact)))
    for words, targets in SUGGESTION_RULES:
        chosen = chosen.when(contains_any(text, words), _strings(targets))
    return F.concat(chosen.otherwise(every), _strings([SKIP_LABEL]))


def map_feeds(headers: DataFrame) -> DataFrame:
    """Add `targets` (array aligned with `headers`) to one row per feed.

    Columns that hold a status or published flag are forced onto those targets.
    """
    def forced(target, header):
        name = F.lower(strip(header))
        return (F.when((target == STATUS) | (name == "status"), STATUS)
                .when((target == PUBLISHED) | (name == PUBLISHED.lower()), PUBLISHED)
                .otherwise(target))
    return auto_map(headers).withColumn("targets", F.zip_with("auto_targets", "headers", forced))


def mapping_rows(mapped: DataFrame) -> DataFrame:
    """(feed_id, col_idx, client_col, target_field, confidence): one row per header."""
    pairs = F.arrays_zip(F.col("headers").alias("client_col"),
                         F.col("auto_targets").alias("target_field"))
    rows = mapped.select("feed_id", F.posexplode(pairs).alias("col_idx", "m"))
    target = F.nullif(F.col("m.target_field"), F.lit(""))
    return rows.select(
        "feed_id", "col_idx", F.col("m.client_col").alias("client_col"),
        target.alias("target_field"),
        mapping_confidence("m.client_col", target).alias("confidence"))


def field_map(targets) -> Column:
    """map target -> 0-based column index; the first column of a target wins."""
    placed = F.transform(targets, lambda t, i: F.struct(t.alias("target"), i.alias("idx")))

    def add(done, c):
        skip = c["target"].isin("", SKIP_LABEL) | F.exists(done, lambda d: d["target"] == c["target"])
        return F.when(skip, done).otherwise(F.concat(done, F.array(c)))
    start = F.array().cast("array<struct<target:string,idx:int>>")
    return F.map_from_entries(F.aggregate(placed, start, add))


def resolve_field_map(mapped: DataFrame) -> DataFrame:
    return mapped.withColumn("field_map", field_map("targets"))


def given_mapping(mapping: DataFrame, headers: DataFrame) -> DataFrame:
    """One row per feed of a given mapping table, in the form of `map_feeds`.

    `mapping` holds rows (feed_id, col_idx, target_field, constant_value): a column of the client mapped by hand,
    perhaps with one value for all rows. Blank and skipped targets map nothing. Of several columns of one
    target the first one counts, also for its constant; of several rows of one column the smallest target does.
    Adds `targets` (aligned with `headers`) and `constants` (target -> value, for any target). Feeds without
    mapping rows map nothing. Rows beyond a feed's headers are ignored.
    """
    wanted = mapping.where(~or_blank("target_field").isin("", SKIP_LABEL) & (F.col("col_idx") >= 0))
    per_column = wanted.groupBy("feed_id", "col_idx").agg(
        F.min(F.struct("target_field", "constant_value")).alias("m"))
    # Targets are few, so a feed's winners fit one row; candidates are cut down before they are collected.
    first = per_column.select("feed_id", "col_idx", "m.target_field", "m.constant_value").groupBy(
        "feed_id", "target_field").agg(F.min(F.struct("col_idx", "constant_value")).alias("first"))
    known = first.where(F.col("target_field").isin(TARGET_COLUMNS))
    placed = known.groupBy("feed_id").agg(F.map_from_entries(F.collect_list(
        F.struct("first.col_idx", "target_field"))).alias("at"), F.map_from_entries(F.collect_list(F.when(
            F.col("first.constant_value").isNotNull(),
            F.struct("target_field", "first.constant_value")))).alias("constants"))
    out = headers.join(placed, "feed_id", "left")
    targets = F.transform("headers", lambda h, i: or_blank(F.col("at")[i]))
    here = F.map_filter("constants", lambda t, v: F.array_contains("targets", t))
    return out.withColumn("targets", targets).withColumn("constants", F.coalesce(
        here, F.create_map().cast("map<string,string>"))).drop("at")


def require_title(mapped: DataFrame) -> DataFrame:
    """(feed_id, has_title, reason): feeds without a title column can't be generated."""
    has = F.array_contains("targets", "Title")
    return mapped.select("feed_id", has.alias("has_title"), F.when(
        ~has, "At least one column must map to Title before generating.").alias("reason"))


# --- samples and constants --------------------------------------------------------------

def sample_values(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(feed_id, col_idx, client_col, sample): first non-blank value of every column.

    Positions alone are reduced over all cells, in hash tables of one entry a column; texts, which Spark would sort
    to reduce, are only read at the places found.
    """
    cells = rows.select("feed_id", "pos", F.posexplode("cells").alias("col_idx", "cell"))
    places = cells.groupBy("feed_id", "col_idx").agg(
        F.min(F.when(strip("cell") != "", F.col("pos"))).alias("pos")).where("pos IS NOT NULL")
    found = rows.join(places, ["feed_id", "pos"]).select(
        "feed_id", "col_idx", strip(F.get("cells", F.col("col_idx"))).alias("sample"))
    # Rows may share a position; blank cells at the place don't count.
    samples = found.where("sample <> ''").groupBy("feed_id", "col_idx").agg(F.min("sample").alias("sample"))
    names = headers.select("feed_id", F.posexplode("headers").alias("col_idx", "client_col"))
    return names.join(samples, ["feed_id", "col_idx"], "left").select(
        "feed_id", "col_idx", "client_col", or_blank("sample").alias("sample"))


def constant_status(sample) -> Column:
    word = F.lower(strip(or_blank(sample)))
    return F.when(word.isin(STATUS_WORDS), F.initcap(word)).otherwise("Active")


def constant_published(sample) -> Column:
    word = F.lower(strip(or_blank(sample)))
    return F.when(word.isin(SAMPLE_FALSE_WORDS), "FALSE").when(
        word.isin(SAMPLE_TRUE_WORDS), "TRUE").otherwise("TRUE")


def feed_constants(rows: DataFrame, mapped: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(feed_id, constants map target -> value): the one value of Status and Published per feed.

    Only the two flag cells of a row are looked at, and the minimum by position is pre-aggregated. Feeds
    that map neither column take no part in the join.
    """
    at = resolve_field_map(mapped).select(
        "feed_id", F.col("field_map")[STATUS].alias("s"), F.col("field_map")[PUBLISHED].alias("p")).where(
        "s IS NOT NULL OR p IS NOT NULL")
    flags = join_feed(rows, at, blocks).select(
        "feed_id", "pos", "s", "p",
        strip(F.get("cells", F.col("s"))).alias("status"),
        strip(F.get("cells", F.col("p"))).alias("published"))

    def first_filled(c):
        return F.min_by(c, F.when(F.col(c) != "", F.col("pos")))

    samples = flags.groupBy("feed_id", "s", "p").agg(
        first_filled("status").alias("status"), first_filled("published").alias("published"))
    entries = F.array_compact(F.array(
        F.when(F.col("s").isNotNull(),
               F.struct(F.lit(STATUS).alias("k"), constant_status("status").alias("v"))),
        F.when(F.col("p").isNotNull(),
               F.struct(F.lit(PUBLISHED).alias("k"), constant_published("published").alias("v")))))
    return samples.select("feed_id", F.map_from_entries(entries).alias("constants"))
