"""Queries on feeds and column mapping."""

from pyspark.sql import Window as W, functions as F

from merchframe import schema as S
from merchframe.functions.text import clean_value, is_header_string, is_nonempty, normalize_header
from merchframe.functions.urls import basename
from merchframe.operators import feeds, images, mapping
from merchframe.plans import inputs as I
from merchframe.plans.registry import register
from merchframe.plans.sql import (
    BRAND_NO, clean, generated, lit, options, pick, raw_feed, source, sql_list, strip,
)
from merchframe.session import shared_folder
from merchframe.sources import feed_files

SEP = "|"


def joined(c, sep=SEP):
    return F.array_join(c, sep)


def _cells(spark, sf):
    return I.supplier_feeds(spark, sf).select("feed_id", "pos", F.posexplode("cells").alias("i", "cell"))


CELLS_SQL = f"""WITH raw AS ({raw_feed()}), c AS (
  SELECT feed_id, pos, CAST(generate_subscripts(cells, 1) - 1 AS INTEGER) AS i, unnest(cells) AS cell FROM raw)"""
NUM_SQL = r"'^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$'"
HEAD_SQL = f"CASE WHEN {BRAND_NO} % 2 = 1 THEN {{odd}} ELSE {{even}} END"


# --- files ------------------------------------------------------------------------------

def scan_feed_csv(spark, sf):
    folder = I.write_csv_files(spark, sf, shared_folder(spark, "feeds"))
    rows = feed_files.scan_feed_csv(spark, folder)
    feed = F.regexp_extract("feed_id", "feed=([^/]+)/", 1)
    # Chunked feeds are small, so this check may number their rows.
    return rows.select(
        feed.alias("feed"), F.row_number().over(W.partitionBy("feed_id").orderBy("pos")).alias("row_no"),
        F.size("cells").alias("n_cells"), joined("cells", "~").alias("cells"))


_FEED_SQL = f"'b' || {BRAND_NO} || '-' || (p_partkey // {I.FEED_CHUNK})"
_SEP_SQL = f"([',', chr(9), '|', ';'])[{BRAND_NO} % 4 + 1]"
register("scan_feed_csv", scan_feed_csv, f"""
WITH r AS (
  SELECT {_FEED_SQL} AS feed, p_partkey + 2 AS pos,
    [p_name || {_SEP_SQL} || ' "x"', p_type, printf('%.2f', p_retailprice), CAST(p_size AS VARCHAR)]
    || CASE WHEN p_partkey % 6 = 0 THEN [] ELSE ['note' || p_partkey] END AS cells FROM part
  UNION ALL SELECT DISTINCT {_FEED_SQL}, 0, ['Price list'] FROM part
  UNION ALL SELECT DISTINCT {_FEED_SQL}, 1, ['Name', 'Type', 'Price', 'Size', 'Note'] FROM part)
SELECT feed, CAST(row_number() OVER (PARTITION BY feed ORDER BY pos) AS INTEGER) AS row_no,
  CAST(len(cells) AS INTEGER) AS n_cells, array_to_string(cells, '~') AS cells FROM r""")


def quoted_feed_rows(spark, sf):
    folder = I.write_quoted_csv_files(spark, sf, shared_folder(spark, "feeds"))
    return feed_files.scan_feed_csv(spark, folder).withColumn("feed_id", F.regexp_extract("feed_id", "feed=([^/]+)/", 1))


def scan_quoted_csv(spark, sf):
    return quoted_feed_rows(spark, sf).select(
        "feed_id", F.row_number().over(W.partitionBy("feed_id").orderBy("pos")).alias("row_no"),
        F.size("cells").alias("n_cells"), joined("cells", "~").alias("cells"))


QUOTED_NAME_SQL = f"""CASE WHEN p_partkey % 7 = 0 THEN p_name || {_SEP_SQL} || ' "x"' || chr(10) || 'second, line' || chr(10)
  ELSE p_name END"""
register("scan_feed_csv_quoted_breaks", scan_quoted_csv, f"""
WITH r AS (
  SELECT {_FEED_SQL} AS feed_id, p_partkey + 2 AS pos, [{QUOTED_NAME_SQL}, p_type, printf('%.2f', p_retailprice),
    CAST(p_size AS VARCHAR), CASE WHEN p_partkey % 3 = 0 THEN '5" wide' ELSE '' END] AS cells FROM part
  UNION ALL SELECT DISTINCT {_FEED_SQL}, 0, ['Price list'] FROM part
  UNION ALL SELECT DISTINCT {_FEED_SQL}, 1, ['Name', 'Type', 'Price', 'Size', 'Note'] FROM part)
SELECT feed_id, CAST(row_number() OVER (PARTITION BY feed_id ORDER BY pos) AS INTEGER) AS row_no,
  CAST(len(cells) AS INTEGER) AS n_cells, array_to_string(cells, '~') AS cells FROM r""")


def sniff_delimiter(spark, sf):
    folder = I.write_csv_files(spark, sf, shared_folder(spark, "feeds"))
    return feed_files.sniff_delimiter(spark, folder).select(
        F.regexp_extract("feed_id", "feed=([^/]+)/", 1).alias("feed"), "delimiter")


register("sniff_delimiter", sniff_delimiter,
         f"SELECT DISTINCT {_FEED_SQL} AS feed, {_SEP_SQL} AS delimiter FROM part")


def _path_sql(suffixes, folder):
    return (f"'/{folder}/' || replace(p_brand, '#', '') || '/' || replace(p_name, ' ', '_') || "
            f"(p_partkey % 50) || {pick(suffixes, 'p_partkey')}")


register("route_by_suffix", lambda spark, sf: feed_files.route_by_suffix(
    I.file_paths(spark, sf, I.FILE_SUFFIXES, "in")).select("file_id", "format", "reject_reason"), f"""
SELECT p_partkey AS file_id, {pick(['csv', 'excel', 'excel', '?', '?', 'csv'], 'p_partkey')} AS f,
  nullif(f, '?') AS format,
  CASE WHEN f = '?' THEN {lit(feed_files.BAD_SUFFIX)} END AS reject_reason FROM part""".replace(
    "SELECT p_partkey", "SELECT file_id, format, reject_reason FROM (SELECT p_partkey") + ")")

_PICTURES = ["t"] * 7 + ["f"] * 2
register("image_inventory", lambda spark, sf: images.image_inventory(
    I.file_paths(spark, sf, I.PICTURE_SUFFIXES, "img")).select("path", "file_id"), f"""
SELECT {_path_sql(I.PICTURE_SUFFIXES, 'img')} AS path, p_partkey AS file_id FROM part
WHERE p_partkey % 9 < 7 ORDER BY path""")

_PLAN_SQL = f"""p AS (SELECT p_partkey AS file_id, {_path_sql(I.PICTURE_SUFFIXES, 'img')} AS path,
  p_partkey % 9 < 7 AS supported,
  CASE WHEN p_partkey % 9 < 7 THEN replace(p_name, ' ', '_') || (p_partkey % 50) || '.jpg' END AS out_name FROM part)"""


def image_plan(spark, sf):
    return images.image_plan(I.file_paths(spark, sf, I.PICTURE_SUFFIXES, "img"), "jpg")


register("image_plan", image_plan, f"""WITH {_PLAN_SQL}
SELECT path, supported, out_name,
  supported AND count(*) OVER (PARTITION BY out_name) > 1 AS collides FROM p""")
register("image_plan_totals", lambda spark, sf: images.image_plan_totals(image_plan(spark, sf)), f"""
WITH {_PLAN_SQL} SELECT count(*) FILTER (supported) AS converted,
  count(*) FILTER (NOT supported) AS skipped FROM p""")

_SHEETS = "[" + ", ".join(sql_list(n) for n in I.SHEET_NAMES) + "]"
_PREF = " ".join(f"WHEN contains(l, {lit(k)}) THEN {i}" for i, k in enumerate(S.PREFERRED_SHEETS, 1))
_SKIP = " OR ".join(f"contains(l, {lit(k)})" for k in S.SKIPPED_SHEETS)
register("select_sheet", lambda spark, sf: feeds.select_sheet(I.workbooks(spark, sf)), f"""
WITH s AS (SELECT 'book-' || (p_partkey // 40) AS feed_id, CAST(p_partkey % 4 AS INTEGER) AS sheet_idx,
    ({_SHEETS})[(p_partkey // 40) % {len(I.SHEET_NAMES)} + 1][p_partkey % 4 + 1] AS sheet,
    p_size % 4 + 2 AS width, p_size % 5 <> 0 AS filled FROM part),
g AS (SELECT feed_id, sheet_idx, sheet, lower(sheet) AS l, max(width) AS cols,
        count(*) FILTER (filled) AS n FROM s GROUP BY ALL),
r AS (SELECT *, CASE WHEN contains(l, 'raw merged') THEN 0 {_PREF} ELSE 99 END AS pref, ({_SKIP}) AS skip FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY pref,
        CASE WHEN pref = 99 THEN skip END, CASE WHEN pref = 99 THEN n < 2 END,
        CASE WHEN pref = 99 THEN -cols END, CASE WHEN pref = 99 THEN -n END, sheet_idx) AS rn FROM r)
SELECT feed_id, sheet, sheet_idx FROM o WHERE rn = 1""")

# --- cells and headers ------------------------------------------------------------------

register("clean_value", lambda spark, sf: _cells(spark, sf).select(
    "feed_id", "pos", "i", clean_value("cell").alias("value")),
    f"{CELLS_SQL} SELECT feed_id, pos, i, {clean('cell')} AS value FROM c")
register("is_nonempty", lambda spark, sf: _cells(spark, sf).select(
    "feed_id", "pos", "i", is_nonempty("cell").alias("filled")),
    f"{CELLS_SQL} SELECT feed_id, pos, i, {clean('cell')} <> '' AS filled FROM c")
_IS_HEAD = f"({clean('cell')} <> '' AND NOT regexp_matches(replace({clean('cell')}, ',', ''), {NUM_SQL}))"
register("is_header_string", lambda spark, sf: _cells(spark, sf).select(
    "feed_id", "pos", "i", is_header_string("cell").alias("is_header")),
    f"{CELLS_SQL} SELECT feed_id, pos, i, {_IS_HEAD} AS is_header FROM c")

_DETECT_SQL = f"""{CELLS_SQL}, w AS (SELECT feed_id, max(len(cells)) AS width FROM raw GROUP BY feed_id),
t AS (SELECT feed_id, pos FROM (SELECT feed_id, pos, row_number() OVER (PARTITION BY feed_id ORDER BY pos) AS rn
      FROM raw) WHERE rn <= 10),
ok AS (SELECT c.feed_id, c.pos FROM c JOIN t USING (feed_id, pos) JOIN w USING (feed_id)
       GROUP BY c.feed_id, c.pos, width HAVING count(*) FILTER ({_IS_HEAD}) / width >= 0.5),
d AS (SELECT w.feed_id, coalesce(min(ok.pos), 0) AS header_pos, CAST(width AS INTEGER) AS width
      FROM w LEFT JOIN ok USING (feed_id) GROUP BY w.feed_id, width)"""
register("detect_header", lambda spark, sf: feeds.detect_header(I.supplier_feeds(spark, sf)).select(
    "feed_id", "header_pos", "width"), f"{_DETECT_SQL} SELECT * FROM d")
register("apply_header", lambda spark, sf: feeds.apply_header(
    I.supplier_feeds(spark, sf), feeds.detect_header(I.supplier_feeds(spark, sf))).select(
    "feed_id", "pos", joined("header_cells").alias("header"),
    joined(feeds.padded(F.col("cells"), F.col("width"))).alias("cells")), f"""
WITH raw AS ({raw_feed()}), h AS (SELECT feed_id, pos AS header_pos, cells AS header FROM raw
  WHERE pos = CASE WHEN CAST(substr(feed_id, 7) AS INTEGER) % 2 = 1 THEN 2 ELSE 1 END)
SELECT feed_id, pos, array_to_string(header, '|') AS header,
  array_to_string(list_transform(range(1, 13), lambda i: coalesce(cells[i], '')), '|') AS cells
FROM raw JOIN h USING (feed_id) WHERE pos > header_pos""")


def _names(spark, sf):
    raw = feeds.detect_header(I.supplier_feeds(spark, sf)).withColumn(
        "raw", feeds.header_names(F.col("header_cells")))
    return raw.select("feed_id", F.posexplode(feeds.unique_headers(F.col("raw"))).alias("i", "u")).select(
        "feed_id", "i", "u.name")


def _unique(names):
    seen, out = {}, []
    for i, n in enumerate(names):
        n = n or f"Column_{i + 1}"
        seen[n] = seen.get(n, -1) + 1
        out.append(n if seen[n] == 0 else f"{n}_{seen[n]}")
    return out


_ODD, _EVEN = _unique(I.HEADERS_ODD), _unique(I.HEADERS_EVEN)
_KEEP = [i for i in range(12) if i != 9]
_ODD_KEPT, _EVEN_KEPT = [_ODD[i] for i in _KEEP], [_EVEN[i] for i in _KEEP]


def _head_list(odd, even):
    return HEAD_SQL.format(odd=sql_list(odd), even=sql_list(even))


register("unique_headers", _names, f"""
WITH h AS (SELECT DISTINCT p_brand AS feed_id, {_head_list(_ODD, _EVEN)} AS names FROM part)
SELECT feed_id, CAST(generate_subscripts(names, 1) - 1 AS INTEGER) AS i, unnest(names) AS name FROM h""")
register("drop_unnamed", lambda spark, sf: feeds.feed_headers(I.supplier_feeds(spark, sf)).select(
    "feed_id", joined("headers").alias("headers"), joined(F.col("keep").cast("array<string>")).alias("keep")), f"""
SELECT DISTINCT p_brand AS feed_id, array_to_string({_head_list(_ODD_KEPT, _EVEN_KEPT)}, '|') AS headers,
  '{"|".join(map(str, _KEEP))}' AS keep FROM part""")


def _normal(spark, sf, continuation=False):
    rows = I.supplier_feeds(spark, sf, continuation)
    return feeds.normalize_feeds(rows)


_SRC_CELLS = "[title, vendor, kind, sizes, colours, price, sku, flag, qty, n1, n2]"
register("drop_blank_rows", lambda spark, sf: _normal(spark, sf).select(
    "feed_id", "pos", joined("cells").alias("cells")),
    f"WITH {source()} SELECT feed_id, pos, array_to_string({_SRC_CELLS}, '|') AS cells FROM src")
register("reject_empty_feed", lambda spark, sf: feeds.reject_empty_feeds(*I.nation_feeds(spark, sf)), """
SELECT 'nation-' || n_nationkey AS feed_id, 'File is empty or has no data rows after cleanup.' AS reason FROM nation
WHERE n_nationkey % 5 = 0 OR n_nationkey NOT IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'region-' || r_name, 'File is empty or has no data rows.' FROM region""")
register("feed_profile", lambda spark, sf: feeds.feed_profile(I.supplier_feeds(spark, sf)).select(
    "feed_id", "row_count", "column_count", joined("headers").alias("headers")), f"""
WITH {source()} SELECT feed_id, count(*) AS row_count, 11 AS column_count,
  array_to_string(CASE WHEN any_value(odd) THEN {sql_list(_ODD_KEPT)} ELSE {sql_list(_EVEN_KEPT)} END, '|') AS headers
FROM src GROUP BY feed_id""")


def preview(kind):
    def run(spark, sf):
        rows = I.supplier_feeds(spark, sf)
        headers = feeds.feed_headers(rows)
        return feeds.preview_rows(feeds.normalize_feeds(rows, headers), headers, kind).select(
            "feed_id", "pos", joined("headers").alias("headers"), joined("cells").alias("cells"))
    return run


_TOP5 = f"""WITH {source()}, t AS (SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY feed_id ORDER BY pos) AS rn FROM src) WHERE rn <= 5)"""
register("preview_rows", preview("upload"), f"""{_TOP5}
SELECT feed_id, pos, array_to_string(CASE WHEN odd THEN {sql_list(_ODD_KEPT)} ELSE {sql_list(_EVEN_KEPT)} END, '|')
  AS headers, array_to_string(list_transform({_SRC_CELLS}, lambda c: substr(c, 1, 40)), '|') AS cells FROM t""")
register("preview_rows_crawl", preview("crawl"), f"""{_TOP5}
SELECT feed_id, pos, CASE WHEN odd THEN 'Title' ELSE 'Price|SKU' END AS headers,
  CASE WHEN odd THEN title ELSE price || '|' || sku END AS cells FROM t""")

# --- mapping ----------------------------------------------------------------------------

_HEADER_SQL = f"""h AS (SELECT p_partkey AS header_id, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' || w ELSE w END AS header
  FROM (SELECT *, {pick(I.HEADER_WORDS, 'p_partkey')} AS w FROM part))"""


def _norm_sql(x):
    t = f"regexp_replace(replace(lower({strip(x)}), '_', ' '), '\\s*/\\s*', '/', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def _values(pairs, cols):
    return "(VALUES " + ", ".join(
        "(" + ", ".join(str(v) if isinstance(v, int) else lit(v) for v in p) + ")" for p in pairs
    ) + f") {cols}"


_TARGETS = _values([(t,) for t in S.TARGET_COLUMNS], "tg(target)")
_ALIASES = _values([(t, a) for t, names in S.HEADER_ALIASES.items() for a in names], "al(target, alias)")
_RULES = _values([(i, w, t) for i, (ws, t) in enumerate(S.KEYWORD_RULES) for w in ws], "kr(rule, word, target)")
_MATCH = f"""{_HEADER_SQL}, n AS (SELECT *, {_norm_sql('header')} AS norm FROM h),
ex AS (SELECT header_id, min(target) AS exact FROM n JOIN {_TARGETS} ON {_norm_sql('target')} = norm GROUP BY header_id),
ali AS (SELECT header_id, min(target) AS alias FROM n JOIN {_ALIASES} ON {_norm_sql('alias')} = norm GROUP BY header_id),
kw AS (SELECT header_id, list(target ORDER BY rule) AS targets FROM (
  SELECT DISTINCT header_id, rule, target FROM n JOIN {_RULES} ON contains(norm, {_norm_sql('word')})) GROUP BY header_id)"""


def _headers(spark, sf):
    return I.header_texts(spark, sf)


register("normalize_header", lambda spark, sf: _headers(spark, sf).select(
    "header_id", normalize_header("header").alias("normal")),
    f"WITH {_MATCH} SELECT header_id, norm AS normal FROM n")
register("match_exact", lambda spark, sf: _headers(spark, sf).select(
    "header_id", mapping.match_exact("header").alias("target")),
    f"WITH {_MATCH} SELECT header_id, exact AS target FROM n LEFT JOIN ex USING (header_id)")
register("match_alias", lambda spark, sf: _headers(spark, sf).select(
    "header_id", mapping.match_alias("header").alias("target")),
    f"WITH {_MATCH} SELECT header_id, alias AS target FROM n LEFT JOIN ali USING (header_id)")
register("match_keyword", lambda spark, sf: _headers(spark, sf).select(
    "header_id", joined(mapping.match_keyword("header")).alias("targets")),
    f"""WITH {_MATCH} SELECT header_id, coalesce(array_to_string(targets, '|'), '') AS targets
    FROM n LEFT JOIN kw USING (header_id)""")


def auto_map(spark, sf):
    mapped = mapping.auto_map(I.header_feeds(spark, sf))
    pairs = F.arrays_zip(F.col("headers").alias("header"), F.col("auto_targets").alias("target"))
    rows = mapped.select("feed_id", F.posexplode(pairs).alias("col_idx", "m"))
    return rows.select("feed_id", "col_idx", "m.header", "m.target",
                       mapping.mapping_confidence("m.header", "m.target").alias("confidence"))


register("auto_map", auto_map, f"""
WITH RECURSIVE {_MATCH}, ch AS (
  SELECT header_id // 12 AS feed_id, CAST(header_id % 12 AS INTEGER) AS col_idx, header,
    CASE WHEN norm = '' THEN [] WHEN coalesce(exact, alias) IS NOT NULL THEN [coalesce(exact, alias)]
         ELSE coalesce(targets, []) END AS choices
  FROM n LEFT JOIN ex USING (header_id) LEFT JOIN ali USING (header_id) LEFT JOIN kw USING (header_id)),
walk AS (
  SELECT feed_id, -1 AS col_idx, CAST('' AS VARCHAR) AS header, CAST('' AS VARCHAR) AS target,
    CAST([] AS VARCHAR[]) AS used FROM (SELECT DISTINCT feed_id FROM ch)
  UNION ALL
  SELECT c.feed_id, c.col_idx, c.header,
    coalesce(list_filter(c.choices, lambda t: NOT list_contains(w.used, t))[1], ''),
    list_append(w.used, coalesce(list_filter(c.choices, lambda t: NOT list_contains(w.used, t))[1], ''))
  FROM walk w JOIN ch c ON c.feed_id = w.feed_id AND c.col_idx = w.col_idx + 1)
SELECT feed_id, col_idx, header, target, CASE WHEN target = '' THEN 'low'
  WHEN lower({strip('header')}) = lower(target) THEN 'high' ELSE 'medium' END AS confidence
FROM walk WHERE col_idx >= 0""")

_SUGGEST = " ".join(
    "WHEN " + " OR ".join(f"contains(l, {lit(w)})" for w in ws) + f" THEN {lit('|'.join(ts))}"
    for ws, ts in S.SUGGESTION_RULES)
register("suggest_fields", lambda spark, sf: _headers(spark, sf).select(
    "header_id", joined(mapping.suggest_fields("header")).alias("options")), f"""
WITH {_HEADER_SQL}, s AS (SELECT header_id, lower({strip('header')}) AS l FROM h)
SELECT header_id, CASE WHEN list_contains({sql_list([t.lower() for t in S.TARGET_COLUMNS])}, l)
  THEN (SELECT max(target) FROM {_TARGETS} WHERE lower(target) = l) || '|' ||
    array_to_string(list_filter({sql_list(S.TARGET_COLUMNS)}, lambda t: lower(t) <> l), '|')
  {_SUGGEST} ELSE {lit('|'.join(S.TARGET_COLUMNS))} END || {lit('|' + S.SKIP_LABEL)} AS options FROM s""")

_T_ODD = ["Title", "Vendor", "Type", "Option1 value", "Option2 value", "Price", "SKU",
          "Published on online store", "Inventory quantity", "", ""]
_T_EVEN = _T_ODD[:7] + ["Status"] + _T_ODD[8:]


def _conf(names, targets):
    return ["low" if not t else "high" if n.lower() == t.lower() else "medium"
            for n, t in zip(names, targets)]


def _mapped(spark, sf, continuation=False):
    return mapping.map_feeds(feeds.feed_headers(I.supplier_feeds(spark, sf, continuation)))


_MAPPED_SQL = f"""SELECT feed_id, CAST(i - 1 AS INTEGER) AS col_idx, names[i] AS client_col,
  nullif(targets[i], '') AS target_field, conf[i] AS confidence FROM (
  SELECT DISTINCT p_brand AS feed_id, {_head_list(_ODD_KEPT, _EVEN_KEPT)} AS names,
    {_head_list(_T_ODD, _T_EVEN)} AS targets,
    {_head_list(_conf(_ODD_KEPT, _T_ODD), _conf(_EVEN_KEPT, _T_EVEN))} AS conf FROM part), range(1, 12) r(i)"""
register("mapping_confidence", lambda spark, sf: mapping.mapping_rows(_mapped(spark, sf)), _MAPPED_SQL)


def resolve_field_map(spark, sf):
    rows = mapping.resolve_field_map(_mapped(spark, sf)).select(
        "feed_id", F.explode("field_map").alias("target", "col_idx"), "headers")
    return rows.select("feed_id", "target", "col_idx",
                       F.get("headers", F.col("col_idx")).alias("client_col"))


register("resolve_field_map", resolve_field_map, f"""
SELECT feed_id, target_field AS target, min(col_idx) AS col_idx, min_by(client_col, col_idx) AS client_col
FROM ({_MAPPED_SQL}) WHERE target_field IS NOT NULL GROUP BY feed_id, target_field""")


def resolve_given_mapping(spark, sf):
    headers = feeds.feed_headers(I.supplier_feeds(spark, sf))
    mapped = mapping.given_mapping(I.given_mappings(spark, sf, S.SKIP_LABEL), headers)
    rows = mapping.resolve_field_map(mapped).select(
        "feed_id", F.explode("field_map").alias("target", "col_idx"), "headers", "constants")
    return rows.select("feed_id", "target", "col_idx", F.get("headers", F.col("col_idx")).alias("client_col"),
                       F.col("constants")[F.col("target")].alias("constant"))


register("resolve_given_mapping", resolve_given_mapping, f"""
WITH f AS (SELECT DISTINCT p_brand AS feed_id, {BRAND_NO} % 2 = 1 AS odd,
    CASE WHEN {BRAND_NO} % 2 = 1 THEN {sql_list(_ODD_KEPT)} ELSE {sql_list(_EVEN_KEPT)} END AS names FROM part),
m AS (SELECT feed_id, odd, names, CAST(generate_subscripts({sql_list(I.GIVEN_TARGETS)}, 1) - 1 AS INTEGER) AS col_idx,
    unnest({sql_list(I.GIVEN_TARGETS)}) AS target FROM f),
c AS (SELECT *, CASE WHEN odd AND col_idx = 1 THEN 'House' WHEN odd AND col_idx = 9 THEN 'Later'
    WHEN odd AND col_idx = 8 THEN 'FALSE' END AS value FROM m WHERE target <> '' AND target NOT LIKE '--%'),
r AS (SELECT *, row_number() OVER (PARTITION BY feed_id, target ORDER BY col_idx) AS rn FROM c)
SELECT feed_id, target, col_idx, names[col_idx + 1] AS client_col, value AS constant FROM r WHERE rn = 1""")


def sample_value(spark, sf):
    rows = I.supplier_feeds(spark, sf)
    headers = feeds.feed_headers(rows)
    return mapping.sample_values(feeds.normalize_feeds(rows, headers), headers)


register("sample_value", sample_value, f"""
WITH {source()}, c AS (SELECT feed_id, pos, odd, generate_subscripts({_SRC_CELLS}, 1) AS i,
  unnest({_SRC_CELLS}) AS cell FROM src)
SELECT feed_id, CAST(i - 1 AS INTEGER) AS col_idx,
  CASE WHEN any_value(odd) THEN ({sql_list(_ODD_KEPT)})[i] ELSE ({sql_list(_EVEN_KEPT)})[i] END AS client_col,
  coalesce(min_by(cell, pos) FILTER (cell <> ''), '') AS sample FROM c GROUP BY feed_id, i""")


def constant_fill(spark, sf):
    rows = I.supplier_feeds(spark, sf)
    headers = feeds.feed_headers(rows)
    constants = mapping.feed_constants(feeds.normalize_feeds(rows, headers), mapping.map_feeds(headers))
    return constants.select("feed_id", F.explode("constants").alias("target", "constant"))


CONSTANT_SQL = """CASE WHEN odd THEN CASE WHEN lower(sample) IN ('false','0','no','n') THEN 'FALSE' ELSE 'TRUE' END
  ELSE CASE WHEN lower(sample) IN ('active','draft','archived')
    THEN upper(sample[1]) || lower(sample[2:]) ELSE 'Active' END END"""
register("constant_fill", constant_fill, f"""
WITH {source()}, s AS (SELECT feed_id, any_value(odd) AS odd, min_by(flag, pos) FILTER (flag <> '') AS sample
  FROM src GROUP BY feed_id)
SELECT feed_id, CASE WHEN odd THEN 'Published on online store' ELSE 'Status' END AS target,
  {CONSTANT_SQL} AS constant FROM s""")


def require_title(spark, sf):
    mapped = mapping.auto_map(I.header_feeds(spark, sf)).withColumnRenamed("auto_targets", "targets")
    return mapping.require_title(mapped)


register("require_title", require_title, f"""
WITH {_MATCH}, t AS (SELECT header_id // 12 AS feed_id,
  bool_or(coalesce(coalesce(exact, alias) = 'Title', false)) AS has_title
  FROM n LEFT JOIN ex USING (header_id) LEFT JOIN ali USING (header_id) GROUP BY feed_id)
SELECT feed_id, has_title, CASE WHEN NOT has_title
  THEN 'At least one column must map to Title before generating.' END AS reason FROM t""")
