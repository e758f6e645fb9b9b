"""SQL building blocks of the expected results, written for DuckDB on the driver tables."""

from merchframe.plans.inputs import HEADERS_EVEN, HEADERS_ODD, NUMBERS_ROW

WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def clean(x: str) -> str:
    t = strip(f"coalesce({x}, '')")
    return f"(CASE WHEN lower({t}) IN ('nan','none','nat') THEN '' ELSE {t} END)"


def slug(x: str) -> str:
    return f"trim(regexp_replace(lower({strip(x)}), '[^a-z0-9]+', '-', 'g'), '-')"


def pick(values, n: str) -> str:
    return f"({sql_list(values)})[CAST(({n}) % {len(values)} AS INTEGER) + 1]"


BRAND_NO = "CAST(substr(p_brand, 7) AS INTEGER)"


def raw_cells(continuation: bool) -> str:
    title = "CASE WHEN p_partkey % 11 = 0 THEN '  ' || p_name || ' ' || chr(9) ELSE p_name END"
    if continuation:
        title = f"CASE WHEN p_partkey % 4 = 0 THEN {title} ELSE '' END"
    return f"""[{title}, p_brand, p_type,
      CASE WHEN p_partkey % 5 = 0 THEN 'nan' WHEN p_partkey % 7 = 0 THEN 'S; M ;L'
           ELSE array_to_string((['S','M','L'])[1:p_size % 3 + 1], ',') END,
      CASE WHEN p_partkey % 9 = 0 THEN '<b>x, y</b>' WHEN p_partkey % 2 = 0 THEN 'red;blue' ELSE '' END,
      printf('%.2f', p_retailprice), 'SKU-' || p_partkey,
      CASE WHEN {BRAND_NO} % 2 = 1 THEN {pick(['no', '', 'Yes '], 'p_partkey')}
           ELSE {pick(['draft', '', 'ACTIVE '], 'p_partkey')} END,
      CAST(p_size AS VARCHAR), 'x', 'None',
      CASE WHEN p_partkey % 13 = 0 THEN 'fragile' ELSE '' END]"""


def raw_feed(continuation: bool = False) -> str:
    """CTE body: feed_id, pos, cells of the supplier feeds."""
    cells = raw_cells(continuation)
    return f"""
    SELECT p_brand AS feed_id, p_partkey + 3 AS pos,
      CASE WHEN p_partkey % 97 = 0 THEN {sql_list([' '] + [''] * 11)}
           WHEN p_partkey % 6 = 0 AND p_partkey % 13 <> 0 THEN ({cells})[1:11]
           ELSE {cells} END AS cells FROM part
    UNION ALL SELECT DISTINCT p_brand, 0, ['Supplier list of ' || p_brand] FROM part
    UNION ALL SELECT DISTINCT p_brand, CASE WHEN {BRAND_NO} % 2 = 1 THEN 2 ELSE 1 END,
      CASE WHEN {BRAND_NO} % 2 = 1 THEN {sql_list(HEADERS_ODD)} ELSE {sql_list(HEADERS_EVEN)} END FROM part
    UNION ALL SELECT DISTINCT p_brand, 1, {sql_list(NUMBERS_ROW)} FROM part WHERE {BRAND_NO} % 2 = 1"""


def source(continuation: bool = False) -> str:
    """CTEs raw and src: clean body rows with one column per cell."""
    names = ["title", "vendor", "kind", "sizes", "colours", "price", "sku", "flag", "qty", "x", "n1", "n2"]
    cells = ", ".join(f"{clean(f'cells[{i + 1}]')} AS {n}" for i, n in enumerate(names))
    return f"""raw AS ({raw_feed(continuation)}),
    src AS (SELECT feed_id, pos, CAST(substr(feed_id, 7) AS INTEGER) % 2 = 1 AS odd, {cells}
            FROM raw WHERE pos > CASE WHEN CAST(substr(feed_id, 7) AS INTEGER) % 2 = 1 THEN 2 ELSE 1 END
              AND len(list_filter(cells, lambda c: trim(c) <> '')) > 0)"""


def options(x: str) -> str:
    """Option values of a cell as a list that is never empty."""
    parts = f"list_filter(list_transform(string_split_regex({x}, '[,;]'), lambda s: trim(s)), lambda s: s <> '')"
    whole = f"CASE WHEN contains({x}, '<') AND contains({x}, '>') THEN [{x}] ELSE {parts} END"
    return f"(CASE WHEN len({whole}) = 0 THEN [''] ELSE {whole} END)"


def generated(continuation: bool = True) -> str:
    """CTEs up to gen: the product rows of the supplier feeds, one column per varying field."""
    return f"""{source(continuation)},
    const AS (SELECT feed_id, min_by(flag, pos) FILTER (flag <> '') AS sample FROM src GROUP BY feed_id),
    handled AS (SELECT *, CASE WHEN title <> '' THEN coalesce(nullif({slug('title')}, ''), 'product') END AS base
                FROM src),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY feed_id, base ORDER BY pos) AS nth FROM handled),
    own AS (SELECT *, CASE WHEN base IS NULL THEN NULL WHEN nth = 1 THEN base ELSE base || '-' || nth END AS own_handle
            FROM numbered),
    active AS (SELECT *, last_value(own_handle IGNORE NULLS) OVER (
                 PARTITION BY feed_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS handle FROM own),
    sized AS (SELECT *, CASE WHEN title <> '' THEN {options('sizes')} ELSE [sizes] END AS v1,
                     CASE WHEN title <> '' THEN {options('colours')} ELSE [colours] END AS v2
              FROM active WHERE handle IS NOT NULL),
    ex1 AS (SELECT *, unnest(v1) AS o1, generate_subscripts(v1, 1) AS i1 FROM sized),
    ex2 AS (SELECT *, unnest(v2) AS o2, generate_subscripts(v2, 1) AS i2 FROM ex1),
    gen AS (SELECT e.*, (i1 - 1) * len(v2) + i2 - 1 AS variant_idx, c.sample,
              title <> '' AND i1 = 1 AND i2 = 1 AS is_first,
              title <> '' AND NOT (i1 = 1 AND i2 = 1) AS later
            FROM ex2 e JOIN const c USING (feed_id))"""
