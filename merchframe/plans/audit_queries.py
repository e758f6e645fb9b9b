"""Queries on scores, findings, reports and scalar functions."""

from pyspark.sql import functions as F

from merchframe.functions import text, urls
from merchframe.operators import audit, signals
from merchframe.plans import inputs as I
from merchframe.plans.registry import register
from merchframe.plans.sql import lit, pick, slug, strip
from merchframe.session import shared_folder
from merchframe.sources.sinks import write_audit_json

STORE = f"'https://www.store' || c_custkey || {pick(['.co.uk', '.com', '.shop'], 'c_custkey')}"
K = "c_custkey"
DATE = "2024-05-06T07:08:09"

# The signals of I.store_signals in SQL.
SIGNALS = f"""sig AS (SELECT {STORE} AS store_url, *,
  CASE WHEN {K} % 9 <> 0 THEN {STORE} || '/products/p' || {K} END AS product_url,
  round(abs(c_acctbal) / 2000, 2) AS load, {K} % 6 AS images, {K} % 5 AS slides, {K} % 4 AS badges FROM customer)"""
PP = f"""(10.0::DOUBLE - CASE WHEN {K} % 2 = 0 THEN 0 ELSE 3 END - CASE WHEN {K} % 3 = 0 THEN 0 ELSE 2 END
  - CASE WHEN images < 3 THEN 1.5 ELSE 0 END - CASE WHEN {K} % 4 = 0 THEN 0 ELSE 1 END
  - CASE WHEN {K} % 5 = 0 THEN 0 ELSE 1 END - CASE WHEN {K} % 7 = 0 THEN 0 ELSE 0.5 END
  - CASE WHEN {K} % 3 <> 0 THEN 0 ELSE 1 END)"""
CART = f"""(10.0::DOUBLE - CASE WHEN {K} % 4 <> 0 THEN 0 ELSE 4 END - CASE WHEN {K} % 3 = 0 THEN 0 ELSE 3 END
  - CASE WHEN {K} % 5 = 0 THEN 0 ELSE 2 END - CASE WHEN {K} % 11 = 0 THEN 1 ELSE 0 END)"""
MOB = f"""(10.0::DOUBLE - CASE WHEN {K} % 2 = 0 THEN 0 ELSE 3 END - CASE WHEN {K} % 3 = 0 THEN 0 ELSE 2 END
  - CASE WHEN {K} % 5 = 0 THEN 0 ELSE 1 END)"""
SPD = f"""(10.0::DOUBLE - CASE WHEN load > 3 THEN 5 WHEN load > 2 THEN 3 WHEN load > 1.5 THEN 2 WHEN load > 1 THEN 1
  WHEN load > 0.5 THEN 0.5 ELSE 0 END - CASE WHEN {K} % 4 = 0 THEN 2 ELSE 0 END - CASE WHEN slides > 2 THEN 1 ELSE 0 END)"""
MKT = f"""(10.0::DOUBLE - CASE WHEN {K} % 6 = 0 THEN 0 ELSE 3 END - CASE WHEN badges < 2 THEN 2 ELSE 0 END
  - CASE WHEN {K} % 3 = 0 THEN 0 ELSE 1 END - CASE WHEN {K} % 10 <> 0 AND {K} % 5 <> 0 THEN 0 ELSE 2 END
  - CASE WHEN {K} % 2 = 1 THEN 0 ELSE 1 END - CASE WHEN {K} % 4 = 0 THEN 1 ELSE 0 END)"""
RAW_SCORES = {"product_page": PP, "cart_checkout": CART, "mobile": MOB, "speed": SPD, "marketing": MKT}
SCORES = SIGNALS + ", sc AS (SELECT *, " + ", ".join(
    f"greatest(0.0::DOUBLE, {e}) AS score_{c}" for c, e in RAW_SCORES.items()) + " FROM sig), ov AS (SELECT *, " + (
    "CAST(printf('%.1f', " + " + ".join(f"score_{c} * {w}::DOUBLE" for c, w in audit.WEIGHTS.items())
    + ") AS DOUBLE) AS score_overall FROM sc)")


def scored(spark, sf):
    return audit.with_scores(I.store_signals(spark, sf))


for _c in RAW_SCORES:
    register(f"score_{_c if _c != 'cart_checkout' else 'cart_checkout'}",
             lambda spark, sf, c=_c: scored(spark, sf).select("store_url", F.col(f"score_{c}").alias("score")),
             f"WITH {SCORES} SELECT store_url, score_{_c} AS score FROM sc")
register("score_overall", lambda spark, sf: scored(spark, sf).select("store_url", F.col("score_overall").alias("score")),
         f"WITH {SCORES} SELECT store_url, score_overall AS score FROM ov")
register("score_by_category", lambda spark, sf: audit.score_by_category(scored(spark, sf)), f"WITH {SCORES} " + " UNION ALL ".join(
    f"SELECT store_url, '{c}' AS category, score_{c} AS score FROM sc" for c in RAW_SCORES))
register("score_band", lambda spark, sf: audit.score_by_category(scored(spark, sf)).select(
    "store_url", "category", audit.score_band("score").alias("band")), f"WITH {SCORES} " + " UNION ALL ".join(
    f"""SELECT store_url, '{c}' AS category, CASE WHEN score_{c} >= 7.5 THEN '✓ Good' WHEN score_{c} >= 5 THEN '⚠ Fix'
    ELSE '✗ Critical' END AS band FROM sc""" for c in RAW_SCORES))

# --- findings ---------------------------------------------------------------------------

TESTS = {
    1: f"{K} % 2 = 0", 2: f"{K} % 3 = 0", 3: f"badges >= 1 OR {K} % 8 = 0", 4: f"{K} % 3 <> 0",
    5: f"{K} % 4 <> 0 AND {K} % 11 <> 0", 51: f"{K} % 3 = 0", 52: f"{K} % 5 = 0", 6: f"{K} % 3 = 0",
    61: f"{K} % 2 = 0", 7: "load < 3", 8: f"{K} % 6 = 0 OR {K} % 9 = 0", 9: f"{K} % 4 = 0",
    10: f"{K} % 5 = 0", 12: "images >= 3", 14: f"{K} % 5 <> 0 AND {K} % 3 > 0", 16: f"{K} % 3 = 0",
    17: f"{K} % 7 = 0", 100: f"{K} % 7 <> 0", 101: f"{K} % 2 = 0", 102: f"{K} % 5 = 0",
}


def _tf(test):
    return f"CASE WHEN {test} THEN 'True' ELSE 'False' END"


EVIDENCE = {
    1: f"""'ATC y-position: ' || CASE WHEN {K} % 2 = 0 THEN '512' WHEN {K} % 3 = 0 THEN '801.25' ELSE '9999' END
        || 'px (threshold 800px)'""",
    3: f"'Trust elements: ' || badges || '; text match: ' || CASE WHEN {K} % 8 = 0 THEN 'secure' ELSE 'none' END",
    4: f"CASE WHEN {K} % 3 <> 0 THEN 'GBP ' || {K} ELSE 'No price element detected' END",
    5: f"""CASE WHEN {K} % 11 = 0 THEN 'timeout' WHEN {K} % 4 <> 0 THEN 'Checkout button visible after ATC'
        ELSE 'Checkout button not found after ATC' END""",
    6: f"'Above fold: ' || {_tf(f'{K} % 2 = 0')} || '; tap target ≥44px: ' || {_tf(f'{K} % 3 = 0')}",
    61: f"'mobile_atc_above_fold=' || {_tf(f'{K} % 2 = 0')}",
    7: f"'Homepage response ' || CAST(load AS VARCHAR) || 's' || CASE WHEN {K} % 4 = 0 THEN '; carousel detected' ELSE '' END",
    8: f"'Playwright inputs: ' || ({K} % 3) || '; static: ' || {_tf(f'{K} % 9 = 0')}",
    12: "images || ' product image(s) detected'",
    14: f"""'H1=' || CASE WHEN {K} % 5 <> 0 THEN 'yes' ELSE 'no' END || ' (''' ||
        CASE WHEN {K} % 5 <> 0 THEN substr('Welcome to ' || c_name || ' and all of its goods', 1, 40) ELSE '' END ||
        '''); CTA-like elements: ' || ({K} % 3)""",
    100: f"CASE WHEN {K} % 7 <> 0 THEN c_name ELSE 'No title element' END",
    101: f"CASE WHEN {K} % 2 = 0 THEN 'All about ' || c_mktsegment ELSE 'No meta description' END",
    102: f"CASE WHEN {K} % 5 = 0 THEN store_url ELSE 'None found' END",
}
SHOTS = {"homepage": "homepage_desktop.png", "product": "product_desktop.png",
         "mobile": "homepage_mobile.png", "cart": "cart_after_atc.png", "": ""}


def _finding_sql(ord_, check):
    cid, name, sev, cat, yes, no, impact, fix, where, view = check
    test = TESTS[cid]
    issue = f"CASE WHEN {test} THEN {lit(yes)} ELSE {lit(no)} END"
    status = f"CASE WHEN {test} THEN 'pass' ELSE 'fail' END"
    if cid == 7:
        issue = "CASE WHEN load < 3 THEN 'Page speed healthy' WHEN load <= 5 THEN 'Page load time slow (3–5s)' ELSE 'Page load time critical (>5s)' END"
        status = "CASE WHEN load < 3 THEN 'pass' WHEN load <= 5 THEN 'warning' ELSE 'fail' END"
    if cid == 12:
        issue = "'Product gallery has ' || images || ' image(s)' || CASE WHEN images >= 3 THEN ' (3+)' ELSE ' — below recommended 3' END"
        status = "CASE WHEN images >= 3 THEN 'pass' WHEN images = 2 THEN 'warning' ELSE 'fail' END"
    yes_ev, no_ev = audit.PLAIN_EVIDENCE.get(cid, ("", ""))
    evidence = EVIDENCE.get(cid, f"CASE WHEN {test} THEN {lit(yes_ev)} ELSE {lit(no_ev)} END")
    product = "coalesce(product_url, store_url)"
    link = {"base": "store_url", "product": product, "both": f"store_url || ' ' || {product}"}[where]
    shot = f"CASE WHEN {K} % 2 = 0 THEN {lit(SHOTS[view])} ELSE '' END"
    return (f"SELECT store_url, {ord_} AS ord, {cid} AS check_id, {lit(name)} AS check_name, {lit(sev)} AS severity, "
            f"{lit(cat)} AS category, ({test}) AS passed, {status} AS status, {issue} AS issue, {evidence} AS evidence, "
            f"{lit(impact)} AS impact, {lit(fix)} AS fix, {link} AS urls, {shot} AS screenshot, false AS is_sitewide FROM sig")


FOUND = SIGNALS + ", f AS (" + " UNION ALL ".join(_finding_sql(i, c) for i, c in enumerate(audit.CHECKS, 1)) + ")"


def findings(spark, sf):
    return audit.build_findings(I.store_signals(spark, sf))


register("build_findings", lambda spark, sf: findings(spark, sf).withColumn("urls", F.array_join("urls", " ")),
         f"WITH {FOUND} SELECT * FROM f")
register("finding_row", lambda spark, sf: findings(spark, sf).select(
    "store_url", "check_id", "status", "is_sitewide", F.size("urls").alias("n_urls")),
    f"WITH {FOUND} SELECT store_url, check_id, status, is_sitewide, CASE WHEN check_id = 3 THEN 2 ELSE 1 END AS n_urls FROM f")


def failed_findings(spark, sf):
    rows = audit.with_findings(I.store_signals(spark, sf)).select(
        "store_url", F.inline(audit.failed_findings("findings")))
    issue = F.get("issues", F.lit(0))
    return rows.select("store_url", "url", "check", issue["issue"].alias("issue"), issue["severity"].alias("severity"),
                       issue["label"].alias("label"), issue["_screenshot"].alias("screenshot"))


register("failed_findings", failed_findings, f"""WITH {FOUND}
SELECT store_url, string_split(urls, ' ')[1] AS url, 'cro_' || category AS "check", issue, severity,
  'CONFIRMED' AS label, screenshot FROM f WHERE NOT (passed AND status = 'pass')""")
register("issue_counts", lambda spark, sf: audit.issue_counts(audit.with_findings(I.store_signals(spark, sf))), f"""
WITH {FOUND} SELECT store_url, count(*) FILTER (NOT passed) AS issues,
  count(*) FILTER (NOT passed AND fix <> '') AS recommendations,
  CASE WHEN any_value(product_url) IS NULL THEN 1 ELSE 2 END AS pages
FROM f JOIN sig USING (store_url) GROUP BY store_url""")
register("severity_buckets", lambda spark, sf: audit.severity_buckets(findings(spark, sf)), f"""
WITH {FOUND} SELECT store_url, severity, count(*) AS failed FROM f WHERE NOT passed GROUP BY ALL""")
register("top_issues", lambda spark, sf: audit.top_issues(audit.with_findings(I.store_signals(spark, sf))), f"""
WITH {FOUND}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY store_url, severity ORDER BY ord) AS INTEGER) AS rank
  FROM f WHERE NOT passed)
SELECT store_url, severity, rank, issue FROM r WHERE (severity = 'HIGH' AND rank <= 3) OR (severity = 'MEDIUM' AND rank <= 4)""")
register("passing_checks", lambda spark, sf: audit.passing_checks(findings(spark, sf)), f"""
WITH {FOUND} SELECT store_url, ord, check_name, substr(evidence, 1, 80) AS evidence FROM f
WHERE passed AND status = 'pass'""")
_SENTENCES = [s.replace("%s shows", "%s shows") for _, s in audit.SUMMARIES]


def _sentence(s):
    head, mid, tail = s.split("%s")
    return f"'Store' || {K} || {lit(mid)} || CAST(score_overall AS VARCHAR) || {lit(tail)}"


register("executive_summary", lambda spark, sf: scored(spark, sf).select(
    "store_url", audit.executive_summary().alias("summary")), f"""
WITH {SCORES} SELECT store_url, CASE WHEN score_overall >= 7.5 THEN {_sentence(_SENTENCES[0])}
  WHEN score_overall >= 5 THEN {_sentence(_SENTENCES[1])} ELSE {_sentence(_SENTENCES[2])} END AS summary FROM ov""")


def write_documents(spark, sf):
    rows = I.store_signals(spark, sf, wide=True).withColumns({"audit_date": F.lit(DATE), "audit_mode": F.lit("cro")})
    folder = shared_folder(spark, "audits")
    write_audit_json(audit.audit_document(rows), folder)
    schema = ("audit string, store_url string, audit_date string, pages_crawled array<string>, "
              "load_times struct<homepage: double>, scores struct<categories: map<string, double>, overall: double>, "
              "findings array<struct<check_id: int>>, results array<struct<check: string>>")
    return spark.read.schema(schema).json(folder).select(
        "audit", "store_url", "audit_date", F.size("pages_crawled").alias("pages"),
        F.col("load_times.homepage").alias("load"), F.col("scores.overall").alias("overall"),
        F.col("scores.categories")["speed"].alias("speed"), F.size("findings").alias("findings"),
        F.size("results").alias("failed"))


register("write_audit_json", write_documents, f"""
WITH {SCORES}, {FOUND[len(SIGNALS) + 2:]}, n AS (SELECT store_url, CAST(count(*) AS INTEGER) AS failed FROM f
  WHERE NOT (passed AND status = 'pass') GROUP BY store_url)
SELECT replace(replace(store_url, 'https://', ''), 'www.', '') || '_2024-05-06' AS audit, store_url, '{DATE}' AS audit_date,
  CASE WHEN product_url IS NULL THEN 1 ELSE 2 END AS pages, load, score_overall AS overall, score_speed AS speed,
  20 AS findings, failed FROM ov JOIN n USING (store_url)""")


def audit_stores(spark, sf):
    """Captured pages all the way to scores."""
    static = signals.static_signals(I.stores(spark, sf), ["store_url"]).withColumn("homepage_load_time", F.lit(0.4))
    merged = signals.merge_signals(static, signals.rendered_signals(I.captures(spark, sf)))
    return audit.with_scores(merged).select("store_url", *[f"score_{c}" for c in audit.WEIGHTS], "score_overall")


_R = f"({K} % 4 <> 3)"


def _pen(cond, points):
    return f"- CASE WHEN {cond} THEN {points} ELSE 0 END"


_END = {
    "product_page": "10.0::DOUBLE " + " ".join([
        _pen(f"NOT ({_R} AND {K} % 2 = 0)", 3),
        _pen(f"NOT ({_R} AND {K} % 6 = 0 AND {K} % 12 <> 0)", 2), "- 1.5", _pen(f"NOT ({_R} AND {K} % 7 = 0)", 1),
        _pen(f"NOT ({_R} AND {K} % 8 = 0)", 1), _pen(f"NOT ({_R} AND {K} % 10 = 0)", 0.5),
        _pen(f"NOT ({_R} AND {K} % 3 = 0)", 1)]),
    "cart_checkout": "10.0::DOUBLE " + " ".join([
        _pen(f"NOT ({_R} AND ({K} % 2 = 0 OR {K} % 3 = 0))", 4), _pen(f"NOT ({_R} AND {K} % 4 = 0)", 3),
        _pen(f"NOT ({_R} AND {K} % 5 = 0)", 2), _pen(f"{_R} AND ({K} % 5 <> 0 OR {K} % 13 = 0)", 1)]),
    "mobile": "10.0::DOUBLE " + " ".join([
        _pen(f"NOT ({_R} AND {K} % 5 = 0)", 3), "- 2",
        _pen(f"NOT ({_R} AND ({K} % 2 = 0 OR {K} % 3 = 0 OR {K} % 5 = 0))", 1)]),
    "speed": "10.0::DOUBLE " + _pen(f"{_R} AND {K} % 9 = 0", 2),
    "marketing": "10.0::DOUBLE " + " ".join([
        _pen(f"NOT ({K} % 6 = 0 OR {K} % 10 = 0)", 3), _pen(f"NOT ({_R} AND {K} % 5 = 0)", 2),
        _pen(f"NOT ({_R} AND {K} % 8 = 0)", 1), _pen(f"NOT ({_R} AND {K} % 3 = 0)", 2),
        _pen(f"NOT ({_R} AND {K} % 2 = 0)", 1), _pen(f"{_R} AND {K} % 9 = 0", 1)]),
}
register("audit_stores", audit_stores, "WITH e AS (SELECT " + f"{STORE} AS store_url, " + ", ".join(
    f"greatest(0.0::DOUBLE, {e}) AS score_{c}" for c, e in _END.items()) + " FROM customer) SELECT *, CAST(printf('%.1f', "
    + " + ".join(f"score_{c} * {w}::DOUBLE" for c, w in audit.WEIGHTS.items()) + ") AS DOUBLE) AS score_overall FROM e")

# --- scalar functions -------------------------------------------------------------------


def docs(spark, sf, **columns):
    return I.table(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in columns.items()])


_FN = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(text, chr(9)||chr(10)||chr(13)||' ')), '\\s+', '-', 'g'), '[^a-z0-9-]+', '', 'g'), '-{2,}', '-', 'g'), '-')"
_UP = "trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_')"
register("slugify", lambda spark, sf: docs(spark, sf, slug=text.slugify("text")),
         f"SELECT doc_id, {slug('text')} AS slug FROM documents")
register("filename_slug", lambda spark, sf: docs(spark, sf, slug=text.filename_slug("text")),
         f"SELECT doc_id, {_FN} AS slug FROM documents")
register("upload_filename_slug", lambda spark, sf: docs(spark, sf, slug=text.upload_filename_slug("text")),
         f"SELECT doc_id, {_UP} AS slug FROM documents")

_HOSTS = ["WWW.Shop-{}.co.uk", "user@shop{}.com:8080", "forge{}.museum", "local{}", "a.b{}.com.au", "x{}.technology", "www.{}"]
_NAMES = ["shop-{}", "shop{}", "forge{}", "local{}", "ab{}", "x{}technology", "www"]


def url_rows(spark, sf):
    k = F.col("o_orderkey")
    ks = k.cast("string")
    host = F.replace(I.pick(_HOSTS, k), F.lit("{}"), ks)
    scheme = I.pick(["https://", "", " http://"], k)
    rest = I.pick(["/collections/New Arrivals!?x=1", "", "/Collections/sale_2/", "/products/a#/collections/b",
                   "/collections/%21"], F.floor(k / 3))
    return I.table(spark, sf, "orders").select(k.alias("k"), F.concat(scheme, host, rest).alias("url"))


def _host_sql(names):
    return f"replace({pick(names, 'o_orderkey')}, '{{}}', CAST(o_orderkey AS VARCHAR))"


# "www.<k>" loses its www. and then a last label of two to six digits.
_NAME_SQL = f"""CASE WHEN o_orderkey % 7 = 6 THEN CAST(o_orderkey AS VARCHAR) ELSE {_host_sql(_NAMES)} END"""
_COLL_SQL = pick(["newarrivals", "products", "sale2", "products", "21"], "o_orderkey // 3").replace("'newarrivals'", "'new-arrivals'")
register("store_name_from_url", lambda spark, sf: url_rows(spark, sf).select(
    "k", urls.store_name_from_url("url").alias("name")), f"SELECT o_orderkey AS k, {_NAME_SQL} AS name FROM orders")
register("collection_handle_from_url", lambda spark, sf: url_rows(spark, sf).select(
    "k", urls.collection_handle_from_url("url").alias("handle")), f"SELECT o_orderkey AS k, {_COLL_SQL} AS handle FROM orders")
register("output_filename", lambda spark, sf: url_rows(spark, sf).select(
    "k", urls.output_filename_from_url("url").alias("from_url"),
    urls.output_filename_from_upload(F.concat(F.lit("/up.d/Price List "), F.col("k").cast("string"),
                                              I.pick([".v2.CSV", "", ".xlsx"], F.col("k")))).alias("from_upload")), f"""
SELECT o_orderkey AS k, {_NAME_SQL} || '_' || {_COLL_SQL} || '_products.csv' AS from_url,
  'price_list_' || o_orderkey || {pick(['_v2', '', ''], 'o_orderkey')} || '_products.csv' AS from_upload FROM orders""")
register("is_valid_url", lambda spark, sf: url_rows(spark, sf).select("k", urls.is_valid_url("url").alias("valid")),
         "SELECT o_orderkey AS k, o_orderkey % 3 <> 1 AS valid FROM orders")
register("clean_domain", lambda spark, sf: I.crawled_pages(spark, sf).select(
    "page_id", urls.clean_domain("url").alias("domain")), """
SELECT 'page-' || page_id AS page_id, regexp_replace(replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), 'www.', ''),
  '[^a-zA-Z0-9_\\-.]', '_', 'g') AS domain FROM pages""")


def report_name(spark, sf):
    k = F.col("c_custkey")
    date = F.concat(F.lit("2024-0"), (k % 9 + 1).cast("string"), F.lit("-1"), (k % 10).cast("string"),
                    I.pick(["T10:11:12.5", "", "T23:59:59"], k))
    return I.table(spark, sf, "customer").select(k.alias("custkey"), urls.report_name(
        I.store_url(), date).alias("name"))


register("report_name", report_name, f"""SELECT c_custkey AS custkey, 'CRO_Audit_store' || {K} ||
  {pick(['_co_uk', '_com', '_shop'], K)} || '_2024-0' || ({K} % 9 + 1) || '-1' || ({K} % 10) || '.docx' AS name FROM customer""")
