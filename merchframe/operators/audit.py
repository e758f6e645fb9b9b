"""Scores, findings and report aggregates of one signal row per store.

A store's findings are an array on its own row, so per-store reports need no shuffle; the long form
is one `inline` away.
"""

from pyspark.sql import Column, DataFrame, functions as F

from merchframe.functions.text import col, first_text, or_blank
from merchframe.functions.urls import store_title
from merchframe.functions.values import round1

# --- Fixed values: penalty per failed test, taken off ten points ------------------------
PENALTIES = {
    "product_page": [
        ("NOT atc_above_fold", 3), ("NOT product_has_reviews", 2),
        ("product_image_count < 3", 1.5), ("NOT has_urgency", 1), ("NOT has_cross_sell", 1),
        ("NOT has_sticky_atc", 0.5), ("NOT price_visible", 1),
    ],
    "cart_checkout": [
        ("NOT cart_has_checkout_btn", 4), ("NOT cart_has_trust", 3), ("NOT cart_has_upsell", 2),
        ("cart_flow_error <> ''", 1),
    ],
    "mobile": [
        ("NOT mobile_atc_above_fold", 3), ("NOT mobile_atc_tap_target_ok", 2),
        ("NOT mobile_has_hamburger", 1),
    ],
    "speed": [("has_carousel", 2), ("carousel_slide_count > 2", 1)],
    "marketing": [
        ("NOT has_email_capture", 3), ("trust_badge_count < 2", 2), ("NOT has_announcement_bar", 1),
        ("NOT has_h1 OR NOT h1_has_content", 2), ("NOT has_visible_nav", 1), ("has_carousel", 1),
    ],
}
LOAD_PENALTIES = [(3, 5), (2, 3), (1.5, 2), (1, 1), (0.5, 0.5)]
WEIGHTS = {
    "product_page": 0.30, "cart_checkout": 0.25, "mobile": 0.20, "speed": 0.15, "marketing": 0.10,
}
BANDS = [(7.5, "✓ Good"), (5, "⚠ Fix")]
LOWEST_BAND = "✗ Critical"
SUMMARIES = [
    (7.5, "%s shows a strong conversion foundation (%s/10). "
          "Focus remaining effort on polishing medium gaps and protecting page speed."),
    (5, "%s is conversion-capable but leaking revenue (%s/10). "
        "Prioritize HIGH issues (ATC, reviews, trust, checkout) before marketing polish."),
    (None, "%s has critical conversion blockers (%s/10). "
           "Fix ATC visibility, trust/reviews, and checkout reliability before traffic spend."),
]
TOP_ISSUES = {"HIGH": 3, "MEDIUM": 4}

# --- Fixed values: the 20 checks in report order ----------------------------------------
# (id, name, severity, category, issue when passed, issue when failed, impact, fix, urls, view)
CHECKS = [
    (1, "ATC Button Above Fold", "HIGH", "product_page",
     "ATC button visible above the fold", "Add to Cart button is below the fold or missing",
     "Shoppers who don't scroll miss the buy button",
     "Move ATC above the fold or add a sticky ATC bar", "product", "product"),
    (2, "Reviews Present", "HIGH", "product_page",
     "Reviews / ratings present", "No reviews or star ratings on product page",
     "93% of buyers read reviews before purchasing",
     "Install Judge.me / Okendo / Loox and display stars on product pages", "product", "product"),
    (3, "Trust Badges", "HIGH", "product_page",
     "Trust signals present", "No trust badges detected",
     "Customers hesitate without trust indicators",
     "Add trust strip: Secure Checkout, Money-Back Guarantee, Free Returns", "both", "homepage"),
    (4, "Price Visibility", "HIGH", "product_page",
     "Price clearly visible", "No clear price element found on product page",
     "Hidden or unclear pricing kills conversion",
     "Ensure .price shows currency and amount above the fold", "product", "product"),
    (5, "Cart Checkout Working", "HIGH", "cart_checkout",
     "Checkout reachable after ATC", "Cart/checkout flow broken or incomplete",
     "Broken checkout = zero revenue",
     "Fix ATC → cart drawer/page and ensure Checkout button is visible", "product", "cart"),
    (51, "Cart Trust Signals", "MEDIUM", "cart_checkout",
     "Trust signals in cart", "No trust signals in cart",
     "Cart is high-anxiety — reinforce trust before checkout",
     "Add secure checkout / guarantee copy near Checkout", "product", "cart"),
    (52, "Cart Upsell", "MEDIUM", "cart_checkout",
     "Cart upsell present", "No upsell in cart",
     "Missing cart upsells reduce AOV",
     "Add cart drawer recommendations or FBT", "product", "cart"),
    (6, "Mobile ATC Tap Target", "HIGH", "mobile",
     "Mobile ATC tap target OK", "Mobile ATC tap target too small or missing",
     "Small tap targets cause mis-taps and abandoned carts on mobile",
     "Set min-height/min-width of ATC to at least 48px on mobile", "product", "mobile"),
    (61, "Mobile ATC Above Fold", "HIGH", "mobile",
     "Mobile ATC above fold", "Mobile ATC below fold or missing",
     "Mobile shoppers expect buy CTA without scrolling",
     "Keep ATC sticky or above the fold on mobile product pages", "product", "mobile"),
    (7, "Page Speed", "HIGH", "speed",
     "", "",
     "53% of mobile users abandon pages taking over 3s",
     "Remove unused apps, compress images, defer non-critical JS", "base", "homepage"),
    (8, "Email Capture", "MEDIUM", "marketing",
     "Email capture present", "No email capture detected",
     "Without capture you lose most non-buyers forever",
     "Add Klaviyo/Omnisend popup with a first-order incentive", "base", "homepage"),
    (9, "Urgency Signals", "MEDIUM", "marketing",
     "Urgency signals found", "No urgency signals on product page",
     "Without urgency, shoppers delay and often don't return",
     "Show low-stock using inventory_quantity or a promo countdown", "product", "product"),
    (10, "Upsell / Cross-sell", "MEDIUM", "marketing",
     "Upsell/cross-sell section found", "No upsell or cross-sell section on product page",
     "Missing upsells reduce average order value",
     "Add Related Products or Frequently Bought Together below description", "product", "product"),
    (12, "Image Count", "MEDIUM", "product_page",
     "", "",
     "Thin galleries reduce confidence and conversion",
     "Add at least 3 lifestyle/detail images per product", "product", "product"),
    (14, "Homepage Hero CTA", "LOW", "marketing",
     "Homepage has H1 + CTA elements", "Homepage missing clear H1 or hero CTA",
     "Weak hero CTAs increase bounce",
     "Add a clear H1 and primary Shop Now button in the hero", "base", "homepage"),
    (16, "Announcement Bar", "LOW", "marketing",
     "Announcement / promo bar present", "No announcement bar detected",
     "Announcement bars drive promos and free-shipping thresholds",
     "Add a slim announcement bar with offer or shipping message", "base", "homepage"),
    (17, "Sticky ATC", "LOW", "product_page",
     "Sticky ATC present", "No sticky ATC bar",
     "Sticky ATC recovers scrollers who miss the primary button",
     "Add a sticky add-to-cart bar on product pages", "product", "product"),
    (100, "Meta Title", "MEDIUM", "marketing",
     "Meta title present", "Homepage missing <title>",
     "Hurts SEO & CTR",
     "Add a unique title tag under 60 characters", "base", ""),
    (101, "Meta Description", "MEDIUM", "marketing",
     "Meta description present", "Homepage missing meta description",
     "Weak SERP snippets reduce click-through",
     "Add a compelling meta description under 155 characters", "base", ""),
    (102, "Canonical Tag", "LOW", "marketing",
     "Canonical tag present", "No canonical tag on homepage",
     "Canonical tags prevent duplicate-content issues",
     "Add <link rel='canonical'> pointing to the preferred URL", "base", ""),
]

# --- Fixed values: SQL test per check ---------------------------------------------------
PASS_TESTS = {
    1: "atc_above_fold",
    2: "product_has_reviews",
    3: "trust_badge_count >= 1 OR has_trust_text",
    4: "price_visible",
    5: "cart_has_checkout_btn AND cart_flow_error = ''",
    51: "cart_has_trust",
    52: "cart_has_upsell",
    6: "mobile_atc_tap_target_ok",
    61: "mobile_atc_above_fold",
    7: "homepage_load_time < 3",
    8: "has_email_capture OR has_email_capture_static",
    9: "has_urgency",
    10: "has_cross_sell",
    12: "product_image_count >= 3",
    14: "h1_has_content AND hero_cta_count > 0",
    16: "has_announcement_bar",
    17: "has_sticky_atc",
    100: "has_meta_title",
    101: "has_meta_description",
    102: "has_canonical",
}

# --- Fixed values: evidence texts that depend on the test alone (passed, failed) --------
PLAIN_EVIDENCE = {
    2: ("Review/rating widget detected",
        "No review widgets (.judge-me, .yotpo, stamped, etc.) found"),
    51: ("Secure/guarantee/trust element in cart UI", "None found"),
    52: ("Upsell/recommend block found", "None found"),
    9: ("low-stock / limited / selling-fast messaging", "None found"),
    10: ("Related/upsell block detected", "None found"),
    16: ("Promo/announcement bar element found", "None found"),
    17: ("Sticky cart/ATC element found", "None found"),
}


# --- scores -----------------------------------------------------------------------------

def category_score(category: str) -> Column:
    """Ten points minus the penalties of a category, not below zero, one decimal."""
    score = F.lit(10.0)
    for test, points in PENALTIES[category]:
        score = score - F.when(F.expr(test), float(points)).otherwise(0.0)
    if category == "speed":
        step = F
        for limit, points in LOAD_PENALTIES:
            step = step.when(F.col("homepage_load_time") > limit, float(points))
        score = score - step.otherwise(0.0)
    return F.greatest(F.lit(0.0), round1(score))


def overall_score() -> Column:
    total = None
    for category, weight in WEIGHTS.items():
        part = F.col(f"score_{category}") * F.lit(weight)
        total = part if total is None else total + part
    return round1(total)


def with_scores(signals: DataFrame) -> DataFrame:
    """Add score_<category> and score_overall."""
    return signals.withColumns(
        {f"score_{c}": category_score(c) for c in WEIGHTS}
    ).withColumn("score_overall", overall_score())


def score_by_category(scored: DataFrame) -> DataFrame:
    """(store_url, category, score): the long form of the category scores."""
    long = scored.unpivot(["store_url"], [f"score_{c}" for c in WEIGHTS], "category", "score")
    return long.withColumn("category", F.replace("category", F.lit("score_"), F.lit("")))


def score_band(score) -> Column:
    band = F
    for limit, label in BANDS:
        band = band.when(col(score) >= limit, label)
    return band.otherwise(LOWEST_BAND)


# --- findings ---------------------------------------------------------------------------

def _py_bool(c: str) -> Column:
    return F.when(F.col(c), "True").otherwise("False")


def _py_number(c: str) -> Column:
    """Whole positions print without a fraction."""
    whole = F.col(c) == F.floor(c)
    return F.when(whole, F.col(c).cast("bigint").cast("string")).otherwise(F.col(c).cast("string"))


def _evidence() -> dict[int, Column]:
    """Evidence of the checks that report measured values."""
    return {
        1: F.format_string("ATC y-position: %spx (threshold 800px)", _py_number("atc_y_position")),
        3: F.format_string("Trust elements: %s; text match: %s", "trust_badge_count",
                           first_text("trust_text_match", F.lit("none"))),
        4: first_text("price_text", F.lit("No price element detected")),
        5: first_text("cart_flow_error", F.when(
            F.col("cart_has_checkout_btn"), "Checkout button visible after ATC").otherwise(
            "Checkout button not found after ATC")),
        6: F.format_string("Above fold: %s; tap target ≥44px: %s",
                           _py_bool("mobile_atc_above_fold"), _py_bool("mobile_atc_tap_target_ok")),
        61: F.concat(F.lit("mobile_atc_above_fold="), _py_bool("mobile_atc_above_fold")),
        7: F.concat(F.lit("Homepage response "), F.col("homepage_load_time").cast("string"),
                    F.lit("s"), F.when(F.col("has_carousel"), "; carousel detected").otherwise("")),
        8: F.format_string("Playwright inputs: %s; static: %s", "email_capture_count",
                           _py_bool("has_email_capture_static")),
        12: F.format_string("%s product image(s) detected", "product_image_count"),
        14: F.format_string(
            "H1=%s ('%s'); CTA-like elements: %s",
            F.when(F.col("h1_has_content"), "yes").otherwise("no"),
            F.substring("h1_text", 1, 40), "hero_cta_count"),
        100: first_text("meta_title", F.lit("No title element")),
        101: first_text("meta_description", F.lit("No meta description")),
        102: first_text("canonical_href", F.lit("None found")),
    }


def _graded() -> dict[int, tuple[Column, Column]]:
    """(issue, status) of the checks with a warning grade."""
    load, images = F.col("homepage_load_time"), F.col("product_image_count")
    gallery = F.format_string("Product gallery has %s image(s)", "product_image_count")
    return {
        7: (F.when(load < 3, "Page speed healthy").when(load <= 5, "Page load time slow (3–5s)")
            .otherwise("Page load time critical (>5s)"),
            F.when(load < 3, "pass").when(load <= 5, "warning").otherwise("fail")),
        12: (F.concat(gallery, F.when(images >= 3, " (3+)").otherwise(" — below recommended 3")),
             F.when(images >= 3, "pass").when(images == 2, "warning").otherwise("fail")),
    }


def _check_table() -> Column:
    """The checks as one constant array; Catalyst folds it, so it costs no code per row."""
    names = ["check_id", "check_name", "severity", "category", "yes", "no", "impact", "fix",
             "pages", "view"]
    return F.array(*[F.struct(
        F.lit(ord_).alias("ord"), *[F.lit(v).alias(n) for n, v in zip(names, check)],
        *[F.lit(t).alias(n) for n, t in zip(
            ("evidence_yes", "evidence_no"), PLAIN_EVIDENCE.get(check[0], ("", "")))])
        for ord_, check in enumerate(CHECKS, 1)])


def _per_check(found: dict[int, Column], kind: str) -> Column:
    return F.array(*[found.get(c[0], F.lit(None)).cast(kind) for c in CHECKS])


def _measured(signals: DataFrame) -> DataFrame:
    """Add what the checks found on a store as arrays in check order, and its product page."""
    graded = _graded()
    return signals.withColumns({
        "_passed": F.array(*[F.coalesce(F.expr(PASS_TESTS[c[0]]), F.lit(False)) for c in CHECKS]),
        "_evidence": _per_check(_evidence(), "string"),
        "_issue": _per_check({c: g[0] for c, g in graded.items()}, "string"),
        "_status": _per_check({c: g[1] for c, g in graded.items()}, "string"),
        "_product": F.coalesce(F.nullif("product_url", F.lit("")), F.col("store_url")),
    })


def _finding(c: Column, passed: Column, evidence: Column, issue: Column,
             status: Column) -> list[Column]:
    """Fields of one finding from its check and from what was found."""
    yes_no = lambda yes, no: F.when(passed, yes).otherwise(no)
    urls = F.when(c["pages"] == "base", F.array("store_url")).when(
        c["pages"] == "both", F.array("store_url", "_product")).otherwise(F.array("_product"))
    return [
        *[c[n].alias(n) for n in ("ord", "check_id", "check_name", "severity", "category")],
        passed.alias("passed"),
        F.coalesce(status, yes_no("pass", "fail")).alias("status"),
        F.coalesce(issue, yes_no(c["yes"], c["no"])).alias("issue"),
        F.coalesce(evidence, yes_no(c["evidence_yes"], c["evidence_no"])).alias("evidence"),
        c["impact"].alias("impact"), c["fix"].alias("fix"), urls.alias("urls"),
        or_blank(F.col("screenshots")[c["view"]]).alias("screenshot"),
        (F.size(urls) >= 3).alias("is_sitewide")]


def with_findings(signals: DataFrame) -> DataFrame:
    """Add `findings`: the 20 findings of a store in report order.

    Reads the signal columns plus store_url, product_url and `screenshots` (map view -> file).
    """
    def finding(c, i):
        return F.struct(*_finding(c, F.get("_passed", i), F.get("_evidence", i),
                                  F.get("_issue", i), F.get("_status", i)))
    return _measured(signals).withColumn("findings", F.transform(_check_table(), finding)).drop(
        "_passed", "_evidence", "_issue", "_status", "_product")


def build_findings(signals: DataFrame) -> DataFrame:
    """Long form: one row per store and check."""
    found = F.arrays_zip("_passed", "_evidence", "_issue", "_status")
    rows = _measured(signals).select(
        "store_url", "_product", "screenshots", F.posexplode(found).alias("_i", "_found"))
    rows = rows.withColumn("_check", F.get(_check_table(), F.col("_i")))
    return rows.select("store_url", *_finding(
        F.col("_check"), F.col("_found._passed"), F.col("_found._evidence"),
        F.col("_found._issue"), F.col("_found._status")))


# --- reports on the findings of a store -------------------------------------------------

def failed_findings(findings) -> Column:
    """Findings that didn't pass, in the nested result shape."""
    failed = F.filter(col(findings), lambda f: ~(f["passed"] & (f["status"] == "pass")))
    return F.transform(failed, lambda f: F.struct(
        F.coalesce(F.get(f["urls"], F.lit(0)), F.lit("")).alias("url"),
        F.concat(F.lit("cro_"), f["category"]).alias("check"),
        F.array(F.struct(
            f["issue"].alias("issue"), f["severity"].alias("severity"),
            F.lit("CONFIRMED").alias("label"), f["category"].alias("cro_category"),
            f["impact"].alias("impact"), f["fix"].alias("fix"),
            f["screenshot"].alias("_screenshot"))).alias("issues")))


def issue_counts(with_array: DataFrame) -> DataFrame:
    """(store_url, issues, recommendations, pages) per store."""
    def count(test):
        return F.size(F.filter("findings", test))
    return with_array.select(
        "store_url", count(lambda f: ~f["passed"]).alias("issues"),
        count(lambda f: ~f["passed"] & (f["fix"] != "")).alias("recommendations"),
        F.when(or_blank("product_url") != "", 2).otherwise(1).alias("pages"))


def severity_buckets(findings: DataFrame) -> DataFrame:
    """(store_url, severity, failed): pre-aggregated counts of failed findings."""
    return findings.where(~F.col("passed")).groupBy("store_url", "severity").agg(
        F.count(F.lit(1)).alias("failed"))


def top_issues(with_array: DataFrame) -> DataFrame:
    """(store_url, severity, rank, issue): the first failed checks per severity."""
    def failed(severity):
        return F.filter("findings", lambda f: ~f["passed"] & (f["severity"] == severity))

    parts = [F.slice(failed(s), 1, n) for s, n in TOP_ISSUES.items()]
    ranked = [F.transform(p, lambda f, i: F.struct(
        f["severity"].alias("severity"), (i + 1).alias("rank"), f["issue"].alias("issue")))
        for p in parts]
    return with_array.select("store_url", F.inline(F.concat(*ranked)))


def passing_checks(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("passed") & (F.col("status") == "pass")).select(
        "store_url", "ord", "check_name", F.substring("evidence", 1, 80).alias("evidence"))


def executive_summary(store_url="store_url", overall="score_overall") -> Column:
    text = F
    for limit, sentence in SUMMARIES[:-1]:
        text = text.when(col(overall) >= limit, F.format_string(
            sentence, store_title(store_url), col(overall).cast("string")))
    return text.otherwise(F.format_string(
        SUMMARIES[-1][1], store_title(store_url), col(overall).cast("string")))


def audit_document(signals: DataFrame) -> DataFrame:
    """(store_url, audit_date, document struct): the nested audit of every store.

    `signals` also carries audit_date and audit_mode.
    """
    raw = F.struct(*[F.col(c) for c in signals.columns if c not in ("audit_date", "audit_mode")])
    full = with_findings(with_scores(signals))
    products = F.when(or_blank("product_url") != "", F.array("product_url")).otherwise(
        F.array().cast("array<string>"))
    scores = F.struct(
        F.struct(*[F.col(f"score_{c}").alias(c) for c in WEIGHTS]).alias("categories"),
        F.col("score_overall").alias("overall"))
    return full.select(
        "store_url", "audit_date",
        F.struct(
            "store_url", "audit_date", "audit_mode",
            F.concat(F.array("store_url"), products).alias("pages_crawled"),
            products.alias("product_pages"),
            F.struct(F.col("homepage_load_time").alias("homepage")).alias("load_times"),
            raw.alias("raw_findings"), F.col("findings"), scores.alias("scores"),
            failed_findings("findings").alias("results")).alias("document"))
