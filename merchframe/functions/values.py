"""Flags, statuses and money."""

from pyspark.sql import Column, functions as F

from merchframe.functions.text import INTEGER, NUMBER, col, or_blank, strip
from merchframe.schema import FALSE_WORDS, STATUS_WORDS, TRUE_WORDS, UK_TAX_DIVISOR


def _word(c) -> Column:
    return F.lower(strip(or_blank(c)))


def norm_bool(c, default: str = "TRUE") -> Column:
    word = _word(c)
    return F.when(word.isin(FALSE_WORDS), "FALSE").when(word.isin(TRUE_WORDS), "TRUE").otherwise(
        default)


def norm_status(c) -> Column:
    word = _word(c)
    return F.when(word.isin([w for w in STATUS_WORDS if w != "active"]), F.initcap(word)).otherwise(
        "Active")


def norm_inventory_policy(c) -> Column:
    return F.when(F.contains(_word(c), F.lit("continue")), "CONTINUE").otherwise("DENY")


def split_option_values(c) -> Column:
    """Option values of a cell; markup is never split."""
    text = or_blank(c)
    markup = F.contains(text, F.lit("<")) & F.contains(text, F.lit(">"))
    parts = F.filter(F.transform(F.split(text, "[,;]"), strip), lambda x: x != "")
    return F.when(markup, F.array(strip(text))).otherwise(parts)


def fixed2(c) -> Column:
    """Two-digit text, rounded on the binary value (not on the printed decimal)."""
    return F.call_function("format_number", col(c), F.lit("0.00"))


def round1(c) -> Column:
    return F.call_function("format_number", col(c), F.lit("0.0")).cast("double")


def to_major_units(kind, text) -> Column:
    """Amount in major units of a JSON scalar given its type name and its text.

    Integers and digit strings are minor units; fractions and dotted strings are major units.
    """
    kind, text = col(kind), col(text)
    digits = strip(F.replace(strip(text), F.lit(","), F.lit("")))
    plain = F.replace(digits, F.lit("_"), F.lit(""))
    dotted = F.contains(digits, F.lit("."))
    big_integer = kind.rlike(r"^DECIMAL\((19|[23]\d),0\)$")
    amount = (
        F.when((kind == "BIGINT") | big_integer, F.try_divide(text.try_cast("double"), F.lit(100.0)))
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), text.try_cast("double"))
        .when((kind == "STRING") & dotted & digits.rlike(NUMBER), plain.try_cast("double"))
        .when((kind == "STRING") & ~dotted & digits.rlike(INTEGER),
              F.try_divide(plain.try_cast("double"), F.lit(100.0)))
    )
    return fixed2(amount).try_cast("double")


def normalize_prices(price_kind, price_text, compare_kind, compare_text, is_uk) -> Column:
    """struct(price, compare_at_price) as text; UK prices lose their tax."""
    compare_kind, compare_text = col(compare_kind), col(compare_text)
    inc = to_major_units(price_kind, price_text)
    ignored = (
        compare_text.isNull()
        | ((compare_kind == "STRING") & compare_text.isin("", "0"))
        | ((compare_kind != "STRING") & (compare_text.try_cast("double") == 0))
        | (compare_kind == "BOOLEAN")
    )
    compare = F.when(~ignored, to_major_units(compare_kind, compare_text))
    uk = col(is_uk) & inc.isNotNull()
    return F.struct(
        or_blank(F.when(uk, fixed2(inc / F.lit(UK_TAX_DIVISOR))).otherwise(fixed2(inc)))
        .alias("price"),
        or_blank(F.when(uk, fixed2(F.greatest(inc, compare))).otherwise(fixed2(compare)))
        .alias("compare_at_price"),
    )
