"""String columns: trimming, blank words, header tests, slugs."""

from pyspark.sql import Column, functions as F

from merchframe.schema import NULL_WORDS

# Every character Python's str.strip() removes, so that trimming needs no regex.
WHITESPACE = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))
SPACE_CLASS = r"[\s\x1c-\x1f\x85\p{Z}]"

# Text that reads as a number once thousands commas are gone.
NUMBER = (
    r"(?i)^[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?$"
    r"|^[+-]?(inf|infinity|nan)$"
)
INTEGER = r"^[+-]?\d+(_\d+)*$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.trim(col(c), F.lit(WHITESPACE))


def or_blank(c) -> Column:
    return F.coalesce(col(c), F.lit(""))


def first_text(*cs) -> Column:
    """First of the columns that is neither NULL nor empty, else an empty string."""
    # A filter names each column once; nullif would copy its expression.
    filled = F.filter(F.array(*[col(c) for c in cs]), lambda c: c != "")
    return F.coalesce(F.get(filled, F.lit(0)), F.lit(""))


def clean_value(c) -> Column:
    text = strip(or_blank(c))
    return F.when(F.lower(text).isin(NULL_WORDS), "").otherwise(text)


def is_nonempty(c) -> Column:
    return clean_value(c) != ""


def is_number(c) -> Column:
    return strip(F.replace(col(c), F.lit(","), F.lit(""))).rlike(NUMBER)


def is_header_string(c) -> Column:
    text = clean_value(c)
    return (text != "") & ~is_number(text)


def normalize_header(c) -> Column:
    text = F.replace(F.lower(strip(or_blank(c))), F.lit("_"), F.lit(" "))
    text = F.regexp_replace(text, f"{SPACE_CLASS}*/{SPACE_CLASS}*", "/")
    return strip(F.regexp_replace(text, f"{SPACE_CLASS}+", " "))


def _lowered(c) -> Column:
    return F.lower(strip(or_blank(c)))


def slugify(c) -> Column:
    return F.trim(F.regexp_replace(_lowered(c), "[^a-z0-9]+", "-"), F.lit("-"))


def filename_slug(c) -> Column:
    dashed = F.regexp_replace(_lowered(c), f"{SPACE_CLASS}+", "-")
    kept = F.regexp_replace(dashed, "[^a-z0-9-]+", "")
    return F.trim(F.regexp_replace(kept, "-{2,}", "-"), F.lit("-"))


def upload_filename_slug(c) -> Column:
    # Blanks and every other odd character become one underscore, so one class covers both.
    return F.trim(F.regexp_replace(_lowered(c), "[^a-z0-9]+", "_"), F.lit("_"))


def contains_any(text: Column, words) -> Column:
    """True when any of a fixed list of words occurs in the text."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def first_word_found(text: Column, words) -> Column:
    """The first word of a fixed list that occurs in the text, else NULL."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words])
