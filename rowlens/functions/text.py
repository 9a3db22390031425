"""Text predicates and scalar functions over string columns (FN-01..12, FN-18..20).

Everything here is a built-in expression, so it stays in the JVM. Only the name
key (FN-09) needs Unicode tables Spark does not have and runs as a Pandas UDF.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 29 characters that count as white space.
WHITESPACE = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
              *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
SPACE_CLASS = "".join(f"\\x{{{ord(ch):x}}}" for ch in WHITESPACE)

# The same class for the JVM: the characters beyond Latin-1 are only compared within their range.
_LATIN_SPACES = "".join(f"\\x{{{ord(ch):x}}}" for ch in WHITESPACE if ord(ch) < 256)
_WIDE_SPACES = "".join(f"\\x{{{ord(ch):x}}}" for ch in WHITESPACE if ord(ch) >= 256)
_SPACE = rf"[{_LATIN_SPACES}[\x{{1680}}-\x{{3000}}&&[{_WIDE_SPACES}]]]"

# The tokens type inference reads as boolean.
BOOLEAN_TOKENS = ("true", "false", "yes", "no")

# Spelling families of boolean words.
BOOLEAN_FAMILIES = {
    "true": "true/false", "false": "true/false",
    "yes": "yes/no", "no": "yes/no",
    "y": "y/n", "n": "y/n",
    "t": "t/f", "f": "t/f",
    "on": "on/off", "off": "on/off",
    "1": "1/0", "0": "1/0",
}

CURRENCY_SYMBOLS = "$€£¥"

_DIGITS = "[0-9](?:_?[0-9])*"
FLOAT_PATTERN = (
    rf"(?i)^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
    r"|inf(?:inity)?|nan)$"
)
ISO_DATE_PATTERN = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DECORATED_NUMBER_PATTERN = (
    rf"^[+-]?(?:[{CURRENCY_SYMBOLS}][+-]?)?"
    r"(?:(?:0|[1-9][0-9]*|[1-9][0-9]{0,2}(?:,[0-9]{3})+)(?:\.[0-9]+)?|\.[0-9]+)%?$"
)
EMAIL_PATTERN = (
    rf"^[^{SPACE_CLASS}@]+@[^{SPACE_CLASS}@.]+(?:\.[^{SPACE_CLASS}@.]+)+$"
)

COMPARISONS = {
    "equals": lambda a, b: a == b,
    "not_equals": lambda a, b: a != b,
    "less_than": lambda a, b: a < b,
    "less_than_or_equal": lambda a, b: a <= b,
    "greater_than": lambda a, b: a > b,
    "greater_than_or_equal": lambda a, b: a >= b,
}


def strip(c: Column) -> Column:
    """Both ends trimmed of every white-space character, not only U+0020."""
    return F.btrim(c, F.lit(WHITESPACE))


def collapse_spaces(c: Column) -> Column:
    """Every run of white space becomes one space. A single space is no match, so ordinary text
    is hardly rewritten."""
    return F.regexp_replace(c, f"{_SPACE}(?:{_SPACE}+|(?<! ))", " ")


def is_missing(c: Column) -> Column:
    """FN-01: null or the empty string."""
    return c.isNull() | (c == "")


def is_blank(c: Column) -> Column:
    """FN-02: missing, or white space only."""
    return c.isNull() | (strip(c) == "")


def casing_key(c: Column) -> Column:
    """FN-12."""
    return F.lower(strip(c))


def is_boolean(c: Column) -> Column:
    """FN-03."""
    return casing_key(c).isin(*BOOLEAN_TOKENS)


def iso_date(c: Column) -> Column:
    """The date a `YYYY-MM-DD` text stands for, else null (year 0 is not a year)."""
    s = strip(c)
    return F.when(s.rlike(ISO_DATE_PATTERN) & ~s.startswith("0000"), s.try_cast("date"))


def is_iso_date(c: Column) -> Column:
    """FN-04."""
    return iso_date(c).isNotNull()


def rule_date(c: Column) -> Column:
    """Dates as rules read them: `YYYY-MM-DD` or the compact `YYYYMMDD`."""
    s = strip(c)
    dashed = F.when(
        s.rlike("^[0-9]{8}$"),
        F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2)),
    ).otherwise(s)
    return iso_date(dashed)


def is_numeric(c: Column) -> Column:
    """FN-05: the text forms a floating-point literal may take."""
    return strip(c).rlike(FLOAT_PATTERN)


def to_double(c: Column) -> Column:
    """The number a text stands for, else null; signed `nan` is read as NaN."""
    s = strip(c)
    return F.when(
        s.rlike(FLOAT_PATTERN),
        F.when(F.lower(s).endswith("nan"), F.lit(float("nan"))).otherwise(
            F.replace(s, F.lit("_"), F.lit("")).try_cast("double")
        ),
    )


def value_shape(c: Column) -> Column:
    """FN-06: boolean, then date, then numeric, then text."""
    return (
        F.when(is_boolean(c), "boolean")
        .when(is_iso_date(c), "date")
        .when(is_numeric(c), "numeric")
        .otherwise("text")
    )


def is_decorated_or_plain_number(c: Column) -> Column:
    """FN-07, first half: does the text read as a number?"""
    return strip(c).rlike(DECORATED_NUMBER_PATTERN)


def number_decorations(c: Column) -> Column:
    """FN-07, second half: the decorations a number carries (empty array if none)."""
    s = strip(c)
    return F.when(
        s.rlike(DECORATED_NUMBER_PATTERN),
        F.array_compact(
            F.array(
                F.when(s.rlike(f"[{CURRENCY_SYMBOLS}]"), "currency symbol"),
                F.when(s.endswith("%"), "percent sign"),
                F.when(s.contains(","), "thousands separator"),
            )
        ),
    )


def near_duplicate_key(c: Column) -> Column:
    """FN-08: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def usable_near_duplicate_key(key: Column) -> Column:
    return (F.length(key) >= 2) & ~key.rlike("^[0-9]+$")


def name_key(c: Column) -> Column:
    """FN-09: compatibility-folded letters, digits and marks; the exact text if none remain."""

    # Local, so that it travels to the workers by value and needs no import there.
    def fold(name: str) -> str:
        folded = unicodedata.normalize("NFKC", name).casefold()
        kept = "".join(ch for ch in folded if unicodedata.category(ch)[0] in "LNM")
        return "k:" + kept if kept else "x:" + name

    def fold_all(names: pd.Series) -> pd.Series:
        return names.map(fold, na_action="ignore")

    return F.pandas_udf(fold_all, T.StringType())(c)


def has_email_shape(c: Column) -> Column:
    """FN-10: local@domain.tld."""
    return c.contains("@") & c.rlike(EMAIL_PATTERN)


def compare(left: Column, operator: str, right: Column) -> Column:
    """FN-18. NaN compares false with everything (and is unequal to everything)."""
    verdict = COMPARISONS[operator](left, right)
    either_nan = F.isnan(left) | F.isnan(right)
    return (either_nan | verdict) if operator == "not_equals" else (~either_nan & verdict)


def markdown(c: Column, limit: int = 300) -> Column:
    """FN-19: white space collapsed, bounded, and Markdown characters escaped."""
    flat = strip(collapse_spaces(c))
    bounded = F.when(
        F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))
    ).otherwise(flat)
    return F.regexp_replace(bounded, r"([\\`*_{}\[\]<>#|!~&])", r"\\$1")


def recomputed_total(quantity: Column, price: Column, discount: Column, tax: Column) -> Column:
    """FN-20: quantity x price x (1 - discount/100) x (1 + tax/100)."""
    return quantity * price * (1 - discount / 100) * (1 + tax / 100)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
