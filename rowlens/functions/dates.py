"""FN-11: which written form a date value uses. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowlens.functions.text import strip

# The closed set of date forms, in tie-break order.
DATE_FAMILIES = (
    "iso_year_month_day",
    "slash_year_first",
    "slash_numeric",
    "dot_numeric",
    "dash_numeric",
    "day_month_name_year",
    "month_name_day_year",
)

# English month names; three-letter forms follow by rule, plus `sept`.
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

_YEAR_FIRST = {
    "iso_year_month_day": r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$",
    "slash_year_first": r"^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})$",
}
_YEAR_LAST = r"^([0-9]{1,2})([/.-])([0-9]{1,2})\2([0-9]{4})$"
_SEPARATORS = {"/": "slash_numeric", ".": "dot_numeric", "-": "dash_numeric"}
_NAMED = {
    "day_month_name_year": (r"^([0-9]{1,2}) ([A-Za-z]{3,9}) ([0-9]{4})$", "$1", "$2", "$3"),
    "month_name_day_year": (r"^([A-Za-z]{3,9}) ([0-9]{1,2}),? ([0-9]{4})$", "$2", "$1", "$3"),
}


def _real(ymd: Column) -> Column:
    """Is a `year-month-day` text a real date? Year 0 is not a year."""
    return ymd.try_cast("date").isNotNull() & ~ymd.startswith("0000")


def _month(name: Column) -> Column:
    """Month number text of an English name, its three-letter form or `sept`; else no number."""
    low = F.lower(name)
    spellings = [*MONTHS, *[m[:3] for m in MONTHS], "sept"]
    place = F.instr(F.lit("".join(m[:3] for m in MONTHS)), F.substring(low, 1, 3))
    return F.when(low.isin(*spellings), F.floor((place + 2) / 3).cast("string")).otherwise("x")


def date_family(c: Column) -> Column:
    """The form of a date-like text, null when it is no real date in any of them.

    Numeric forms with the year last count when either day-month order gives a real date. The
    form is chosen first; one year-month-day text per form is then checked once.
    """
    s = strip(c)
    # Every form is short and starts or ends with a four-digit year.
    plausible = s.rlike(r"^(?=.{8,18}$)(?:[0-9]{4}[-/]|.*[ /.-][0-9]{4}$)")
    form = F.when(~plausible, F.lit(None))
    for family, pattern in _YEAR_FIRST.items():
        form = form.when(s.rlike(pattern), family)
    form = form.when(
        s.rlike(_YEAR_LAST),
        F.element_at(
            F.create_map(*[F.lit(x) for kv in _SEPARATORS.items() for x in kv]),
            F.regexp_replace(s, _YEAR_LAST, "$2"),
        ),
    )
    for family, (pattern, *_) in _NAMED.items():
        form = form.when(s.rlike(pattern), family)

    def named(pattern: str, day: str, month: str, year: str) -> Column:
        cut = F.split(F.regexp_replace(s, pattern, f"{year}|{month}|{day}"), "[|]")
        return F.concat_ws("-", F.get(cut, F.lit(0)), _month(F.get(cut, F.lit(1))), F.get(cut, F.lit(2)))

    year_first = F.regexp_replace(s, "/", "-")
    ymd = F.when(s.rlike("^[0-9]{4}"), year_first).when(
        s.rlike("^[0-9]{1,2}[/.-]"), F.regexp_replace(s, _YEAR_LAST, "$4-$3-$1")
    )
    day_name, name_day = _NAMED.values()
    ymd = ymd.when(s.rlike("^[0-9]"), named(*day_name)).otherwise(named(*name_day))
    swapped = F.regexp_replace(s, _YEAR_LAST, "$4-$1-$3")
    return F.when(form.isNotNull() & (_real(ymd) | _real(swapped)), form)
