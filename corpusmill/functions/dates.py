"""Dates in the spellings that list pages use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_day(text: Column) -> Column:
    """The calendar day in ``text``, null where there is none.

    Reads year, month and day in this order with any of ``- . / 년 월`` between them, or eight
    digits without any; what follows (a clock time, a closing dot) is ignored, and so is white
    space around.  A day that is not in the calendar is null.
    """
    pattern = r"(?U)^\s*(\d{4})\s*[-./년]?\s*(\d{1,2})\s*[-./월]?\s*(\d{1,2})(?!\d)"
    compact = r"(?U)^\s*(\d{4})(\d{2})(\d{2})(?!\d)"
    part = lambda p, i: F.regexp_extract(text, p, i)
    joined = lambda p: F.concat_ws("-", part(p, 1), F.lpad(part(p, 2), 2, "0"), F.lpad(part(p, 3), 2, "0"))
    return F.when(text.rlike(compact), F.try_to_date(joined(compact), "yyyy-MM-dd")).when(text.rlike(pattern), F.try_to_date(joined(pattern), "yyyy-MM-dd"))


def lenient_date(text: Column) -> Column:
    """The date a text starts with: eight digits, year-month-day with ``- . /``, or a year alone or
    with a month, missing parts being 1.  Days that are not in the calendar are null."""
    bare = F.trim(text)
    compact = F.try_to_date(F.regexp_extract(bare, r"^(20\d{6})$", 1), "yyyyMMdd")
    strict = F.coalesce(*[F.try_to_date(F.regexp_extract(bare, f"^(\\d{{4}}{s}\\d{{2}}{s}\\d{{2}})$", 1), f"yyyy{c}MM{c}dd") for s, c in (("-", "-"), ("\\.", "."), ("/", "/"))])
    return F.coalesce(compact, strict, _first(F.regexp_extract_all(bare, F.lit(LOOSE), F.lit(0))))


# A year of this century, then perhaps a month and a day, as a whole and by its parts.
LOOSE = r"20\d{2}(?:[.\-/년]|\s*학년도)?\s*(?:\d{1,2})?[.\-/월]?\s*(?:\d{1,2})?"
_PARTS = r"(20\d{2})(?:[.\-/년]|\s*학년도)?\s*(\d{1,2})?[.\-/월]?\s*(\d{1,2})?"


def _one(match: Column) -> Column:
    number = lambda i: F.coalesce(F.nullif(F.regexp_extract(match, _PARTS, i), F.lit("")), F.lit("1"))
    return F.try_to_date(F.concat_ws("-", F.regexp_extract(match, _PARTS, 1), F.lpad(number(2), 2, "0"), F.lpad(number(3), 2, "0")), "yyyy-MM-dd")


def _first(matches: Column) -> Column:
    return F.when(F.size(matches) > 0, _one(F.get(matches, F.lit(0))))


def latest_date(*values: Column) -> Column:
    """The latest date in any of the texts, null when there is none."""
    found = [F.transform(F.regexp_extract_all(F.coalesce(v.cast("string"), F.lit("")), F.lit(LOOSE), F.lit(0)), _one) for v in values]
    parsed = F.array(*[lenient_date(v.cast("string")) for v in values])
    return F.array_max(F.filter(F.concat(parsed, *found), lambda d: d.isNotNull()))
