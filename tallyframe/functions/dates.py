"""Dates from text in an ordered list of formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip

#: Formats by which a cell is read, month first and day first; a form that does not fit falls through to the next.
MONTH_FIRST = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "M/d/yyyy", "M-d-yyyy", "M.d.yyyy", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy")
DAY_FIRST = ("yyyy-d-M", "yyyy-M-d", "yyyy/d/M", "yyyy/M/d", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "M/d/yyyy", "M-d-yyyy", "M.d.yyyy")
SHORT_YEAR = {False: ("M/d/yy", "M-d-yy", "d/M/yy", "d-M-yy"), True: ("d/M/yy", "d-M-yy", "M/d/yy", "M-d-yy")}
FIRST_SHORT_YEAR = 1969
NAMED = ("d MMM yyyy", "d-MMM-yyyy", "d/MMM/yyyy", "d MMMM yyyy", "MMM d yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMMM d, yyyy", "d-MMM-yy", "d MMM yy", "MMM yyyy", "MMMM yyyy", "MMM-yyyy", "yyyyMMdd", "yyyy-MM", "yyyy")


def parse_date(c: Column, dayfirst: bool = False) -> Column:
    """A text as a date, null where none fits. A time of day after the date is dropped.

    ``dayfirst`` also swaps day and month of dates that begin with the year, where both readings exist.
    """
    s = F.regexp_replace(strip(c.cast("string")), r"[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(AM|PM|am|pm|Z|[+-]\d{2}:?\d{2})?$", "")
    formats = (DAY_FIRST if dayfirst else MONTH_FIRST) + SHORT_YEAR[dayfirst] + NAMED
    shaped = {"yyyy": r"^\d{4}$", "yyyyMMdd": r"^\d{8}$", "yyyy-MM": r"^\d{4}-\d{2}$"}
    found = [F.when(s.rlike(shaped.get(f, _shape(f))), _in_its_century(F.try_to_timestamp(F.initcap(s) if "MMM" in f else s, F.lit(f)).cast("date"), f)) for f in formats]
    return F.coalesce(*found)


def _in_its_century(day: Column, fmt: str) -> Column:
    """Years of two digits are 1969 to 2068."""
    if "yyyy" in fmt or "yy" not in fmt:
        return day
    return F.when(F.year(day) >= FIRST_SHORT_YEAR + 100, F.add_months(day, -1200)).otherwise(day)


def _shape(fmt: str) -> str:
    """A pattern of what a format can read, so that short years are not taken for long ones."""
    out = "^"
    i = 0
    while i < len(fmt):
        run = len(fmt) - i - len(fmt[i:].lstrip(fmt[i]))
        if fmt[i] == "y":
            out += r"\d{%d}" % run
        elif fmt[i] in "Md" and run < 3:
            out += r"\d{1,2}"
        elif fmt[i] == "M":
            out += r"[A-Za-z]{3}" if run == 3 else r"[A-Za-z]{3,9}"
        else:
            out += "\\" + fmt[i] if not fmt[i].isalnum() and fmt[i] != " " else fmt[i]
        i += run
    return out + "$"


def date_of(c: Column, dtype: T.DataType, dayfirst: bool = False) -> Column:
    if isinstance(dtype, T.DateType | T.TimestampType | T.TimestampNTZType):
        return c.cast("date")
    if isinstance(dtype, T.NumericType | T.BooleanType):
        return F.lit(None).cast("date")
    return parse_date(c, dayfirst)


def looks_like_date(c: Column) -> Column:
    return c.rlike(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}") | c.rlike(r"^\d{1,2}[-/ ][A-Za-z]{3}")
