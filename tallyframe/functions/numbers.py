"""Decimal-safe numbers from messy cells, as one Catalyst expression."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip

#: All amounts have this type; sums of it keep six decimals.
MONEY = "decimal(28,6)"
#: Symbols that are dropped from amounts (fixed values).
CURRENCY_SYMBOLS = "$€£¥₹¢₩"
#: Digits of other scripts and their values.
_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹０１２３４５６７８９"


#: Most numbers; they need no further reading (fixed pattern).
_SIMPLE = r"^-?[0-9]{1,20}(\.[0-9]{1,12})?$"
#: A number whose parentheses stand as ``~`` and ``^``.
_NUMBER = r"^(?:~[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)%?\^|[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)%?)$"
#: Where commas go: they set thousands apart throughout, or a point comes last.
_COMMAS_GO = r"^~?-?[0-9]{1,3}(?:,[0-9]{3}){1,13}[%^]*$|\.[^,]*$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, and apart from the generated code around it: methods of many such
    expressions would grow too large for the JVM to compile.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chain(c: Column, steps: Sequence[tuple[str, str]]) -> Column:
    for pattern, new in steps:
        c = F.regexp_replace(c, pattern, new)
    return c


def _plain(s: Column) -> Column:
    """``[~][+-]digits[.digits][%][^]`` (``~^``: in parentheses) of a trimmed text, empty where it is no number."""
    bare = F.translate(s, _DIGITS + "()~^" + CURRENCY_SYMBOLS + " _", "0123456789" * 3 + "~^xx")
    one = let(bare, lambda b: F.when(~b.contains(","), b).when(b.rlike(_COMMAS_GO), F.translate(b, ",", "")).otherwise(F.translate(b, ",.", ".")))
    return F.when(~s.contains("(") | (s.startswith("(") & s.endswith(")")), F.regexp_extract(one, _NUMBER, 0)).otherwise("")


def _read(c: Column, null_tokens: Sequence[str], simple: Callable[[Column], Column], other: Callable[[Column, Column], Column]) -> Column:
    """A cell read by ``simple`` where it is a plain number, else by ``other`` from its trimmed text and its :func:`_plain` form."""
    tokens = [t for t in null_tokens if any(x.isdigit() for x in t)]  # the others are no numbers anyway

    def use(s: Column) -> Column:
        read = F.when(s.rlike(_SIMPLE), simple(s)).otherwise(let(_plain(s), lambda p: other(s, p)))
        return F.when(~F.lower(s).isin(*tokens), read) if tokens else read

    return let(strip(c.cast("string")), use)


def decimal_text(c: Column, null_tokens: Sequence[str] = ()) -> Column:
    """A number's literal, with the decimals it was written with: what keys and duplicates are told by."""
    shorter = lambda s: _chain(s, ((r"^(~?-?)0+(?=[0-9])", "$1"), (r"^(~?-?)\.", "$10."), (r"\.(?=%?$)", ""), ("^~-", ""), (r"^[~-]+(?=0*\.?0*%?$)", ""), ("^~", "-")))

    def other(s: Column, plain: Column) -> Column:
        def text(literal: Column) -> Column:
            hundredth = (F.translate(literal, "%", "").try_cast("decimal(36,12)") * F.lit("0.01").cast("decimal(2,2)")).cast("string")
            return F.when(literal.endswith("%"), _chain(hundredth, ((r"(\.[0-9]*?)0+$", "$1"), (r"\.$", "")))).otherwise(F.when(literal != "", literal))

        return let(shorter(F.translate(plain, "+^", "")), text)

    return _read(c, null_tokens, shorter, other)


def parse_decimal(c: Column, null_tokens: Sequence[str] = ()) -> Column:
    """A cell as ``decimal(28,6)``, null where it is no number."""

    def other(s: Column, plain: Column) -> Column:
        size = F.when(plain != "", F.translate(plain, "~^%+", "").try_cast("decimal(36,12)"))  # a failing cast is slow
        share = F.when(s.contains("%"), F.lit("0.01").cast("decimal(2,2)")).otherwise(F.lit("1").cast("decimal(3,2)"))
        return let(size, lambda v: F.when(s.startswith("("), (-v * share).try_cast(MONEY)).when(s.contains("%"), (v * share).try_cast(MONEY)).otherwise(v.try_cast(MONEY)))

    return _read(c, null_tokens, lambda s: s.try_cast("decimal(36,12)").try_cast(MONEY), other)


def number_of(c: Column, dtype: T.DataType, null_tokens: Sequence[str] = ()) -> Column:
    """:func:`parse_decimal` for a column of any type: numbers are taken as they are, booleans are none."""
    if isinstance(dtype, T.BooleanType | T.DateType | T.TimestampType):
        return F.lit(None).cast(MONEY)
    if isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c).try_cast(MONEY)
    if isinstance(dtype, T.NumericType):
        return c.try_cast(MONEY)
    return parse_decimal(c, null_tokens)


def number_text(c: Column, dtype: T.DataType, null_tokens: Sequence[str] = ()) -> Column:
    if isinstance(dtype, T.IntegralType | T.DecimalType):
        return c.cast("string")
    if isinstance(dtype, T.FractionalType):
        exact = F.regexp_replace(c.try_cast("decimal(38,12)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(exact)
    return decimal_text(c, null_tokens)


def quantize(c: Column, places: int = 2) -> Column:
    """Half up to so many places."""
    return F.round(c, places)
