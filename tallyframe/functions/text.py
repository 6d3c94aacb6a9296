"""Text expressions: Unicode-aware trimming, case folding, normal forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space in Unicode's sense (fixed values).
WHITE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Without white space (in Unicode's sense) at either end."""
    return F.btrim(c, F.lit(WHITE))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def casefold(c: Column) -> Column:
    """Lower case with the common full foldings that ``lower`` leaves out."""
    return F.translate(F.regexp_replace(F.regexp_replace(F.lower(c), "[ßẞ]", "ss"), "ſ", "s"), "ς", "σ")


def latin_only(c: Column) -> Column:
    """Runs of characters beyond Latin Extended-B become one space."""
    return F.regexp_replace(c, r"[^\x{0}-\x{24F}]+", " ")


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.length(strip(c)) == 0)


def clean(c: Column, null_tokens: Sequence[str], strip_non_english: bool = False) -> Column:
    """A cell's text with single spaces, null where it is empty or a null token."""
    s = strip(c)
    if strip_non_english:
        s = strip(latin_only(s))
    return F.when((s == "") | F.lower(s).isin(*null_tokens), None).otherwise(collapse(s))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)


def header_form(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def label_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def token_sorted(c: Column) -> Column:
    """White-space tokens in order, joined by single spaces."""
    return F.array_join(F.array_sort(F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")), " ")
