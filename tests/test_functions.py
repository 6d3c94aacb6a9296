"""Decision tables of the scalar functions."""

from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.config import NULL_TOKENS
from tallyframe.functions import dates, numbers, similarity, text

NUMBERS = {
    "": None,
    "n/a": None,
    "NA": None,
    "(1,234.5)": "-1234.5",
    "(-5)": "5",
    "$5": "5",
    "£ 5": "5",
    "5 €": "5",
    "$(5)": None,
    "(5)%": None,
    "(5%)": "-0.05",
    "45%": "0.45",
    "USD 5": None,
    "INV-1001": None,
    "1e3": None,
    "1,234.56": "1234.56",
    "1.234,56": "1234.56",
    "1,234": "1234",
    "12,345,678": "12345678",
    "0,5": "0.5",
    "1,23": "1.23",
    "+1,234": "1.234",
    "12,345,67": None,
    "1.2.3": None,
    "--5": None,
    "5-": None,
    "-": None,
    ".": None,
    "-.": None,
    "1_000": "1000",
    "٣": "3",
    "2024-01-05": None,
    "007": "7",
    ".50": "0.50",
    "5.": "5",
    " 12 ": "12",
    "(0)": "0",
}


def test_parse_decimal(spark):
    rows = spark.createDataFrame(list(enumerate(NUMBERS)), "i int, s string")
    got = rows.select("s", numbers.parse_decimal(F.col("s"), NULL_TOKENS).alias("v"), numbers.decimal_text(F.col("s"), NULL_TOKENS).alias("t")).collect()
    for r in got:
        want = NUMBERS[r["s"]]
        assert (r["v"], r["t"]) == (None if want is None else Decimal(want).quantize(Decimal("0.000001")), want), r["s"]


def test_typed_numbers(spark):
    df = spark.sql("select 5 as i, 5.0d as f, true as b, double('nan') as n, date'2024-01-05' as d, cast('1.50' as decimal(10,2)) as m, 12345678.5d as big")
    value = {c: numbers.number_of(df[c], df.schema[c].dataType).alias(c) for c in df.columns}
    words = {c: numbers.number_text(df[c], df.schema[c].dataType).alias(c) for c in df.columns}
    assert df.select(*value.values()).first() == (Decimal(5), Decimal(5), None, None, None, Decimal("1.5"), Decimal("12345678.5"))
    assert df.select(*words.values()).first() == ("5", "5.0", None, None, None, "1.50", "12345678.5")


@pytest.mark.parametrize(
    "text_, dayfirst, want",
    [
        ("01/02/2024", False, "2024-01-02"),
        ("01/02/2024", True, "2024-02-01"),
        ("13/01/2024", False, "2024-01-13"),
        ("13/01/2024", True, "2024-01-13"),
        ("2024-01-05", False, "2024-01-05"),
        ("2024-01-05", True, "2024-05-01"),
        ("2024", False, "2024-01-01"),
        ("Jan 2024", False, "2024-01-01"),
        ("5 Jan 2024", False, "2024-01-05"),
        ("5-jan-2024 10:20", False, "2024-01-05"),
        ("Q1 2024", False, None),
        ("", False, None),
    ],
)
def test_parse_date(spark, text_, dayfirst, want):
    got = spark.createDataFrame([(text_,)], "s string").select(dates.parse_date(F.col("s"), dayfirst).cast("string")).first()[0]
    assert got == want


def test_text(spark):
    df = spark.createDataFrame([(" Straße   İx ",), ("N/A",), (None,), ("漢字 abc",)], "s string")
    assert [r[0] for r in df.select(text.clean(F.col("s"), NULL_TOKENS)).collect()] == ["Straße İx", None, None, "漢字 abc"]
    assert [r[0] for r in df.select(text.clean(F.col("s"), NULL_TOKENS, True)).collect()][3] == "abc"
    assert df.select(text.casefold(F.col("s"))).first()[0].strip().startswith("strasse")


def naive(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(st.text("abc ", max_size=30), st.text("abc ", max_size=30))
def test_common_subsequence(a, b):
    assert similarity.common_subsequence(a, b) == naive(a, b)


def test_similarity(spark):
    df = spark.createDataFrame([("acme corp ltd", "ltd acme corp"), ("inv-1003", "inv-1004"), ("", ""), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(similarity.similarity(F.col("a"), F.col("b"))).collect()] == [100.0, 87.5, 100.0, 0.0]
