"""Subtotals of a financial table, worked out again from its parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text

#: Subtotal, what adds to it, what is taken from it; labels without case and punctuation (fixed values).
CHAINS = (
    ("grossprofit", ("revenue",), ("costofsales",)),
    ("ebitda", ("grossprofit",), ("operatingexpenses",)),
    ("operatingprofitebit", ("ebitda",), ("depreciationamortisation",)),
    ("profitbeforetax", ("operatingprofitebit",), ("netfinancecosts",)),
    ("netprofitaftertax", ("profitbeforetax",), ("incometaxexpense",)),
    ("profitfortheperiod", ("profitbeforetaxation",), ("taxation",)),
    ("operatingprofitbeforeimpairmentandtaxation", ("operatingincome",), ("operatingexpenses",)),
)
SLACK = 1.0
MAX_FAILURES = 5
SCHEMA = "checked long, passed long, status string, failures array<string>"


def _general(c):
    """A number with six significant digits at most and no trailing zeros."""
    digits = F.greatest(F.lit(0), F.lit(5) - F.floor(F.log10(F.greatest(F.abs(c), F.lit(1e-9)))).cast("int"))
    rounded = F.when(c == 0, F.lit("0")).otherwise(F.format_string("%.6f", F.bround(c * F.pow(F.lit(10.0), digits), 0) / F.pow(F.lit(10.0), digits)))
    return F.regexp_replace(F.regexp_replace(rounded, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def checks(df: DataFrame, ord_cols: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """``chain, target, column, n, got, expected, passed``: one row a chain and value column that can be checked.

    Only rows whose label takes part in a chain leave the scan; of equal labels the last row counts.
    """
    columns = list(columns or [c for c in df.columns if c not in ord_cols])
    label, values = columns[0], columns[1:]
    needed = sorted({x for target, adds, subs in CHAINS for x in (target, *adds, *subs)})
    number = {v: numbers.number_of(df[v], df.schema[v].dataType).cast("double") for v in values}
    rows = df.select(text.label_key(text.or_empty(df[label])).alias("k"), F.struct(*[df[c] for c in ord_cols]).alias("o"), F.array(*[number[v] for v in values]).cast("array<double>").alias("v")).where(F.col("k").isin(*needed))
    last = rows.groupBy("k").agg(F.max_by("v", "o").alias("v"))
    cells = last.select("k", F.posexplode("v").alias("n", "v"))
    parts = [(i, target, k, role) for i, (target, adds, subs) in enumerate(CHAINS) for role, names in (("got", (target,)), ("add", adds), ("sub", subs)) for k in names]
    rules = F.broadcast(df.sparkSession.createDataFrame(parts, "chain int, target string, k string, part string"))  # the fixed rules above
    total = lambda part: F.sum(F.when(F.col("part") == part, F.col("v")))
    filled = lambda part: F.count(F.when(F.col("part") == part, F.col("v")))
    sums = cells.join(rules, "k").groupBy("chain", "target", "n").agg(total("got").alias("got"), total("add").alias("plus"), total("sub").alias("minus"), filled("add").alias("adds"), filled("sub").alias("subs"))
    needs = F.create_map(*[F.lit(x) for i, (_, adds, subs) in enumerate(CHAINS) for x in (i, len(adds) * 100 + len(subs))])
    whole = sums.where(F.col("got").isNotNull() & (F.col("adds") * 100 + F.col("subs") == needs[F.col("chain")]))
    signed, taken = F.col("plus") + F.col("minus"), F.col("plus") - F.col("minus")
    near = F.least(F.abs(signed - F.col("got")), F.abs(taken - F.col("got"))) <= SLACK
    return whole.select("chain", "target", F.array(*map(F.lit, values))[F.col("n")].alias("column"), "n", "got", signed.alias("expected"), near.alias("passed"))


def subtotals(df: DataFrame, ord_cols: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """``checked, passed, status, failures``: n/a if nothing could be checked, ok if all passed, else check."""
    said = F.concat(F.col("target"), F.lit("["), F.col("column"), F.lit("]: got "), _general(F.col("got")), F.lit(", expected "), _general(F.col("expected")))
    rows = checks(df, ord_cols, columns).withColumn("said", F.when(~F.col("passed"), F.struct("chain", "n", said.alias("text"))))
    total = rows.agg(F.count("*").alias("checked"), F.count_if("passed").alias("passed"), F.transform(F.slice(F.array_sort(F.collect_list("said")), 1, MAX_FAILURES), lambda x: x["text"]).alias("failures"))
    status = F.when(F.col("checked") == 0, "n/a").when(F.col("passed") == F.col("checked"), "ok").otherwise("check")
    return total.select("checked", "passed", status.alias("status"), "failures")
