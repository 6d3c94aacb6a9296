"""Wide tables into long ones: leading label columns stay, the others become period and value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text


def id_and_value_columns(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """The leading columns with under half numbers among their filled cells (at least the first), and the rest. One pass."""
    columns = list(columns or df.columns)
    shares = []
    for c in columns:
        filled = df[c].isNotNull() & (df[c].cast("string") != "")
        number = numbers.number_of(df[c], df.schema[c].dataType).isNotNull()
        shares.append(F.coalesce(F.try_divide(F.count_if(filled & number), F.count_if(filled)), F.lit(0.0)).alias(c))
    got = df.agg(*shares).first()
    ids: list[str] = []
    for c in columns:
        if (got[c] or 0.0) >= 0.5:
            break
        ids.append(c)
    ids = ids or columns[:1]
    return ids, [c for c in columns if c not in ids]


def melt(df: DataFrame, ids: Sequence[str] | None = None, values: Sequence[str] | None = None, period: str = "Period", value: str = "Value", drop_blank: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """``ids, period, value`` (text) for every filled value cell of rows that have a label. ``carry`` columns are kept."""
    if ids is None or values is None:
        found = id_and_value_columns(df, [c for c in df.columns if c not in carry])
        ids, values = ids or found[0], values or found[1]
    labelled = df.where(~F.forall(F.array(*[F.coalesce(df[c].cast("string"), F.lit("")) for c in ids]), lambda x: x == ""))
    if not values:
        return labelled.select(*carry, *ids, F.lit(None).cast("string").alias(period), F.lit(None).cast("string").alias(value)).limit(0)
    wide = labelled.select(*carry, *ids, *[F.col(f"`{c}`").cast("string").alias(c) for c in values])
    long = wide.unpivot([*carry, *ids], list(values), period, value)
    return long.where(F.col(value).isNotNull() & (F.col(value) != "")) if drop_blank else long


def has_value_column(df: DataFrame, value: str = "Value") -> bool:
    return value in df.columns


def pivot_long(df: DataFrame, ord_col: str = "ord") -> DataFrame:
    """A table to edit in long form, in the order of its rows and columns."""
    columns = [c for c in df.columns if c != ord_col]
    ids, values = id_and_value_columns(df, columns)
    long = melt(df, ids, values, carry=[ord_col])
    place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col("Period"))
    return long.withColumn(ord_col, F.col(ord_col).cast("long") * len(values) + place - 1)


def is_complex(columns: Sequence[str]) -> bool:
    return len(columns) >= 3


def cell_text(df: DataFrame, c: str):
    return text.or_empty(df[c])
