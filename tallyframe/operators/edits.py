"""Row and column edits of a table with an explicit order: promote a header, delete, rename, relabel, make long.

A table is a DataFrame of text columns and ``ord`` (0, 1, ... in order). After each edit rows are numbered anew.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reshape import pivot_long

ORD = "ord"


def unique_names(names: Iterable) -> list[str]:
    """Trimmed names, ``column`` for blank ones, repeats told apart by `` (n)``."""
    out: list[str] = []
    for raw in names:
        base = ("" if raw is None else str(raw)).strip() or "column"
        name, n = base, 2
        while name in out:
            name, n = f"{base} ({n})", n + 1
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ORD]


def numbered(df: DataFrame) -> DataFrame:
    """``ord`` counted from 0 without gathering the rows: offsets of ranges of rows, then places within them."""
    parts = df.sparkSession.sparkContext.defaultParallelism
    ranged = df.withColumn("__p", F.floor(F.col(ORD) / F.lit(1 << 16)))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    from pyspark.sql import Window

    offsets = sizes.coalesce(1).withColumn("__o", F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)))  # a row for 65,536 rows
    inner = Window.partitionBy("__p").orderBy(ORD)
    placed = ranged.repartition(max(parts, 1), "__p").withColumn("__r", F.row_number().over(inner))
    joined = placed.join(F.broadcast(offsets.select("__p", F.coalesce("__o", F.lit(0)).alias("__o"))), "__p")
    return joined.select((F.col("__o") + F.col("__r") - 1).cast("long").alias(ORD), *columns_of(df))


def promote_header(df: DataFrame, row: int) -> DataFrame:
    """Row ``row`` names the columns; it and the rows above go. A row that is not there changes nothing."""
    names = columns_of(df)
    head = df.where(F.col(ORD) == row).select(*names).first() if row >= 0 else None
    if head is None:
        return df
    kept = df.where(F.col(ORD) > row)
    return numbered(kept.select(ORD, *[F.col(f"`{a}`").alias(b) for a, b in zip(names, unique_names(head), strict=True)]))


def delete_rows(df: DataFrame, rows: Sequence[int]) -> DataFrame:
    return numbered(df.where(~F.col(ORD).isin(*map(int, rows)))) if rows else df


def rename_columns(df: DataFrame, names: Sequence) -> DataFrame:
    """By position; a blank or missing name keeps the old one."""
    old = columns_of(df)
    new = [str(n).strip() if n is not None and str(n).strip() else o for n, o in zip([*names, *[None] * len(old)], old, strict=False)]
    return df.select(ORD, *[F.col(f"`{a}`").alias(b) for a, b in zip(old, unique_names(new), strict=True)])


def edit_label(df: DataFrame, row: int, label: str) -> DataFrame:
    first = columns_of(df)[0]
    return df.withColumn(first, F.when(F.col(ORD) == row, F.lit(label)).otherwise(F.col(f"`{first}`")))


def apply_ops(df: DataFrame, ops: Sequence[dict]) -> DataFrame:
    """A list of edits, one after the other; unknown ones are passed over."""
    for op in ops:
        kind = op.get("op")
        if kind == "promote_header":
            df = promote_header(df, int(op.get("row", -1)))
        elif kind == "delete_rows":
            df = delete_rows(df, op.get("rows") or [])
        elif kind == "rename_columns":
            df = rename_columns(df, op.get("names") or [])
        elif kind == "edit_label":
            df = edit_label(df, int(op.get("row", -1)), str(op.get("text", "")))
        elif kind == "pivot_long":
            df = numbered(pivot_long(df))
    return df
