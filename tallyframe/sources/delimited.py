"""Delimited files of any size as records in order, delimiter guessed, read in splits.

Spark's text reader splits files anywhere between lines. Whether a line goes on with a quoted field of the line before it
follows from the number of quotes ahead of it in its file; that is summed within each split and carried from split to split by
a table with one row a split. So no file is read by one task, and a quoted line break may stand at the border of two splits.
"""

from __future__ import annotations

import csv

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import written
from .files import DELIMITERS, SNIFFED


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, split, n, line``: ``split`` is where the split of a line begins in its file, ``n`` rises within it."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    return raw.select("file", "split", F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", "\r$", "").alias("line"))


def delimiters(rows: DataFrame) -> DataFrame:
    """``file, delimiter`` guessed from the first characters of each file."""
    first = rows.where("split = 0").withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("n"))).where(F.col("k") <= SNIFFED // 16)
    heads = first.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.substring("line", 1, SNIFFED).alias("line")))), lambda x: x["line"]), "\n").alias("head"))

    def guess(files: pd.Series, heads: pd.Series) -> pd.Series:
        out = []
        for file, head in zip(files, heads, strict=True):
            try:
                out.append(csv.Sniffer().sniff(head[:SNIFFED], DELIMITERS).delimiter)
            except csv.Error:
                out.append("\t" if file.lower().endswith(".tsv") else ",")
        return pd.Series(out, dtype=object)

    return heads.select("file", F.pandas_udf(guess, "string")("file", "head").alias("delimiter"))


def records(rows: DataFrame) -> DataFrame:
    """``file, split, n, text`` of each record: a line and those that a quoted line break joins to it, in order of ``file, split, n``."""
    quotes = F.length("line") - F.length(F.translate("line", '"', ""))
    counted = rows.withColumn("quotes", quotes)
    of_file, in_split = Window.partitionBy("file").orderBy("split"), Window.partitionBy("file", "split").orderBy("n")
    ahead = counted.groupBy("file", "split").agg(F.sum("quotes").alias("q"))
    carried = ahead.select("file", "split", F.coalesce(F.sum("q").over(of_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carried"))
    before = F.coalesce(F.sum("quotes").over(in_split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("carried")
    marked = counted.join(carried, ["file", "split"]).withColumn("begins", before % 2 == 0)
    place = F.struct("split", "n")
    own = F.last(F.when(F.col("begins"), place), ignorenulls=True).over(in_split)
    marked = written(marked.withColumn("own", own).select("file", "split", "n", "line", "begins", "own"))
    last = marked.groupBy("file", "split").agg(F.max("own").alias("last"))
    earlier = last.select("file", "split", F.last("last", ignorenulls=True).over(of_file.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    going_on = marked.where("not begins").join(earlier, ["file", "split"]).select("file", F.coalesce("own", "earlier").alias("of"), F.struct("split", "n", "line").alias("x"))
    rest = going_on.groupBy("file", "of").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]).alias("more")).select("file", "of.split", "of.n", "more")
    whole = marked.where("begins").select("file", "split", "n", "line").join(rest, ["file", "split", "n"], "left")
    return whole.select("file", "split", "n", F.when(F.col("more").isNull(), F.col("line")).otherwise(F.concat_ws("\n", F.col("line"), "more")).alias("text"))


def read_large(spark: SparkSession, path: str | list[str], delimiter: str | None = None) -> DataFrame:
    """``ord`` (file, split and place in it) and the columns of the first file's header, all texts; every file has a header. Blank lines go.

    Where no delimiter is given, each file's is guessed. A row that is short has nulls, and what is beyond the header goes.
    """
    rows = lines(spark, path)
    found = records(rows).where(F.trim("text") != "")
    kinds = rows.select("file").distinct().withColumn("delimiter", F.lit(delimiter)) if delimiter else written(delimiters(rows))
    found = written(found.join(kinds, "file"))
    top = found.groupBy("file").agg(F.min(F.struct("split", "n")).alias("top"))
    first = found.where("split = 0").orderBy("file", "n").first()
    if first is None:
        return spark.createDataFrame([], "ord struct<file:string,split:bigint,n:bigint>")
    names = next(csv.reader([first["text"]], delimiter=first["delimiter"]))
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    body = found.join(top, "file").where(F.struct("split", "n") != F.col("top"))
    parsed: Column = F.lit(None)
    for d in [r["delimiter"] for r in kinds.select("delimiter").distinct().collect()]:  # four at most, or the one given
        cells = F.from_csv("text", schema, {"sep": d, "escape": '"', "multiLine": "true"})
        parsed = F.when(F.col("delimiter") == d, cells).otherwise(parsed)
    return body.select(F.struct("file", "split", "n").alias("ord"), parsed.alias("x")).select("ord", *[F.col(f"x.c{i}").alias(n) for i, n in enumerate(names)])
