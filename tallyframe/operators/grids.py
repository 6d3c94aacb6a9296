"""From cells of grids to tables: regions, header rows, names, records. All as windows over long cells.

Cells are ``doc_id, grid_id, r, c, text, kind`` (kind: str, int, float, bool or date); an empty cell need not be
there. A record is ``doc_id, table_name, row_index, columns, values`` with ``values`` a map of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..plans.scratch import cut

CELLS = "doc_id string, grid_id string, r int, c int, text string, kind string"
#: Rows in which a header is looked for, rows below that speak for it, further rows that may belong to it.
SCAN, LOOKAHEAD, BAND = 25, 8, 3
#: Share of numbers from which a row after a gap goes on with the table above (fixed value).
NEW_TABLE_NUMBERS = 0.34
GRID = ["doc_id", "grid_id"]


def shown(c: Column, kind: Column) -> Column:
    """A cell as a label: whole floats without decimals, else trimmed."""
    whole = F.regexp_replace(text.strip(c), r"\.0+$", "")
    return F.when((kind == "float") & c.rlike(r"^-?[0-9]+\.0+$"), whole).otherwise(text.strip(c))


def flagged(cells: DataFrame) -> DataFrame:
    """Filled cells with ``is_num, is_text`` and their label."""
    filled = cells.where(~text.is_blank(F.col("text")))
    number = F.col("kind").isin("int", "float") | ((F.col("kind") == "str") & numbers.parse_decimal(F.col("text")).isNotNull())
    return filled.withColumns({"is_num": number, "label": shown(F.col("text"), F.col("kind"))}).withColumn("is_text", ~F.col("is_num") & (F.col("kind") != "date"))


def _islands(gap: Column, over) -> Column:
    return F.sum(F.when(gap, 1).otherwise(0)).over(over)


def regions(cells: DataFrame, min_rows: int = 2, min_cols: int = 2) -> DataFrame:
    """Filled cells of each region with ``region`` (1, 2, ... in a grid), rows and columns counted anew from 0, and its size.

    Rows are cut at gaps, but a block after a gap stays with the one above unless it opens like a table
    (two cells or more, few numbers). Blocks are cut at empty columns.
    """
    own = flagged(cells)
    rows = own.groupBy(*GRID, "r").agg(F.count("*").alias("n"), F.count_if("is_num").alias("numbers"))
    down = Window.partitionBy(*GRID).orderBy("r")
    opens = (F.col("n") >= 2) & (F.col("numbers") / F.col("n") < NEW_TABLE_NUMBERS)
    gap = F.col("r") - F.lag("r").over(down) > 1
    rows = rows.withColumn("cut", F.coalesce(gap & opens, F.lit(False))).withColumn("block", _islands(F.col("cut"), down)).select(*GRID, "r", "block")
    own = own.join(rows, [*GRID, "r"])
    across = Window.partitionBy(*GRID, "block").orderBy("c")
    columns = own.select(*GRID, "block", "c").distinct().withColumn("cut", F.coalesce(F.col("c") - F.lag("c").over(across) > 1, F.lit(False)))
    columns = columns.withColumn("part", _islands(F.col("cut"), across)).select(*GRID, "block", "c", "part")
    own = own.join(columns, [*GRID, "block", "c"])
    area = Window.partitionBy(*GRID, "block", "part")
    own = own.withColumns({"r": F.dense_rank().over(area.orderBy("r")) - 1, "c": F.dense_rank().over(area.orderBy("c")) - 1})
    own = own.withColumns({"rows": F.max("r").over(area) + 1, "cols": F.max("c").over(area) + 1}).where((F.col("rows") >= min_rows) & (F.col("cols") >= min_cols))
    return own.withColumn("region", F.dense_rank().over(Window.partitionBy(*GRID).orderBy("block", "part"))).drop("block", "part")


REGION = [*GRID, "region"]


def header_scores(cells: DataFrame) -> DataFrame:
    """Of each row of a region: its header likeness, the likeness of what is below, and the score of both."""
    rows = cells.groupBy(*REGION, "r").agg(
        F.count("*").alias("n"),
        F.first("rows").alias("rows"),
        F.first("cols").alias("cols"),
        F.avg(F.col("is_num").cast("int")).alias("num"),
        F.avg(F.col("is_text").cast("int")).alias("txt"),
        (F.count_distinct(F.lower("label")) / F.count("*")).alias("unique"),
        F.count_if(F.col("c") == 0).alias("first_filled"),
    )
    below = Window.partitionBy(*REGION).orderBy("r").rowsBetween(1, LOOKAHEAD)
    data = F.avg(F.col("n") / F.col("cols")).over(below) + 0.6 * F.avg("num").over(below)
    head = F.when(F.col("n") >= 2, F.col("n") / F.col("cols") + 1.2 * F.col("txt") + F.col("unique") - F.col("num"))
    return rows.withColumns({"header": head, "below": data}).withColumn("score", F.when(F.col("r") < F.greatest(F.least(F.lit(SCAN), F.col("rows") - 1), F.lit(1)), F.col("header") + 0.8 * F.col("below")))


def headers(cells: DataFrame) -> DataFrame:
    """``first, last``: the rows of each region's header. The best score wins, the first of equals; further rows without a label but with two values belong to it."""
    scores = header_scores(cells)
    best = scores.groupBy(*REGION).agg(F.coalesce(F.min_by("r", F.when(F.col("score").isNotNull(), F.struct(-F.round("score", 9), F.col("r")))), F.lit(0)).alias("first"))
    near = scores.join(best, REGION).where((F.col("r") > F.col("first")) & (F.col("r") <= F.col("first") + BAND) & (F.col("r") < F.col("rows") - 1))
    tier = (F.col("first_filled") == 0) & (F.col("n") >= 2)
    running = Window.partitionBy(*REGION).orderBy("r")
    band = near.withColumn("ok", F.min(tier.cast("int")).over(running)).groupBy(*REGION).agg(F.sum("ok").alias("more"))
    return best.join(band, REGION, "left").select(*REGION, "first", (F.col("first") + F.coalesce("more", F.lit(0))).cast("int").alias("last"))


def column_names(cells: DataFrame, found: DataFrame) -> DataFrame:
    """``c, name`` of each column of a region; blank ones are ``col_i``, repeats get ``_1, _2, ...``."""
    top = cells.join(found, REGION).where((F.col("r") >= F.col("first")) & (F.col("r") <= F.col("last")))
    said = top.groupBy(*REGION, "c").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"])), " ").alias("name"))
    every = cells.groupBy(*REGION).agg(F.first("cols").alias("cols")).select(*REGION, F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c"))
    named = every.join(said, [*REGION, "c"], "left").withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("col_"), F.col("c").cast("string"))))
    again = F.row_number().over(Window.partitionBy(*REGION, "name").orderBy("c")) - 1
    return named.withColumn("again", again).select(*REGION, "c", F.when(F.col("again") > 0, F.concat_ws("_", "name", F.col("again").cast("string"))).otherwise(F.col("name")).alias("name"))


def tables(cells: DataFrame) -> DataFrame:
    """``doc_id, table_name, row_index, columns, values, kinds``: the records of all tables of all grids.

    The only region of a grid takes the grid's name; of several the i-th takes ``name#i``.
    """
    own = cut(regions(cells))  # read by every step below
    found = cut(headers(own))
    names = column_names(own, found)
    listed = names.groupBy(*REGION).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "name"))), lambda x: x["name"]).alias("columns"))
    body = own.join(found, REGION).where(F.col("r") > F.col("last")).join(names, [*REGION, "c"])
    cell = body.groupBy(*REGION, (F.col("r") - F.col("last") - 1).alias("row_index"), "name").agg(F.max_by(F.struct("text", "kind"), "c").alias("v"))
    rows = cell.groupBy(*REGION, "row_index").agg(F.map_from_entries(F.collect_list(F.struct("name", "v.text"))).alias("values"), F.map_from_entries(F.collect_list(F.struct("name", "v.kind"))).alias("kinds"))
    several = F.max("region").over(Window.partitionBy(*GRID)) > 1
    listed = listed.withColumn("table_name", F.when(several, F.concat(F.col("grid_id"), F.lit("#"), F.col("region").cast("string"))).otherwise(F.col("grid_id")))
    return rows.join(listed, REGION).select("doc_id", "table_name", "region", "row_index", "columns", "values", "kinds")


def fill_merged(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Empty cells of merged ranges (``doc_id, grid_id, r0, r1, c0, c1``) take the value of the range's first cell.

    Each range is laid out as its cells, so that the join is on equal places.
    """
    spread = merges.select(*GRID, "r0", "c0", F.explode(F.sequence("r0", "r1")).alias("r"), "c1").select(*GRID, "r0", "c0", "r", F.explode(F.sequence("c0", "c1")).alias("c"))
    anchors = cells.select(*GRID, F.col("r").alias("r0"), F.col("c").alias("c0"), "text", "kind")
    given = spread.join(anchors, [*GRID, "r0", "c0"]).select(*GRID, "r", "c", "text", "kind")
    return cells.unionByName(given.join(cells.where(F.col("text").isNotNull()), [*GRID, "r", "c"], "left_anti"))


def wide(records: DataFrame, columns: list[str]) -> DataFrame:
    """Records with the given columns as text, provenance and order kept."""
    return records.select(F.col("doc_id").alias("source_file"), "table_name", "row_index", *[F.col("values").getItem(c).alias(c) for c in columns])


def column_union(records: DataFrame) -> list[str]:
    """Distinct columns of all tables in the order in which they first appear."""
    listed = records.select("doc_id", "table_name", F.posexplode("columns").alias("pos", "name")).groupBy("name").agg(F.min(F.struct("doc_id", "table_name", "pos")).alias("at")).orderBy("at")
    return [r["name"] for r in listed.collect()]
