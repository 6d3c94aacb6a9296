"""Registered queries of pages laid out from tables: every order is a page, its line items are the rows of a table on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import pages
from .plans.scratch import written
from .queries import cents, query, table


def _words(spark, d) -> DataFrame:
    """Words of a page an order: for each line item a label, a quantity (or a dash) and a price (credits in brackets), right-aligned, not quite on one line; a small mark after every third label."""
    n, price = F.col("l_linenumber"), F.format_number(cents(F.col("l_extendedprice")), 2)
    items = table(spark, d, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_extendedprice").alias("l_extendedprice"), F.max("l_returnflag").alias("l_returnflag"))
    quantity = F.when(n % 4 == 0, "–").otherwise(F.col("l_quantity").cast("int").cast("string"))
    amount = F.when(n % 3 == 0, F.concat(F.lit("("), price, F.lit(")"))).otherwise(price)
    width = lambda t: F.length(t) * 6.0
    word = lambda text, x0, x1, top, size: F.struct(text.alias("text"), x0.alias("x0"), x1.alias("x1"), top.cast("double").alias("top"), F.lit(size).alias("size"))
    put = lambda text, x0, up, size=9.0: word(text, F.lit(x0), F.lit(x0) + width(text), n * 14 + up, size)
    end = lambda text, x1, up: word(text, F.lit(x1) - width(text), F.lit(x1), n * 14 + up, 9.0)
    laid = F.array(put(F.lit("Item"), 40.0, 0.0), put(F.col("l_returnflag"), 80.0, 1.5), F.when(n % 3 == 1, put(F.lit("2"), 100.0, -1.0, 5.0)), end(quantity, 300.0, 1.0), end(amount, 450.0, -0.5))
    return items.select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.lit(600.0).alias("page_width"), F.inline(F.filter(laid, lambda w: w.isNotNull())))


_ITEMS = """
    i AS (SELECT l_orderkey AS doc, l_linenumber AS n, max(l_quantity) AS q, max(CAST(l_extendedprice AS DECIMAL(28,2))) AS p, max(l_returnflag) AS f FROM lineitem GROUP BY ALL),
    kept AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n) - 1 AS line FROM i QUALIFY count(*) OVER (PARTITION BY doc) >= 2)
"""


@query(f"""
    WITH {_ITEMS}
    SELECT doc, CAST(line AS INTEGER) AS line, 'Item ' || f AS label, CASE WHEN n % 4 = 0 THEN '–' ELSE CAST(CAST(q AS INTEGER) AS VARCHAR) END AS quantity, CASE WHEN n % 3 = 0 THEN '(' || format('{{:,.2f}}', p::DOUBLE) || ')' ELSE format('{{:,.2f}}', p::DOUBLE) END AS amount FROM kept
""")
def page_rows(spark: SparkSession, d: str) -> DataFrame:
    """Labels and values of the rows of every page that has columns (two rows or more)."""
    return pages.rows(_words(spark, d)).select("doc", "line", "label", F.get("cells", F.lit(0)).alias("quantity"), F.get("cells", F.lit(1)).alias("amount"))


@query(f"WITH {_ITEMS} SELECT DISTINCT doc, CAST(count(*) OVER (PARTITION BY doc) AS BIGINT) AS n, true AS accepted, CASE WHEN doc % 2 = 0 THEN 'Order ' || doc WHEN doc % 3 = 0 THEN 'Items' END AS title FROM kept")
def page_tables(spark: SparkSession, d: str) -> DataFrame:
    """The tables of those pages: rows, whether they are taken for tables, and the title above: large ones, else bold ones that are nearer than small print."""
    found = written(pages.rows(_words(spark, d)))
    top = found.groupBy("doc", "page").agg(F.min("top").alias("top"), F.max("size").alias("size"), F.count("*").alias("n"))
    head = lambda text, up, size, bold: F.struct(text.alias("text"), (F.col("top") - up).alias("top"), F.lit(size).alias("size"), F.lit(bold).alias("bold"))
    doc = F.col("doc")
    heads = top.select("doc", "page", F.inline(F.filter(F.array(F.when(doc % 2 == 0, head(F.concat(F.lit("Order "), doc.cast("string")), 54.0, 14.0, False)), F.when(doc % 3 == 0, head(F.lit("Items"), 18.0, 9.0, True)), head(F.lit("small print of the page"), 16.0, 8.0, False)), lambda h: h.isNotNull())))
    return top.join(pages.accepted(found), ["doc", "page"]).join(pages.titles(heads, top), ["doc", "page"], "left").select("doc", "n", "accepted", "title")


_LINES = """
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '') AS words FROM l)
"""


@query(f"""
    WITH {_LINES}
    SELECT doc_id, CAST(n AS INTEGER) AS n,
           ends_with(rtrim(line), '&') OR length(line) - length(replace(line, '(', '')) > length(line) - length(replace(line, ')', '')) OR regexp_replace(lower(coalesce(words[len(words)], '')), ',+$', '') IN {pages.DANGLING} AS open,
           regexp_matches(trim(line), '^[\\p{{Ll}}()\\[\\]]') AS goes_on,
           len(words) <= 6 AND regexp_matches(coalesce(words[1], ''), '^\\p{{Lu}}') AND lower(coalesce(words[1], '')) NOT IN {pages.GOING_ON} AS section,
           len(list_filter(words, lambda x: lower(x) IN {pages.PLACEHOLDERS} OR regexp_matches(x, '{pages.NUMBER}'))) AS n_values,
           coalesce(nullif(array_to_string(list_filter(words, lambda x: length(regexp_replace(x, '[^A-Za-z]', '', 'g')) < 8 OR length(regexp_replace(x, '[^aeiouAEIOU]', '', 'g')) >= length(regexp_replace(x, '[^A-Za-z]', '', 'g')) * 0.12), ' '), ''), line) AS readable
    FROM w
""")
def label_tests(spark: SparkSession, d: str) -> DataFrame:
    """What tests of labels and cells say of every line of the documents."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    line = F.col("line")
    values = F.size(F.filter(pages.words_of(line), pages.is_value))
    return rows.select("doc_id", "n", pages.is_open(line).alias("open"), pages.goes_on(line).alias("goes_on"), pages.is_section(line).alias("section"), values.cast("long").alias("n_values"), pages.without_garble(line).alias("readable"))


@query("""
    SELECT o_orderkey, 'Revenue ' || year(o_orderdate) AS header, o_orderkey % 3 = 0 AS period_row, o_orderkey % 3 <> 1 AS mostly_text FROM orders
""")
def header_tests(spark: SparkSession, d: str) -> DataFrame:
    """Headers without superscripts and footnote figures; rows of periods, of texts and of numbers told apart."""
    year = F.year("o_orderdate").cast("string")
    kind, q = F.col("o_orderkey") % 3, F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    cells = F.when(kind == 0, F.array(year, q, F.lit(""))).when(kind == 1, F.array(F.lit("(1,200)"), F.lit("–"), F.lit("12%"))).otherwise(F.array(F.col("o_orderstatus"), F.lit("7"), F.lit(None)))
    label = F.when(F.col("o_orderkey") % 2 == 0, "In millions").otherwise("")
    shown = pages.clean_header(F.concat(F.lit("Revenue²  "), year, F.when(F.col("o_orderkey") % 2 == 0, " 12").otherwise("¹")))
    return table(spark, d, "orders").select("o_orderkey", shown.alias("header"), pages.period_row(label, cells).alias("period_row"), pages.mostly_text(cells).alias("mostly_text"))
