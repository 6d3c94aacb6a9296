"""Registered queries of files, libraries, synonyms and long tables. Files are made by tasks from whole tables, and read in parallel."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .operators import grids, ontology, reshape
from .plans.scratch import table_folder
from .plans.session import Session, preview, table_id
from .queries import cents, query, table
from .sources import delimited, files
from .sources.library import Library

FILE = "path string, content binary"


def _folder(spark: SparkSession) -> str:
    return f"{table_folder(spark)}/{uuid.uuid4().hex}"


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(28,2)) AS VARCHAR) AS amount,
           CASE WHEN o_orderkey % 7 = 0 THEN 'first; "' || o_orderpriority || '"' || chr(10) || chr(10) || 'last' ELSE o_orderpriority END AS note FROM orders
""")
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as delimited files with quoted separators, quotes and line breaks, and read in splits, their delimiter guessed."""
    note = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit('first; "'), "o_orderpriority", F.lit('"\n\nlast'))).otherwise(F.col("o_orderpriority"))
    path = _folder(spark)
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", cents(F.col("o_totalprice")).alias("amount"), note.alias("note"))
    rows.write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    return delimited.read_large(spark, path).drop("ord")


def _books(rows: DataFrame, by: str, make) -> DataFrame:
    """``path, content``: a file a value of ``by``, made by the task that has its rows (``make(name, rows as lists) -> (path, bytes)``)."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(frame.columns))
        return pd.DataFrame([make(frame[by].iloc[0], frame.astype(object).where(frame.notna(), None).values.tolist())], columns=["path", "content"])

    return rows.groupBy(by).applyInPandas(build, FILE)


_SUPPLIER = ["s_nationkey", "s_suppkey", "s_name"]


def _suppliers(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(*[F.col(c).cast("string").alias(c) for c in _SUPPLIER])


def _workbook(name, rows: list[list]) -> tuple[str, bytes]:
    return f"n{name}.xlsx", sinks.workbook([("Suppliers", [_SUPPLIER, *rows]), ("Notes: all", [["kept", "count"], ["yes", len(rows)]])])


def _document(name, rows: list[list]) -> tuple[str, bytes]:
    cell = lambda v: f"<w:tc><w:p><w:r><w:t>{escape(str(v))}</w:t></w:r></w:p></w:tc>"
    body = "".join(f"<w:tr>{''.join(map(cell, row))}</w:tr>" for row in [_SUPPLIER, *rows])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:tbl>{body}</w:tbl></w:body></w:document>')
    return f"n{name}.docx", out.getvalue()


def _read_back(cells: DataFrame) -> DataFrame:
    return grids.wide(grids.tables(cells.where("warning is null")), _SUPPLIER).select(*_SUPPLIER)


_SUPPLIERS = "SELECT CAST(s_nationkey AS VARCHAR) AS s_nationkey, CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier"


@query(_SUPPLIERS)
def xlsx_scan(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as a workbook a nation, the named sheet read back."""
    return _read_back(files.parsed(_books(_suppliers(spark, d), "s_nationkey", _workbook), sheets=["Suppliers"]))


@query(_SUPPLIERS)
def docx_scan(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as a word-processor document with one table a nation, the first table read back."""
    return _read_back(files.parsed(_books(_suppliers(spark, d), "s_nationkey", _document), pages=files.page_range("1")))


@query("""
    SELECT 'n' || s_nationkey || CASE s_nationkey % 3 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.docx' ELSE '.csv' END AS path,
           CASE s_nationkey % 3 WHEN 0 THEN 'xlsx' WHEN 1 THEN 'docx' ELSE 'csv' END AS kind, CASE s_nationkey % 3 WHEN 0 THEN 2 ELSE 1 END AS units FROM supplier GROUP BY s_nationkey
""")
def file_inspection(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of files and what they hold: sheets, tables or one text."""

    def make(name, rows):
        of = int(name) % 3
        return _workbook(name, rows) if of == 0 else _document(name, rows) if of == 1 else (f"n{name}.csv", "\n".join(",".join(map(str, r)) for r in rows).encode())

    return files.inspected(_books(_suppliers(spark, d), "s_nationkey", make)).select("path", "kind", "units")


@query("""
    SELECT 'd' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.xls' WHEN 2 THEN '.bin' WHEN 3 THEN '.csv' WHEN 4 THEN '.xlsx' ELSE '' END AS doc_id,
           CASE doc_id % 6 WHEN 0 THEN 'PARSER_LIBRARY_MISSING' WHEN 1 THEN 'PARSER_LIBRARY_MISSING' WHEN 2 THEN 'UNSUPPORTED_FORMAT' WHEN 3 THEN 'EMPTY_DOCUMENT' WHEN 4 THEN 'UNREADABLE_FILE' ELSE 'UNSUPPORTED_FORMAT' END AS code FROM documents
""")
def scan_warnings(spark: SparkSession, d: str) -> DataFrame:
    """What is told of files that give no tables: every document under an extension that does not fit it, every sixth without one, or blank."""
    kind = F.col("doc_id") % 6
    ending = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".xls", ".bin", ".csv", ".xlsx", "")]), (kind + 1).cast("int"))
    content = F.encode(F.when(kind == 3, "  \n ").otherwise(F.coalesce("text", F.lit(""))), "UTF-8")
    made = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), ending).alias("path"), content.alias("content"))
    return files.warnings(files.parsed(made)).select("doc_id", "code")


@query(r"""
    SELECT 'c' || c_custkey || '.csv' AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'Crédit ' WHEN c_custkey % 4 = 1 THEN 'Œuvre ' ELSE 'Ämne ' END || c_name AS cell, CASE c_custkey % 3 WHEN 0 THEN 2 ELSE 3 END AS n_columns FROM customer
""")
def text_decoding(spark: SparkSession, d: str) -> DataFrame:
    """A small file a customer in one of several encodings and with one of several delimiters: its second name as read, and how many columns it has."""
    key = F.col("c_custkey")
    name = F.concat(F.when(key % 2 == 0, "Crédit ").when(key % 4 == 1, "Œuvre ").otherwise("Ämne "), F.col("c_name"))
    sep = F.when(key % 3 == 0, ";").when(key % 3 == 1, "\t").otherwise("|")
    more = F.when(key % 3 == 0, "").otherwise(F.concat(sep, F.lit("x")))
    content = F.concat(F.lit("number"), sep, F.lit("name"), more, F.lit("\r\n"), key.cast("string"), sep, name, more, F.lit("\r\n"))
    data = F.when(key % 2 == 0, F.encode(content, "UTF-8")).when(key % 4 == 1, F.encode(F.concat(F.lit("\ufeff"), content), "UTF-8")).otherwise(F.encode(content, "ISO-8859-1"))
    spread = table(spark, d, "customer").select("c_custkey", "c_name").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")  # few bytes a row, a file's work each
    made = spread.select(F.concat(F.lit("c"), key.cast("string"), F.lit(".csv")).alias("path"), data.alias("content"))
    cells = files.parsed(made).where("warning is null")
    return cells.groupBy("doc_id").agg(F.max(F.when((F.col("r") == 1) & (F.col("c") == 1), F.col("text"))).alias("cell"), (F.max("c") + 1).alias("n_columns"))


_DOC = "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(CAST(s_acctbal AS DECIMAL(28,2)) AS VARCHAR) AS s_acctbal FROM supplier"


def _records(rows: DataFrame, doc: str, name: str) -> DataFrame:
    """``rows`` (first column: their order) as records of one table."""
    columns = rows.columns[1:]
    values = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in columns]))
    return rows.select(F.lit(doc).alias("doc_id"), F.lit(name).alias("table_name"), F.lit(1).alias("region"), F.col(rows.columns[0]).cast("int").alias("row_index"), F.array(*map(F.lit, columns)).alias("columns"), values.alias("values"))


@query(f"SELECT * FROM ({_DOC}), (SELECT 'all_suppliers' AS name)")
def library_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers saved to a library as a processed document under a name that is no file name, listed, and loaded again."""
    library = Library(spark, _folder(spark))
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("n"), "s_suppkey", "s_name", cents(F.col("s_acctbal")).alias("s_acctbal"))
    text = sinks.processed(_records(rows, "suppliers", "suppliers"), "supplier").first()["json"]
    library.write(f"{_slug('all suppliers/')}.json", text.encode())
    (name,) = library.names()
    return library.load(name).select(*[F.col("values").getItem(c).alias(c) for c in ("s_suppkey", "s_name", "s_acctbal")], F.lit(name).alias("name"))


def _slug(name: str) -> str:
    from .sources.library import slug

    return slug(name)


_ALIASES = """
    a AS (SELECT lower(r_name) AS alias, r_name AS canonical FROM region UNION SELECT lower(n_name), r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
    b AS (SELECT lower(n_name) AS alias, n_name AS canonical FROM nation WHERE n_nationkey % 2 = 0),
    t AS (SELECT alias, canonical FROM b UNION ALL SELECT alias, canonical FROM a ANTI JOIN b USING (alias))
"""


def _aliases(spark, d) -> DataFrame:
    """Regions stand for their nations; a second table, which wins, has every other nation stand for itself."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    of_region = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_regionkey").cast("long").alias("ord"), "r_name").agg(F.array_sort(F.collect_list("n_name")).alias("n"))
    first = ontology.aliases(of_region.select("ord", F.concat(F.array(F.lit(" "), "r_name"), "n").alias("members")))
    second = ontology.aliases(nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("ord"), F.array(F.concat(F.lit("  "), "n_name")).alias("members")))
    return ontology.merged(first, second)


@query(f"WITH {_ALIASES} SELECT coalesce(t.canonical, n_name) AS term, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN t ON lower(n_name) = t.alias GROUP BY 1")
def ontology_merge(spark: SparkSession, d: str) -> DataFrame:
    """Customers by the canonical term of their nation, under two merged alias tables."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return ontology.apply_table(rows, "n_name", _aliases(spark, d), "term").groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH {_ALIASES} SELECT canonical, count(*) AS n_aliases, string_agg(alias, '|' ORDER BY alias) AS aliases FROM t GROUP BY 1")
def ontology_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Canonical terms of the merged tables with their aliases."""
    return ontology.statistics(_aliases(spark, d)).select("canonical", "n_aliases", F.array_join("aliases", "|").alias("aliases"))


_LONG = """
    SELECT c_name, c_mktsegment, Period, Value, {extra} FROM (UNPIVOT (SELECT {key} c_name, c_mktsegment, CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(CAST(c_acctbal AS DECIMAL(28,2)) AS VARCHAR) AS balance FROM customer) ON c_custkey, balance INTO NAME Period VALUE Value)
"""


def _wide(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("ord"), "c_name", "c_mktsegment", "c_custkey", cents(F.col("c_acctbal")).alias("balance"))


@query(_LONG.format(extra="true AS long_form", key=""))
def melt_detected(spark: SparkSession, d: str) -> DataFrame:
    """Customers in long form, label and value columns told apart by their shares of numbers."""
    long = reshape.melt(_wide(spark, d).drop("ord"))
    return long.withColumn("long_form", F.lit(reshape.has_value_column(long)))


@query(_LONG.format(extra="CAST(k * 2 + CASE WHEN Period = 'balance' THEN 1 ELSE 0 END AS BIGINT) AS ord", key="c_custkey AS k,"))
def pivot_long(spark: SparkSession, d: str) -> DataFrame:
    """The same as a table to edit: cells in the order of rows and columns."""
    return reshape.pivot_long(_wide(spark, d)).select("c_name", "c_mktsegment", "Period", "Value", "ord")


@query("SELECT c_custkey, c_name, count(*) OVER () > 500 AS truncated, true AS complex FROM customer QUALIFY row_number() OVER (ORDER BY c_custkey) <= 501 AND row_number() OVER (ORDER BY c_custkey) <> 2")
def table_preview(spark: SparkSession, d: str) -> DataFrame:
    """The first 500 rows (the feature) of the customers after the second row is deleted, and whether there are more."""
    shown = preview(table(spark, d, "customer").select(F.col("c_custkey").alias("ord"), "c_custkey", "c_name", "c_mktsegment"), [{"op": "delete_rows", "rows": [1]}])
    rows = [(r[0], r[1], shown["truncated"], shown["complex"]) for r in shown["rows"]]
    return spark.createDataFrame(rows, "c_custkey long, c_name string, truncated boolean, complex boolean")


@query("SELECT 's.txt' AS source_file, s_name AS name FROM supplier UNION ALL SELECT 'c.txt', c_name FROM customer UNION ALL SELECT 'none: ' || f, n FROM (SELECT 's.txt' AS f, s_name AS n FROM supplier)")
def session_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables of a side that are included by name; a choice that leaves nothing of an extraction falls back to all of it, if asked for."""
    side = lambda t, key, name: _records(table(spark, d, t).select(F.col(key).alias("n"), F.col(name).alias("name")), f"{t[0]}.txt", t)
    session = Session().add("left", side("supplier", "s_suppkey", "s_name")).add("left", side("customer", "c_custkey", "c_name"))
    both = session.frame("left", [table_id("s.txt", "supplier"), table_id("c.txt", "customer")])
    only = session.frame("left", [table_id("s.txt", "supplier")]).withColumn("source_file", F.concat(F.lit("none: "), "source_file"))
    return both.select("source_file", "name").unionByName(only.select("source_file", "name"))
