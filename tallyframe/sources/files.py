"""Files as cells: delimited text, aligned text, workbooks, word-processor tables, processed JSON.

Files are read as binary rows by Spark from any store and parsed by Arrow workers, a file a row. What cannot be
parsed becomes a warning, never an error. Big files with a known delimiter have :func:`read_delimited`.
"""

from __future__ import annotations

import csv
import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from functools import partial
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grids import CELLS

#: Kinds of files by extension (fixed values).
FORMATS = {"csv": "csv", "tsv": "csv", "txt": "txt", "text": "txt", "xlsx": "xlsx", "xlsm": "xlsx", "xls": "xls", "docx": "docx", "pdf": "pdf", "json": "json"}
#: Kinds whose bytes are read; the others are refused by name.
PARSED = ("csv", "txt", "xlsx", "docx")
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
DELIMITERS = ",;\t|"
SNIFFED = 4096
#: Rows of cells that are given on together.
OUT_ROWS = 20_000
OUT = CELLS + ", warning string"
PROCESSED = "source string, format string, layout string, tables array<struct<name: string, columns: array<string>, rows: array<map<string, string>>>>"


def file_format(name: str) -> str:
    """The kind of a file by its extension; an unknown one is an error."""
    kind = FORMATS.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None
    if kind is None:
        raise ValueError(f"unsupported file: {name}")
    return kind


def decode(data: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def delimited(content: str, name: str) -> list[list[str]]:
    """Rows of delimited text, its delimiter guessed from the beginning."""
    try:
        return list(csv.reader(io.StringIO(content), csv.Sniffer().sniff(content[:SNIFFED], DELIMITERS)))
    except csv.Error:
        return list(csv.reader(io.StringIO(content), delimiter="\t" if name.lower().endswith(".tsv") else ","))


def aligned(content: str) -> list[list[str]]:
    """Rows of a text table; the first line tells whether pipes, tabs or runs of blanks part its columns. Rules and blank lines go."""
    lines = [x for x in content.splitlines() if x.strip() and not re.fullmatch(r"[\s|+=\-_:]+", x)]
    if not lines:
        return []
    if "|" in lines[0]:
        return [[c.strip() for c in x.strip().strip("|").split("|")] for x in lines]
    if "\t" in lines[0]:
        return [[c.strip() for c in x.split("\t")] for x in lines]
    return [re.split(r"\s{2,}", x.strip()) for x in lines]


_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Built-in number formats of workbooks that show dates (fixed values).
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    c = 0
    for x in letters:
        c = c * 26 + ord(x) - 64
    return int(digits) - 1, c - 1


def sheet_names(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_M}sheet")]


def workbook(data: bytes, only: list[str] | None = None) -> Iterator[tuple[str, list[tuple[int, int, str, str]]]]:
    """Each sheet's name and cells ``(r, c, text, kind)``: computed values, merged ranges filled."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in si.iter(f"{_M}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_M}si")]
        dated: set[int] = set()
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(x.get("numFmtId")) for x in styles.iter(f"{_M}numFmt") if re.search(r"[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", x.get("formatCode", "")), re.I)}
            formats = styles.find(f"{_M}cellXfs")
            dated = {i for i, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}
        targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_M}sheet"):
            if only and sheet.get("name") not in only:
                continue
            target = targets[sheet.get(f"{_R}id")]
            tree = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            cells = dict(_cells(tree, strings, dated))
            for merged in tree.iter(f"{_M}mergeCell"):
                a, _, b = merged.get("ref").partition(":")
                (r0, c0), (r1, c1) = _place(a), _place(b or a)
                if (r0, c0) in cells:
                    for r in range(r0, r1 + 1):
                        for c in range(c0, c1 + 1):
                            cells.setdefault((r, c), cells[r0, c0])
            yield sheet.get("name"), [(r, c, *v) for (r, c), v in sorted(cells.items())]


def _cells(tree, strings: list[str], dated: set[int]) -> Iterator[tuple[tuple[int, int], tuple[str, str]]]:
    r = -1
    for row in tree.iter(f"{_M}row"):
        r = int(row.get("r")) - 1 if row.get("r") else r + 1
        c = -1
        for cell in row.iter(f"{_M}c"):
            c = _place(cell.get("r"))[1] if cell.get("r") else c + 1
            value, kind = cell.findtext(f"{_M}v"), cell.get("t", "n")
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in cell.iter(f"{_M}t"))
            if value is None:
                continue
            if kind == "s":
                yield (r, c), (strings[int(value)], "str")
            elif kind == "b":
                yield (r, c), ("True" if value == "1" else "False", "bool")
            elif kind == "n" and int(cell.get("s", 0)) in dated:
                moment = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=float(value))
                yield (r, c), (str(moment.replace(microsecond=0)), "date")
            elif kind == "n":
                number = float(value)
                yield (r, c), (value, "int") if re.fullmatch(r"-?\d+", value) else (repr(number), "float")
            else:
                yield (r, c), (value, "str")


def word_tables(data: bytes) -> Iterator[list[list[str]]]:
    """The tables of a word-processor document as rows of texts."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    for t in body.iter(f"{_W}tbl"):
        yield [["\n".join("".join(x.text or "" for x in p.iter(f"{_W}t")) for p in cell.iter(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc")] for row in t.findall(f"{_W}tr")]


def page_range(spec: str | None, most: int | None = None) -> list[int] | None:
    """``1-3,7`` as numbers; reversed ranges are turned, bad parts skipped, an empty text means all (None)."""
    if not spec or not spec.strip():
        return None
    found: set[int] = set()
    for part in spec.split(","):
        m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part)
        if m:
            a, b = sorted((int(m[1]), int(m[2] or m[1])))
            found.update(range(a, min(b, most) + 1 if most else b + 1))
    return sorted(p for p in found if p >= 1) or None


def parse_file(name: str, data: bytes, sheets: list[str] | None = None, pages: list[int] | None = None) -> Iterator[tuple]:
    """Rows of ``OUT`` for one file."""
    warn = lambda code, grid=None: (name, grid, None, None, None, None, code)

    def grid(title: str, rows: list[list[str]]) -> Iterator[tuple]:
        for r, row in enumerate(rows):
            for c, value in enumerate(row):
                if value is not None and value != "":
                    yield name, title, r, c, value, "str", None

    base = name.rsplit("/", 1)[-1]
    try:
        kind = file_format(base)
    except ValueError:
        yield warn("UNSUPPORTED_FORMAT")
        return
    try:
        if kind in ("csv", "txt"):
            content = decode(data)
            rows = delimited(content, base) if kind == "csv" else aligned(content)
            if not any(c.strip() for row in rows for c in row):
                yield warn("EMPTY_DOCUMENT")
            yield from grid(kind, rows)
        elif kind == "xlsx":
            for title, cells in workbook(data, sheets):
                if not cells:
                    yield warn("NO_TABLES_FOUND", title)
                for r, c, value, of in cells:
                    yield name, title, r, c, value, of, None
        elif kind == "docx":
            found = False
            for i, rows in enumerate(word_tables(data), 1):
                if pages is None or i in pages:
                    found = True
                    yield from grid(f"table_{i}", rows)
            if not found:
                yield warn("NO_TABLES_FOUND")
        else:
            yield warn("PARSER_LIBRARY_MISSING")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, csv.Error):
        yield warn("UNREADABLE_FILE")


def _parse(frames: Iterator[pd.DataFrame], sheets: list[str] | None, pages: list[int] | None) -> Iterator[pd.DataFrame]:
    """Rows of many small files go out together, those of a large one in parts."""
    names = [x.split()[0] for x in OUT.split(", ")]
    out = lambda rows: pd.DataFrame(rows, columns=names).astype({"r": "Int32", "c": "Int32"})
    rows = []
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            for row in parse_file(path.rsplit("/", 1)[-1], b"" if content is None else bytes(content), sheets, pages):
                rows.append(row)
                if len(rows) >= OUT_ROWS:
                    yield out(rows)
                    rows = []
    if rows:
        yield out(rows)


def parse_frames(sheets: list[str] | None = None, pages: list[int] | None = None):
    """The parser as a function for ``mapInPandas`` over rows of ``path, content``."""
    return partial(_parse, sheets=sheets, pages=pages)


def read_cells(spark: SparkSession, path: str | list[str], sheets: list[str] | None = None, pages: list[int] | None = None) -> DataFrame:
    """Cells and warnings of files (globs are fine). Files of no bytes are not listed by Spark. Filter on ``warning is null`` for the cells."""
    return parsed(spark.read.format("binaryFile").load(path), sheets, pages)


def warnings(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("warning").isNotNull()).select("doc_id", "grid_id", F.col("warning").alias("code"))


def inspected(files: DataFrame) -> DataFrame:
    """``path, kind, length, units`` of files ``path, content``: units are sheets of workbooks, tables of documents, 1 of text files, 0 if unreadable."""

    def look(frames):
        for frame in frames:
            rows = []
            for p, data in zip(frame["path"], frame["content"], strict=True):
                kind, units = FORMATS.get(p.rsplit(".", 1)[-1].lower(), "unknown"), 0
                try:
                    units = len(sheet_names(bytes(data))) if kind == "xlsx" else sum(1 for _ in word_tables(bytes(data))) if kind == "docx" else int(kind in ("csv", "txt", "json"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    pass
                rows.append((p, kind, len(data), units))
            yield pd.DataFrame(rows, columns=["path", "kind", "length", "units"])

    return files.select("path", "content").mapInPandas(look, "path string, kind string, length long, units int")


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """:func:`inspected` of the files below a path."""
    return inspected(spark.read.format("binaryFile").load(path))


def parsed(files: DataFrame, sheets: list[str] | None = None, pages: list[int] | None = None) -> DataFrame:
    """Cells and warnings of files that a table holds as ``path, content``. Files that their name alone refuses are told of without their bytes."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    read = F.when(ending.isin(*[x for x, kind in FORMATS.items() if kind in PARSED]), F.col("content"))
    return files.select("path", read.alias("content")).mapInPandas(parse_frames(sheets, pages), OUT)


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Big files whose delimiter and header are known: split and read in parallel by Spark's own reader."""
    return spark.read.csv(path, sep=delimiter, encoding=encoding, header=True, inferSchema=False)


def text_table(lines: DataFrame, doc: str = "doc_id", line: str = "line", ord_col: str = "n") -> DataFrame:
    """Cells of text tables given as lines; the layout follows from each document's first line that is neither blank nor a rule."""
    kept = lines.where((F.trim(F.regexp_replace(line, r"(?U)\s", " ")) != "") & ~F.col(line).rlike(r"^[\s|+=\-_:]+$"))
    first = kept.groupBy(doc).agg(F.min_by(line, ord_col).alias("__first"))
    split = (
        F.when(F.col("__first").contains("|"), F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|"))
        .when(F.col("__first").contains("\t"), F.split(line, "\t"))
        .otherwise(F.split(F.trim(line), r"\s{2,}"))
    )
    from pyspark.sql import Window

    row = F.row_number().over(Window.partitionBy(doc).orderBy(ord_col)) - 1
    cut = kept.join(first, doc).select(F.col(doc).cast("string").alias("doc_id"), F.lit("txt").alias("grid_id"), row.alias("r"), split.alias("parts"))
    return cut.select("doc_id", "grid_id", "r", F.posexplode("parts").alias("c", "raw")).select("doc_id", "grid_id", "r", "c", F.trim("raw").alias("text"), F.lit("str").alias("kind"))


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """Records of processed JSON documents; columns default to the keys of a table's first row."""
    docs = spark.read.schema(PROCESSED).json(path, multiLine=True)
    each = docs.select(F.col("source").alias("doc_id"), F.posexplode("tables").alias("region", "t"))
    columns = F.coalesce(F.when(F.size("t.columns") > 0, F.col("t.columns")), F.map_keys(F.element_at("t.rows", 1)))
    return each.select("doc_id", F.col("t.name").alias("table_name"), "region", columns.alias("columns"), F.posexplode("t.rows").alias("row_index", "values")).select("doc_id", "table_name", "region", "row_index", "columns", "values", F.transform_values("values", lambda k, v: F.lit("str")).alias("kinds"))
