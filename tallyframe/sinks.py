"""Results as files: Parquet or CSV folders of any size, bounded JSON, and workbooks for what fits a sheet."""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterable
from datetime import date, datetime
from decimal import Decimal
from io import BytesIO
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import EngineConfig
from .plans.reconcile import Reconciliation

#: Rows of a bucket in JSON; longest text of a workbook cell; rows of a sheet (fixed values).
JSON_CAP, CELL_CHARS, SHEET_ROWS = 250, 32_767, 1_048_576
BUCKETS = ("breaks", "reconciled", "unmatched_left", "unmatched_right")


def match_rows(matches: DataFrame, cfg: EngineConfig) -> DataFrame:
    """A row a pair: keys, type, confidence in percent, both values, difference and verdict of each field."""
    keys = {k.name: F.col(f"`{k.name}`").cast("string") for k in cfg.keys}
    fixed = {"match_type": F.col("match_type"), "confidence": F.round(F.col("confidence") * 100, 1)}
    fields = {}
    for f in cfg.values:
        fields |= {f"{f.name}__left": F.col(f"{f.name}__left"), f"{f.name}__right": F.col(f"{f.name}__right"), f"{f.name}__diff": F.col(f"{f.name}__diff"), f"{f.name}__ok": F.col(f"{f.name}__ok")}
    last = {"break_fields": F.array_join("break_fields", ", "), "explanation": F.col("explanation"), "left_files": F.col("left_source_files"), "right_files": F.col("right_source_files")}
    return matches.select(*[c.alias(n) for n, c in (keys | fixed | fields | last).items()])  # a key of a fixed name gives way


def unmatched_rows(side: DataFrame, cfg: EngineConfig) -> DataFrame:
    return side.select(*[f.name for f in cfg.fields], "source_files")


def frames(result: Reconciliation, cfg: EngineConfig) -> dict[str, DataFrame]:
    """The six parts of a result, in the order of the workbook's sheets."""
    result = result.written()
    return {
        "summary": result.summary,
        "field_variance": result.field_variance,
        "breaks": match_rows(result.breaks, cfg),
        "reconciled": match_rows(result.reconciled, cfg),
        "unmatched_left": unmatched_rows(result.unmatched_left, cfg),
        "unmatched_right": unmatched_rows(result.unmatched_right, cfg),
    }


def write_result(result: Reconciliation, cfg: EngineConfig, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """All parts in full, a folder each."""
    for name, df in frames(result, cfg).items():
        df.write.mode(mode).format(fmt).option("header", "true").save(f"{path}/{name}")


def plain(value):
    """A value as JSON has it: amounts as numbers, dates as ISO text."""
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, date | datetime):
        return value.isoformat()
    return value


def to_json(result: Reconciliation, cfg: EngineConfig, cap: int = JSON_CAP) -> dict:
    """Summary, variances and each bucket's first ``cap`` rows, with flags for buckets that have more."""
    parts = frames(result, cfg)
    out = {"summary": {k: plain(v) for k, v in parts["summary"].first().asDict().items()}, "field_variance": [{k: plain(v) for k, v in r.asDict().items()} for r in parts["field_variance"].collect()], "truncated": {}}
    for name in BUCKETS:
        rows = parts[name].limit(cap + 1).collect()
        out[name] = [{k: plain(v) for k, v in r.asDict().items()} for r in rows[:cap]]
        out["truncated"][name] = len(rows) > cap
    return out


def clean_cell(value):
    """A value that a sheet takes: no control characters, texts cut to length, infinite numbers as text."""
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return str(value)
    if isinstance(value, str):
        return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", value)[:CELL_CHARS]
    return value


def sheet_title(name: str, taken: set[str]) -> str:
    """At most 31 characters, none that sheets forbid, told apart from others without regard to case."""
    base = re.sub(r"[\[\]:*?/\\]", " ", name).strip()[:31] or "Sheet"
    title, n = base, 2
    while title.lower() in taken:
        title, n = f"{base[: 31 - len(f' {n}')]} {n}", n + 1
    taken.add(title.lower())
    return title


def _cell(r: int, c: int, value) -> str:
    letters, n = "", c + 1
    while n:
        n, x = divmod(n - 1, 26)
        letters = chr(65 + x) + letters
    value = clean_cell(value)
    if value is None:
        return ""
    ref = f'r="{letters}{r + 1}"'
    if isinstance(value, bool):
        return f'<c {ref} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float | Decimal):
        return f"<c {ref}><v>{value}</v></c>"
    shown = ", ".join(map(str, value)) if isinstance(value, list) else value.isoformat() if isinstance(value, date | datetime) else str(value)
    return f'<c {ref} t="inlineStr"><is><t xml:space="preserve">{escape(shown)}</t></is></c>'


def workbook(sheets: Iterable[tuple[str, list[list]]]) -> bytes:
    """A workbook of named sheets of rows."""
    taken: set[str] = set()
    listed = [(sheet_title(n, taken), rows) for n, rows in sheets]
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in range(1, len(listed) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in enumerate(listed, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(listed) + 1)) + "</Relationships>")
        for i, (_, rows) in enumerate(listed, 1):
            body = "".join(f'<row r="{r + 1}">{"".join(_cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def _rows(df: DataFrame) -> list[list]:
    found = df.limit(SHEET_ROWS).collect()
    if len(found) >= SHEET_ROWS:
        raise ValueError("more rows than a sheet takes; use write_result")
    return [df.columns, *map(list, found)] if found else [["(empty)"]]


def result_workbook(result: Reconciliation, cfg: EngineConfig) -> bytes:
    """Six sheets with all rows, for results that fit; larger ones go to :func:`write_result`."""
    return workbook((n, _rows(df)) for n, df in frames(result, cfg).items())


def processed_workbook(doc: dict) -> bytes:
    """A processed document: an index, then a sheet a table with its title, a blank row, header and rows."""
    tables = doc.get("tables", [])
    index = [["Table", "Columns", "Rows"], *([t["name"], len(t["columns"]), len(t["rows"])] for t in tables)]
    sheets = [(t["name"], [[t["name"]], [], t["columns"], *([row.get(c) for c in t["columns"]] for row in t["rows"])]) for t in tables]
    return workbook([("Index", index), *sheets])


def processed(records: DataFrame, source: str, layout: str = "wide", fmt: str = "tallyframe.processed.v1") -> DataFrame:
    """Records as processed documents, one JSON text a document (``json``), tables and rows in order."""
    rows = records.groupBy("doc_id", "table_name", "region").agg(F.first("columns").alias("columns"), F.transform(F.array_sort(F.collect_list(F.struct("row_index", F.map_entries("values").alias("e")))), lambda x: F.map_from_entries(x["e"])).alias("rows"))
    tables = F.transform(F.array_sort(F.collect_list(F.struct("region", "table_name", "columns", F.transform("rows", lambda m: F.map_entries(m)).alias("rows")))), lambda t: F.struct(t["table_name"].alias("name"), t["columns"].alias("columns"), F.transform(t["rows"], lambda e: F.map_from_entries(e)).alias("rows")))
    docs = rows.groupBy("doc_id").agg(tables.alias("tables"))
    return docs.select("doc_id", F.to_json(F.struct(F.lit(source).alias("source"), F.lit(fmt).alias("format"), F.lit(layout).alias("layout"), "tables")).alias("json"))


def dump(doc: dict) -> str:
    return json.dumps(doc, ensure_ascii=False, indent=2, default=plain)
