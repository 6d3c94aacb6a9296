"""Grids, files, edits, reshaping, subtotals, profiles, sinks, library and sessions."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe import sinks
from tallyframe.config import EngineConfig
from tallyframe.operators import edits, grids, profile, qc, reshape
from tallyframe.plans.reconcile import reconcile
from tallyframe.plans.session import Session, preview
from tallyframe.sources import files
from tallyframe.sources.library import Library, slug

STATEMENT = 'Statement of results,,\n,,\nLine item,Q1 26,Q1 25\nOperating income,"5,902","5,379"\nOperating expenses,"(3,100)","(2,950)"\n'


def grid(spark, rows, doc="d", name="g"):
    cells = [(doc, name, r, c, v if isinstance(v, str) else repr(v), {int: "int", float: "float", bool: "bool"}.get(type(v), "str")) for r, row in enumerate(rows) for c, v in enumerate(row) if v is not None]
    return spark.createDataFrame(cells, grids.CELLS)


def test_statement(spark, tmp_path):
    (tmp_path / "a.csv").write_text(STATEMENT)
    cells = files.read_cells(spark, str(tmp_path / "*.csv"))
    assert files.warnings(cells).count() == 0
    own = grids.regions(cells.where("warning is null"))
    scores = {r.r: r.score for r in grids.header_scores(own).collect()}
    assert round(scores[0], 2) == 4.32 and round(scores[1], 3) == 2.853
    rows = grids.tables(cells.where("warning is null")).orderBy("row_index").collect()
    assert [r.table_name for r in rows] == ["csv", "csv"]
    assert rows[0]["columns"] == ["Line item", "Q1 26", "Q1 25"]
    assert rows[1]["values"] == {"Line item": "Operating expenses", "Q1 26": "(3,100)", "Q1 25": "(2,950)"}
    long = reshape.melt(grids.wide(grids.tables(cells.where("warning is null")), rows[0]["columns"]).select(*rows[0]["columns"]))
    assert long.count() == 4 and ("Operating income", "Q1 26", "5,902") in [tuple(r) for r in long.collect()]


def test_regions_and_bands(spark):
    two = grid(spark, [["a", "b", None, "x", "y"], ["p", 1, None, "q", 2], [None] * 5, ["r", 3, None, "s", 4]])
    rows = grids.tables(two).orderBy("table_name", "row_index").collect()
    assert [(r.table_name, r["values"]) for r in rows] == [("g#1", {"a": "p", "b": "1"}), ("g#1", {"a": "r", "b": "3"}), ("g#2", {"x": "q", "y": "2"}), ("g#2", {"x": "s", "y": "4"})]
    band = grid(spark, [["Item", "Plan", "Plan"], [None, "2024", "2025"], ["n", 1, 2], ["m", 3, 4]])
    assert grids.tables(band).first()["columns"] == ["Item", "Plan 2024", "Plan 2025"]
    same = grid(spark, [["n", "n", "n"], ["u", 1, 2]])
    assert grids.tables(same).first()["columns"] == ["n", "n_1", "n_2"]


def test_workbook_and_merges(spark, tmp_path):
    data = sinks.workbook([("One", [["Name", "Amount"], ["a", 5], ["b", 2.5]]), ("a/b", [[None]])])
    (tmp_path / "w.xlsx").write_bytes(data)
    assert files.sheet_names(data) == ["One", "a b"]
    cells = files.read_cells(spark, str(tmp_path / "w.xlsx"))
    assert [tuple(r) for r in files.warnings(cells).collect()] == [("w.xlsx", "a b", "NO_TABLES_FOUND")]
    rows = grids.tables(cells.where("warning is null")).orderBy("row_index").collect()
    assert [(r["values"], r["kinds"]["Amount"]) for r in rows] == [({"Name": "a", "Amount": "5"}, "int"), ({"Name": "b", "Amount": "2.5"}, "float")]
    merged = grids.fill_merged(grid(spark, [["top", None], ["u", "v"]]), spark.createDataFrame([("d", "g", 0, 0, 0, 1)], "doc_id string, grid_id string, r0 int, r1 int, c0 int, c1 int"))
    assert sorted((r.r, r.c, r.text) for r in merged.collect()) == [(0, 0, "top"), (0, 1, "top"), (1, 0, "u"), (1, 1, "v")]


def test_text_and_bad_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("Name   Amount\n-----------\n\nsmall ring   5\nrod   6\n")
    (tmp_path / "e.csv").write_text("\n")
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    (tmp_path / "p.pdf").write_bytes(b"%PDF")
    cells = files.read_cells(spark, str(tmp_path / "*"))
    assert {tuple(r)[::2] for r in files.warnings(cells).collect()} == {("e.csv", "EMPTY_DOCUMENT"), ("b.xlsx", "UNREADABLE_FILE"), ("p.pdf", "PARSER_LIBRARY_MISSING")}
    assert [r["values"]["Name"] for r in grids.tables(cells.where("warning is null")).orderBy("row_index").collect()] == ["small ring", "rod"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a | b", "--|--", "1 | 2"])], "doc_id int, n int, line string")
    assert sorted((r.r, r.c, r.text) for r in files.text_table(lines).collect()) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "1"), (1, 1, "2")]
    assert files.page_range("3-1,x,7", 6) == [1, 2, 3] and files.page_range(" ") is None
    with pytest.raises(ValueError):
        files.file_format("a.exe")


def table(spark, columns, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, " + ", ".join(f"`{c}` string" for c in columns))


def shown(df):
    return [list(r)[1:] for r in df.select("ord", *edits.columns_of(df)).orderBy("ord").collect()]


def test_edits(spark):
    df = table(spark, ["a", "b"], [("x", "y"), ("Item", "Item"), ("p", "1"), ("q", "2")])
    up = edits.promote_header(df, 1)
    assert edits.columns_of(up) == ["Item", "Item (2)"] and shown(up) == [["p", "1"], ["q", "2"]]
    assert edits.promote_header(df, 9) is df
    done = edits.apply_ops(df, [{"op": "promote_header", "row": 1}, {"op": "delete_rows", "rows": [0]}, {"op": "rename_columns", "names": ["Line", ""]}, {"op": "edit_label", "row": 0, "text": "Q"}, {"op": "nothing"}])
    assert edits.columns_of(done) == ["Line", "Item (2)"] and shown(done) == [["Q", "2"]]
    long = edits.apply_ops(table(spark, ["i", "u", "v"], [("a", "1", "2"), ("b", "3", None)]), [{"op": "pivot_long"}])
    assert shown(long) == [["a", "u", "1"], ["a", "v", "2"], ["b", "u", "3"]]
    assert preview(df, [], 2)["truncated"] and preview(df)["qc"]["status"] == "n/a"


def test_subtotals(spark):
    rows = [("Revenue", "100"), ("Cost of sales", "(60)"), ("Gross profit", "40")]
    assert qc.subtotals(table(spark, ["Line item", "FY25"], rows), ["ord"]).first() == (1, 1, "ok", [])
    rows[2] = ("Gross profit", "45")
    assert qc.subtotals(table(spark, ["Line item", "FY25"], rows), ["ord"]).first() == (1, 0, "check", ["grossprofit[FY25]: got 45, expected 40"])
    assert qc.subtotals(table(spark, ["Line item", "FY25"], [("x", "1")]), ["ord"]).first()["status"] == "n/a"


def test_mapping(spark):
    left = table(spark, ["Invoice No", "Amount"], [("INV-1", "100"), ("INV-2", "200.5"), ("INV-3", "300")])
    right = table(spark, ["Reference", "Total"], [("INV-1", "100.00"), ("INV-2", "200.50"), ("INV-4", "400")])
    a, b = profile.described(left, ["ord"]), profile.described(right, ["ord"])
    assert [round(p.key_score, 2) for p in a.orderBy("position").collect()] == [0.85, 0.0]
    pairs = {(r.l.name, r.r.name): r for r in profile.scored_pairs(a, b).collect()}
    assert set(pairs) == {("Invoice No", "Reference"), ("Amount", "Total")} and pairs["Amount", "Total"].dtype == "money"
    assert round(pairs["Invoice No", "Reference"].score - 0.3, 3) > 0.275
    fields = {f["name"]: f for f in profile.field_dicts(profile.suggested_fields(a, b))}
    assert (fields["invoice"]["role"], fields["invoice"]["dtype"], fields["invoice"]["agg"]) == ("key", "text", "first")
    assert (fields["amount"]["dtype"], fields["amount"]["agg"], fields["amount"]["abs_tol"]) == ("money", "sum", "0.01")


def test_mapping_names_and_forced_key(spark):
    left = table(spark, ["Amount", "Total", "Über"], [("1", "10", "a"), ("1", "20", "a"), ("2", "30", "b")])
    right = table(spark, ["Total", "Amount", "Über"], [("10", "1", "a"), ("20", "2", "b"), ("40", "1", "a")])
    fields = profile.field_dicts(profile.suggested_fields(profile.described(left, ["ord"]), profile.described(right, ["ord"])))
    assert [(f["name"], f["left_source"], f["right_source"], f["role"]) for f in fields] == [("amount", "Amount", "Amount", "value"), ("amount_1", "Total", "Total", "key"), ("ber", "Über", "Über", "value")]
    assert [(f["dtype"], f["agg"], f.get("abs_tol"), f.get("text_fuzzy_threshold")) for f in fields] == [("money", "sum", "0.01", None), ("text", "sum", "0.01", None), ("text", "first", None, 85)]


def test_session_sinks_library(spark, tmp_path):
    (tmp_path / "l.csv").write_text("Invoice No,Amount\nINV-1,100\nINV-2,50\n")
    (tmp_path / "r.csv").write_text("Reference,Total\ninv-1,100.00\nINV-9,4\n")
    records = [grids.tables(files.read_cells(spark, str(tmp_path / n)).where("warning is null")) for n in ("l.csv", "r.csv")]
    session = Session().add("left", records[0]).add("right", records[1])
    cfg = EngineConfig.from_dict({"fields": session.suggest_mapping(), "matching": {"fuzzy_enabled": False}})
    result = session.reconcile(cfg)
    out = sinks.to_json(result, cfg)
    assert out["summary"]["matched_exact"] == 1 and out["reconciled"][0]["left_files"] == "l.csv" and not out["truncated"]["breaks"]
    book = sinks.result_workbook(result, cfg)
    assert files.sheet_names(book) == ["summary", "field_variance", "breaks", "reconciled", "unmatched_left", "unmatched_right"]
    sinks.write_result(result, cfg, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/unmatched_left")).count() == 1
    doc = json.loads(sinks.processed(records[0], "upload").first()["json"])
    assert doc["tables"][0]["rows"][0] == {"Invoice No": "INV-1", "Amount": "100"}
    library = Library(spark, f"file://{tmp_path}/library")
    assert library.names() == [] and library.save("My table!", doc) == "My_table"
    library.write("bad.json", b"{")
    assert library.names() == ["My_table"] and library.get("My table!") == doc
    again = library.load("My_table")
    assert sorted(r["values"]["Amount"] for r in again.collect()) == ["100", "50"]
    assert session.add("right", again, True).cleared("left").left == ()
    assert library.write_synonyms("s.csv", b"Non-Interest Income,NII\n").count() == library.synonyms().count() == 2
    assert library.delete("My_table") and library.names() == [] and slug("//") == "reference"
    assert files.sheet_names(sinks.processed_workbook(doc)) == ["Index", "csv"]


def test_streaming_ingest(spark, tmp_path):
    from tallyframe.streaming import ingest

    (tmp_path / "in").mkdir()
    target, checkpoint = str(tmp_path / "records"), str(tmp_path / "checkpoint")
    for i in (1, 2):
        (tmp_path / f"in/f{i}.csv").write_text(f"Item,Amount\na,{i}\n")
        ingest(spark, str(tmp_path / "in"), target, checkpoint).awaitTermination()
    assert sorted(r["values"]["Amount"] for r in spark.read.parquet(target).collect()) == ["1", "2"]


def test_large_files_in_splits(spark, tmp_path):
    """Records in order whatever the splits, quoted line breaks at their borders included."""
    import csv
    import io

    from tallyframe.sources import delimited

    chance, files_ = random.Random(7), {}
    for name, sep in (("a.csv", ";"), ("b.csv", ","), ("c.tsv", "\t")):
        rows = [[str(i), chance.choice(["plain", 'with "quotes"', f"two{sep}parts", "line\nbreak", "a\n\n\nb", "x" * 60, ""]), chance.choice(["", "é", "end"])] for i in range(60)]
        out = io.StringIO()
        csv.writer(out, delimiter=sep, lineterminator="\r\n" if name == "b.csv" else "\n").writerows([["number", "text", "last"], *rows])
        (tmp_path / name).write_text(out.getvalue(), encoding="utf-8", newline="")
        files_[name] = rows
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert delimited.lines(spark, str(tmp_path)).select("file", "split").distinct().count() > 8
        got = delimited.read_large(spark, str(tmp_path)).orderBy("ord").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, rows in files_.items():
        mine = [[r["number"], r["text"] or "", r["last"] or ""] for r in got if r["ord"]["file"].endswith(name)]
        assert [a for a, b in zip(mine, rows, strict=True) if a != b] == [b for a, b in zip(mine, rows, strict=True) if a != b]
    (tmp_path / "none").mkdir()
    (tmp_path / "none/x.csv").write_text("\n")
    assert delimited.read_large(spark, str(tmp_path / "none")).count() == 0


def test_cells_of_many_files_go_out_together(monkeypatch):
    from tallyframe.sources import files

    frames = [pd.DataFrame({"path": [f"{i}.csv" for i in range(50)], "content": [b"a;b\n1;2\n"] * 50})] * 2
    out = list(files.parse_frames()(iter(frames)))
    assert len(out) == 1 and len(out[0]) == 400
    monkeypatch.setattr(files, "OUT_ROWS", 7)
    parts = list(files.parse_frames()(iter(frames)))
    assert max(map(len, parts)) == 7 and pd.concat(parts).reset_index(drop=True).equals(out[0])


def test_page_rows_are_one_grouping(spark):
    """Words are brought together once a page, and nothing is joined back to them."""
    from tallyframe.operators import pages

    words = [("d", 1, 600.0, t, x0, x1, top, size) for t, x0, x1, top, size in (
        ("Net", 40.0, 58.0, 10.0, 9.0), ("sales", 62.0, 90.0, 11.0, 9.0), ("1,200", 270.0, 300.0, 10.5, 9.0), ("2", 92.0, 96.0, 9.0, 5.0), ("7", 440.0, 450.0, 10.0, 9.0),
        ("Costs", 40.0, 70.0, 24.0, 9.0), ("(30)", 276.0, 301.0, 24.0, 9.0), ("–", 445.0, 450.0, 25.0, 9.0), ("far", 500.0, 520.0, 24.0, 9.0))]
    words += [("none", 1, 600.0, "text", 40.0, 60.0, 10.0, 9.0)]
    found = pages.rows(spark.createDataFrame(words, "doc string, page int, page_width double, text string, x0 double, x1 double, top double, size double"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted((r.doc, r.line, r.label, r.cells) for r in found.collect()) == [("d", 0, "Net sales", ["1,200", "7"]), ("d", 1, "Costs", ["(30)", "–"])]


def test_bytes_of_refused_files_stay_where_they_are(spark):
    """Only files whose kind is read send their bytes to the parser; what is told of all stays the same."""
    from tallyframe.sources import files

    made = [("a/b.PDF", b"%PDF"), ("c.xls", b"x"), ("d.bin", b"x"), ("e", b"x"), (".csv", b"a,b\n"), ("f.csv", b" \n"), ("g.XLSX", b"no zip"), ("h.json", b"{}"), ("i.txt", b"a  b\nc  d"), ("x.csv/j", b"a,b")]
    given = spark.createDataFrame(made, "path string, content binary")
    (seen,) = [f for f in files.parsed(given)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "AS content" in f][:1]
    assert "CASE WHEN" in seen and "pdf" not in seen
    got = {(r.doc_id, r.code) for r in files.warnings(files.parsed(given)).collect()}
    want = {(p.rsplit("/", 1)[-1], r[6]) for p, data in made for r in files.parse_file(p.rsplit("/", 1)[-1], data) if r[6]}
    assert got == want and len(got) == 8
    cells = sum(not r[6] for p, data in made for r in files.parse_file(p.rsplit("/", 1)[-1], data))
    assert files.parsed(given).where("warning is null").count() == cells == 7
