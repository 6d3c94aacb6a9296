"""The driver contract: registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
CORE = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: "null" if v is None else repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(shown(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_queries_without_sql(spark):
    for name in sorted(set(entry.queries()) - set(entry.oracle_sql())):
        if not name.startswith("op") and name != "pipeline":
            assert entry.queries()[name](spark, SF).columns


def test_regions_and_headers_of_odd_cells(spark, tmp_path):
    """Addresses, dotted or half-bracketed figures, tabs, carriage returns and blanks of other kinds: numbers and labels are the same in the SQL."""
    import random

    chance = random.Random(5)
    cells = ["10.0.0.1", "1,2,3", "2024)", "(5)", "12", "Net", "-", "+3", "7-", "1.234,5", "Rev", "%", "5%", "\xa0", " x", "99 12", "٣", "", "_1", "$5", "1.5.", "x\t", "€ 7", "9" * 25]
    line = lambda: chance.choice(["| ", "", " "]) + " | ".join(chance.choices(cells, k=chance.randrange(1, 5))) + chance.choice([" |", "", " |\r"])
    docs = [(i, "\n".join(line() if chance.random() < 0.85 else chance.choice(["", " ", "|---|", "\r", "text"]) for _ in range(chance.randrange(2, 14)))) for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df, want = entry.queries()["regions_and_headers"](spark, str(tmp_path)), con.sql(entry.oracle_sql()["regions_and_headers"])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
