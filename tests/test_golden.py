"""Whole reconciliations with results known by hand."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.config import ConfigurationError, EngineConfig, FieldConfig
from tallyframe.operators.assign import assign
from tallyframe.operators.canonical import canonicalize
from tallyframe.operators import ontology as synonyms
from tallyframe.plans.reconcile import reconcile

INVOICES = {
    "fields": [
        {"name": "invoice", "role": "key", "dtype": "text", "left_source": "Inv", "right_source": "Ref"},
        {"name": "amount", "role": "value", "dtype": "money", "left_source": "Amt", "right_source": "Total", "agg": "sum", "abs_tol": "0.01"},
    ]
}


def side(spark, rows, *names):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"ord int, {', '.join(f'{n} string' for n in names)}")


def run(spark, left, right, cfg=INVOICES, **more):
    return reconcile(side(spark, left, "Inv", "Amt"), side(spark, right, "Ref", "Total"), cfg, ["ord"], ["ord"], **more)


def test_exact_fuzzy_break_unmatched(spark):
    left = [("INV-1001", "100.00"), ("INV-1001", "50.00"), ("INV-1002", "75.5"), ("INV-1003", "10"), ("ACME CORP LTD", "20")]
    right = [("inv-1001", "150.00"), ("INV-1002", "75.00"), ("INV-1004", "5"), ("LTD ACME CORP", "20")]
    r = run(spark, left, right)
    s = r.summary.first()
    assert (s.left_records, s.right_records, s.matched_pairs, s.matched_exact, s.matched_fuzzy_or_semantic) == (4, 4, 3, 2, 1)
    assert (s.reconciled, s.breaks, s.unmatched_left, s.unmatched_right) == (2, 1, 1, 1)
    assert (s.reconciliation_rate, s.match_rate_left, s.match_rate_right) == (66.67, 75.0, 75.0)
    v = r.field_variance.first()
    assert (v.field, v.sum_left_minus_right, v.sum_abs_difference, v.n_breaks) == ("amount", Decimal("0.50"), Decimal("0.50"), 1)
    assert [x.key for x in r.unmatched_left.collect()] == ["inv-1003"]
    assert [x.key for x in r.unmatched_right.collect()] == ["inv-1004"]
    fuzzy = r.matches.where("match_type = 'fuzzy'").first()
    assert fuzzy.confidence == 1.0 and fuzzy.explanation == "Matched on fuzzy key 100% (confidence 100%)."
    assert r.breaks.first().break_fields == ["amount"]


def test_landing_page_sample(spark):
    left = [("INV-1001", "1,200.50"), ("INV-1002", "3,400.00"), ("INV-1003", "5,000.00"), ("INV-1004", "880.00")]
    right = [("INV-1001", "1,200.50"), ("INV-1002", "3,400.00"), ("INV-1003", "4,999.00"), ("INV-1004", "880.00")]
    s = run(spark, left, right).summary.first()
    assert (s.matched_exact, s.reconciled, s.breaks, s.reconciliation_rate) == (4, 3, 1, 75.0)


def test_greedy(spark):
    edges = [("A", "X", 0.95), ("A", "Y", 0.95), ("B", "X", 0.94), ("B", "Y", 0.61)]
    df = spark.createDataFrame([("", i, *e) for i, e in enumerate(edges)], "block string, n int, left_key string, right_key string, c double")
    for local in (0, 100):
        got = {tuple(r) for r in assign(df, [-F.col("c"), F.col("n")], local).collect()}
        assert got == {("A", "X"), ("B", "Y")}


def test_duplicates_and_scale(spark):
    cfg = EngineConfig.from_dict(INVOICES)
    rows = canonicalize(side(spark, [("INV-9", "10.00"), ("INV-9", "10.00")], "Inv", "Amt"), cfg, "left", ["ord"]).first()
    assert (rows.amount, rows.row_count) == (Decimal(10), 1)
    rows = canonicalize(side(spark, [("INV-9", "10.0"), ("INV-9", "10.00")], "Inv", "Amt"), cfg, "left", ["ord"]).first()
    assert (rows.amount, rows.row_count) == (Decimal(20), 2)


def one(spark, dtype, left, right, **more):
    cfg = {"fields": [INVOICES["fields"][0], {"name": "v", "dtype": dtype, "left_source": "Amt", "right_source": "Total", "agg": "first", **more}]}
    return run(spark, [("k", left)], [("k", right)], cfg).matches.first()


def test_compare_edges(spark):
    m = one(spark, "numeric", None, None)
    assert (m.v__diff, m.v__ok) == (None, True)
    m = one(spark, "numeric", None, "5")
    assert (m.v__diff, m.v__pct, m.v__ok) == (Decimal(-5), -1.0, False)
    m = one(spark, "numeric", "5", "0")
    assert (m.v__pct, m.v__ok) == (float("inf"), False)
    assert one(spark, "numeric", "101", "100", rel_tol=0.01).v__ok
    m = one(spark, "date", "2024-01-03", "2024-01-01", abs_tol="2")
    assert (m.v__diff, m.v__ok, m.v__left) == (Decimal(2), True, datetime.date(2024, 1, 3))
    assert not one(spark, "date", "2024-01-03", "2024-01-01", abs_tol="1").v__ok
    m = one(spark, "date", "2024-01-03", None)
    assert (m.v__diff, m.v__ok) == (None, False)
    assert one(spark, "text", None, "").v__ok
    assert one(spark, "text", "Straße", "STRASSE").v__ok
    assert one(spark, "text", "small ring", "ring smal", text_fuzzy_threshold=85).v__ok


def test_ontology_keys(spark):
    many = [[f"Term {i}", f"alias {i}"] for i in range(1500)]
    table = synonyms.aliases(synonyms.groups(spark, [*many, [" ", "Non-Interest Income", "NII"], ["Early", "twice"], ["Late", "Twice"]]))
    s = run(spark, [("NII", "1"), ("twice", "2")], [("Non-Interest  Income", "1"), ("LATE", "2")], ontology=table).summary.first()
    assert (s.matched_exact, s.reconciled) == (2, 2)
    two = {"fields": [{"name": "a", "role": "key", "left_source": "Inv", "right_source": "Ref"}, {"name": "b", "role": "key", "left_source": "Amt", "right_source": "Total"}], "matching": {"fuzzy_enabled": False}}
    s = run(spark, [("alias 7", "alias 8")], [("Term 7", "term 8")], two, ontology=table).summary.first()
    assert s.matched_exact == 1
    both = synonyms.merged(table, synonyms.aliases(synonyms.groups(spark, {"Net": ["nii"]})))
    assert {r.alias: r.canonical for r in both.where("alias in ('nii', 'net', 'twice')").collect()} == {"nii": "Net", "net": "Net", "twice": "Late"}
    assert synonyms.statistics(both.where("canonical = 'Net'")).first() == ("Net", 2, ["net", "nii"])


@pytest.mark.parametrize(("name", "data"), [("s.json", b'{"Sales": ["revenue", ""]}'), ("s.json", b'[["Sales", "Revenue"]]'), ("s.csv", b"Sales,revenue\n"), ("s.tsv", b"Sales\trevenue\n"), ("s", "\ufeffSales|revenue\n\n".encode())])
def test_synonym_files(spark, name, data):
    table = synonyms.aliases(synonyms.file_groups(spark, name, data))
    assert {r.alias: r.canonical for r in table.collect()} == {"sales": "Sales", "revenue": "Sales"}


def test_settings_left_open():
    raw = {"fields": [{"name": " k ", "role": "key", "left_source": "", "abs_tol": "", "rel_tol": None, "text_fuzzy_threshold": "", "agg": None, "match_weight": ""}], "norm": {"decimal_places": None, "other": 1}, "matching": {"fuzzy_threshold": "", "blocking_field": "", "accept_threshold": "0.7", "weight_exact": 9}}
    cfg = EngineConfig.from_dict(raw)
    assert cfg.fields[0] == FieldConfig("k", role="key") and cfg.norm == EngineConfig(()).norm
    assert (cfg.matching.fuzzy_threshold, cfg.matching.blocking_field, cfg.matching.accept_threshold, cfg.matching.weight_exact) == (90.0, None, 0.7, 1.0)


def test_empty_keys(spark):
    cfg = EngineConfig.from_dict({"fields": [{"name": "a", "role": "key", "left_source": "Inv"}, {"name": "b", "role": "key", "left_source": "Amt"}]})
    rows = canonicalize(side(spark, [(None, None), ("a", None), (None, "b")], "Inv", "Amt"), cfg, "left", ["ord"])
    assert sorted(r.key for r in rows.collect()) == ["a|", "|b"]


def test_semantic_and_numeric(spark):
    cfg = INVOICES | {"matching": {"fuzzy_enabled": False, "semantic_enabled": True, "numeric_enabled": True, "semantic_threshold": 50}}
    r = run(spark, [("net interest income group", "100")], [("interest income net", "100"), ("other", "3")], cfg)
    m = r.matches.first()
    assert m.right_key == "interest income net" and m.match_type == "semantic"
    assert [s.strategy for s in m.strategy_scores] == ["semantic", "numeric"]


def test_empty_side(spark):
    s = run(spark, [], [("a", "1")]).summary.first()
    assert (s.left_records, s.unmatched_right, s.reconciliation_rate) == (0, 1, 0.0)


@pytest.mark.parametrize("raw", [{}, {"fields": []}, {"fields": [{"name": "a"}]}, {"fields": [{"name": "a", "role": "key"}, {"name": "a"}]}, {"fields": [{"role": "key"}]}, {"fields": [{"name": "a", "role": "boss"}]}, {"fields": [{"name": "a", "role": "key", "abs_tol": "x"}]}, {"fields": [{"name": "a", "role": "key", "abs_tol": "NaN"}]}, {"fields": [{"name": "a", "role": "key"}], "matching": {"fuzzy_threshold": "much"}}])
def test_bad_config(raw):
    with pytest.raises(ConfigurationError):
        EngineConfig.from_dict(raw)
