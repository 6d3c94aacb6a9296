"""Candidates, assignment and value sets against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.config import EngineConfig
from tallyframe.functions import similarity
from tallyframe.operators import assign, bands, blocks, matching, near, profile, tfidf


@pytest.mark.parametrize("threshold, few", [(55.0, 0), (80.0, 0), (90.0, 0), (97.5, 0), (75.0, 10**9)])
def test_near_pairs_by_brute_force(spark, threshold, few):
    chance = random.Random(int(threshold))

    def texts(n):
        out = {"", "a", "ab", "aaaaaaaa", "inv 2024 0001", "ünïcödé text"}
        while len(out) < n:
            base = chance.choice(sorted(out))
            at = chance.randrange(len(base) + 1)
            out.add("".join(chance.choices("abc ", k=chance.randrange(1, 30))) if chance.random() < 0.3 else base[:at] + chance.choice("abcx") + base[at + chance.randrange(2) :])
        return sorted(out)

    left = texts(150)
    right = sorted(set(texts(150)) | set(left[::2]))
    frame = lambda xs, tag: spark.createDataFrame([(str(i % 2), f"{tag}{i}", x) for i, x in enumerate(xs)], f"block string, {tag}_key string, {tag}_sorted string")
    got = {(r.left_key, r.right_key) for r in near.near_pairs(frame(left, "left"), frame(right, "right"), threshold, few=few).collect()}
    asked = set()
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            total = len(x) + len(y)
            if i % 2 == j % 2 and (not total or 200.0 * similarity.common_subsequence(x, y) / total >= threshold):
                asked.add((f"left{i}", f"right{j}"))
    assert len(asked) > 20 and not asked - got


def test_near_pairs_without_rows(spark):
    frame = lambda tag, rows: spark.createDataFrame(rows, f"block string, {tag}_key string, {tag}_sorted string")
    assert near.near_pairs(frame("left", []), frame("right", [("", "k", "t")]), 90.0).count() == 0
    assert near.near_pairs(frame("left", [("", "k", "t")]), frame("right", [("", "j", "u")]), 0).count() == 1


def _names(seed: int, n: int, others=None):
    """Keys with a common beginning, some of them others with a few characters changed."""
    chance, out = random.Random(seed), set()
    while len(out) < n:
        if others and chance.random() < 0.5:
            k = list(chance.choice(others))
            for _ in range(chance.randrange(1, 4)):
                k[chance.randrange(14, len(k))] = chance.choice("abc0123")
            out.add("".join(k))
        else:
            out.add("invoice-2024 " + "".join(chance.choices("abcdefghijklmnopqrstuvwxyz", k=chance.randrange(20, 36))) + f"{chance.randrange(10**8):08d}")
    return sorted(out)


@pytest.mark.parametrize("threshold, n", [(90.0, 5000), (80.0, 1500), (70.0, 600)])
def test_near_pairs_of_a_common_beginning(spark, threshold, n):
    left = _names(1, n)
    right = _names(2, n, left)
    frame = lambda xs, tag: spark.createDataFrame([("", x, x) for x in xs], f"block string, {tag}_key string, {tag}_sorted string").repartition(4)
    l, r = frame(left, "left"), frame(right, "right")
    rows = near.index(l, r, threshold, "left_sorted", "right_sorted", "left_key", "right_key").groupBy("side", "key").count()
    assert rows.agg(F.max("count")).first()[0] <= 100
    got = {(x.left_key, x.right_key) for x in near.near_pairs(l, r, threshold, few=0).collect()}
    sizes = np.array([len(x) for x in left + right])
    missed = found = 0
    for at in range(0, n, 250):
        i, j = (x.ravel() for x in np.meshgrid(np.arange(at, min(n, at + 250)), np.arange(n, 2 * n), indexing="ij"))
        alike = similarity.common_subsequences(left + right, i, j) * 200 >= threshold * (sizes[i] + sizes[j])
        pairs = [(left[a], right[b - n]) for a, b in zip(i[alike], j[alike], strict=True)]
        found, missed = found + len(pairs), missed + sum(p not in got for p in pairs)
    assert found > 20 and not missed


def test_near_pairs_of_long_texts(spark):
    text = "".join(random.Random(4).choices("abcdefgh ", k=2000))
    frame = lambda x, tag: spark.createDataFrame([("", x, x)], f"block string, {tag}_key string, {tag}_sorted string")
    assert near.near_pairs(frame(text, "left"), frame(text[:900] + "xyz" + text[901:], "right"), 90.0, few=0).count() == 1


def test_common_subsequences_many_at_a_time():
    chance = random.Random(9)
    texts = ["", "a", "é" * 64, "ab" * 32] + ["".join(chance.choices("abcé ", k=chance.randrange(65))) for _ in range(40)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    want = [similarity.common_subsequence(texts[a], texts[b]) for a, b in zip(i, j, strict=True)]
    assert similarity.common_subsequences(texts, i, j).tolist() == want
    long = pd.Series([texts[5] * 9, "x y", None]).fillna("")
    assert similarity.ratios(long, pd.Series([texts[6] * 8, "y x", ""])).tolist() == [similarity.ratio(a, b) for a, b in zip(long, [texts[6] * 8, "y x", ""], strict=True)]


@pytest.mark.parametrize("least", [0.3, 0.6, 0.95, 1.0])
def test_band_pairs_by_brute_force(spark, least):
    chance = random.Random(int(least * 100))
    number = lambda: chance.choice([0.0, 1.0, -1.0, 0.5, None, chance.uniform(-2, 2), chance.uniform(-1e6, 1e6), 10 ** chance.uniform(-3, 9), -(10 ** chance.uniform(-3, 3))])
    left, right = ([(str(i % 2), f"{t}{i}", number(), number()) for i in range(220)] for t in "lr")
    right += [(b, f"c{k}", x and x * least * 1.0000001, y) for b, k, x, y in left[:60]]
    l, r = (spark.createDataFrame(x, f"block string, {t}_key string, {t}_a double, {t}_b double") for x, t in ((left, "left"), (right, "right")))
    near_ = lambda a, b: None if a is None or b is None else max(0.0, 1 - abs(a - b) / max(abs(a), abs(b), 1.0))
    got = {tuple(x) for x in bands.band_pairs(l, r, [("left_a", "right_a"), ("left_b", "right_b")], least).collect()}
    want = set()
    for x in left:
        for y in right:
            scores = [s for s in (near_(x[2], y[2]), near_(x[3], y[3])) if s is not None]
            if x[0] == y[0] and scores and sum(scores) / len(scores) >= least:
                want.add((x[1], y[1]))
    assert want and not want - got
    with pytest.raises(ValueError):
        bands.band_pairs(l, r, [("left_a", "right_a")], 0)


def test_candidates_of_all_strategies_by_brute_force(spark):
    """Fuzzy, semantic and numeric scores together: the same pairs and confidences as scoring every pair of a block."""
    chance, words = random.Random(8), ["acme", "steel", "paper", "north", "global"]
    rows = lambda t: [(f"{' '.join(chance.choices(words, k=3))} {t}{i}", chance.choice("xy"), round(chance.uniform(0, 50), 2) if i % 5 else None) for i in range(60)]
    left, right = rows("a"), rows("b")
    side = lambda xs: spark.createDataFrame([(k, (i,), b, v) for i, (k, b, v) in enumerate(xs)], "key string, ord struct<o:int>, kind string, v double").withColumn("v", F.col("v").cast("decimal(28,6)"))
    cfg = EngineConfig.from_dict({"fields": [{"name": "key", "role": "key"}, {"name": "v", "dtype": "money"}], "matching": {"fuzzy_enabled": True, "semantic_enabled": True, "numeric_enabled": True, "blocking_field": "kind", "fuzzy_threshold": 75, "semantic_threshold": 40, "accept_threshold": 0.7}})
    m = cfg.matching
    got = {(r.left_key, r.right_key): (r.confidence, r.match_type, len(r.strategy_scores)) for r in matching.candidates(side(left), side(right), cfg).collect()}
    want = {}
    tokens = lambda t: re.findall("[a-z0-9]+", t.lower())
    for block in "xy":
        ls, rs = ([(k, v) for k, b, v in xs if b == block] for xs in (left, right))
        df = Counter(t for k, _ in rs for t in set(tokens(k)))
        idf = {t: math.log((1 + len(rs)) / (1 + n)) + 1 for t, n in df.items()}
        vector = lambda k: {t: n * idf[t] / math.sqrt(sum((m * idf[u]) ** 2 for u, m in Counter(tokens(k)).items() if u in idf)) for t, n in Counter(tokens(k)).items() if t in idf}
        for k, v in ls:
            own = vector(k)
            cosine = [(-round(100 * sum(w * vector(o).get(t, 0) for t, w in own.items()), 9), i) for i, (o, _) in enumerate(rs)]
            best = min(cosine)
            for i, (o, u) in enumerate(rs):
                fuzzy = similarity.ratio(k, o)
                scores = [("fuzzy", fuzzy / 100 if fuzzy >= 75 else None, m.weight_fuzzy), ("semantic", -best[0] / 100 if i == best[1] and -best[0] >= 40 else None, m.weight_semantic), ("numeric", None if v is None or u is None else max(0.0, 1 - abs(v - u) / max(v, u, 1)), m.weight_numeric)]
                there = [s for s in scores if s[1] is not None]
                if there:
                    confidence = sum(s * w for _, s, w in there) / sum(w for _, _, w in there)
                    if round(confidence, 4) >= 0.7:
                        want[k, o] = (round(confidence, 4), max(there, key=lambda s: s[1] * s[2])[0], len(there))
    assert len(want) > 30 and set(got) == set(want)
    assert all(abs(got[p][0] - want[p][0]) < 2e-4 and got[p][1:] == want[p][1:] for p in want)


def test_best_match_by_brute_force(spark):
    chance = random.Random(6)
    words = [f"w{int(chance.paretovariate(0.7)) % 40}" for _ in range(300)]
    text = lambda k: " ".join(chance.choices(words, k=k))
    corpus = [("a" if i % 3 else "b", i, text(chance.randrange(0, 9))) for i in range(90)] + [("a", 900 + i, "w1 w2 w3") for i in range(3)]
    asked = [("a" if i % 2 else "b", i, text(chance.randrange(0, 25))) for i in range(120)] + [("a", 500, "w1 w2 w3"), ("b", 501, None), ("c", 502, "w1")]
    frame = lambda xs: spark.createDataFrame(xs, "block string, id long, text string").repartition(3)
    want = {}
    for block in "ab":
        docs = {i: Counter(t.split()) for b, i, t in corpus if b == block}
        df = Counter(w for d in docs.values() for w in d)
        idf = {w: math.log((1 + len(docs)) / (1 + n)) + 1 for w, n in df.items()}
        unit = lambda bag: (lambda raw, norm: {w: x / norm for w, x in raw.items()})(*(lambda raw: (raw, math.sqrt(sum(x * x for x in raw.values())) or 1))({w: n * idf[w] for w, n in bag.items() if w in idf}))
        units = {i: unit(d) for i, d in docs.items()}
        for b, q, t in asked:
            own = unit(Counter((t or "").split())) if b == block else {}
            scores = [(-round(100 * sum(w * u.get(x, 0) for x, w in own.items()), 9), i) for i, u in units.items()]
            if b == block and scores and min(scores)[0] < 0:
                want[q] = min(scores)[1], -min(scores)[0]
    for least in (0.0, 55.0):
        got = {r.left_id: (r.right_id, r.similarity) for r in tfidf.best_matches(frame(asked), frame(corpus), least=least).collect()}
        for q, (i, s) in want.items():
            if s >= least:
                assert got[q][0] == i and abs(got[q][1] - s) < 1e-6
        assert set(got) <= set(want)


def test_assign_by_parts(spark):
    """Chains in which each link waits for the next, and random links: as taking the links in order."""
    chance = random.Random(3)
    chain = [(f"a{i}", f"b{i}", 2 * i) for i in range(400)] + [(f"a{i + 1}", f"b{i}", 2 * i + 1) for i in range(400)]
    wild = [(f"l{chance.randrange(60)}", f"r{chance.randrange(60)}", chance.randrange(9)) for _ in range(300)]
    links = list({(a, b): (a, b, c) for a, b, c in chain + wild}.values())
    left, right, want = set(), set(), set()
    for c, a, b in sorted((c, a, b) for a, b, c in links):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            want.add((a, b))
    df = spark.createDataFrame(links, "left_key string, right_key string, c int")
    for bound in (50_000, 10):
        got = {tuple(r) for r in assign.assign(df, ["c"], bound).collect()}
        assert got == want


def test_components_of_a_long_chain(spark):
    from tallyframe.operators import components

    n, rounds = 20_000, []
    edges = spark.range(n).select(((F.col("id") * 7919) % n).alias("u"), (((F.col("id") + 1) * 7919) % n).alias("v")).where("id < 19999")
    inner = components._from_least
    components._from_least = lambda e: (rounds.append(1), inner(e))[1]
    try:
        roots = components.components(edges)
    finally:
        components._from_least = inner
    assert roots.agg(F.countDistinct("node"), F.countDistinct("root"), F.min("root")).first() == (n, 1, 0) and len(rounds) <= 20


def test_value_sets_of_many_columns(spark):
    rows = [(i, str(i % 7), None if i % 2 else f"{i}.0", "" if i < 50 else "x", None) for i in range(100)]
    df = spark.createDataFrame(rows, "n int, a string, b string, c string, d string").repartition(5)
    got = {r["name"]: r for r in profile.value_sets(df, ["n"], size=10).collect()}
    assert got["a"].value_set == [str(i) for i in range(7)] and got["a"]["sample"] == ["0", "1", "2", "3", "4"]
    assert got["b"].value_set == sorted(str(i) for i in range(0, 20, 2)) and got["b"]["sample"] == ["0.0", "2.0", "4.0", "6.0", "8.0"]
    assert got["c"].value_set == ["x"] and got["d"].value_set == [] and got["d"]["sample"] == []


def test_blocks_are_dealt_in_squares(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SIDE", 4)
    monkeypatch.setattr(blocks, "TASK_PAIRS", 16)
    l, r = spark.range(30).selectExpr("id % 2 as n", "id as l"), spark.range(21).selectExpr("id % 3 as n", "id as r")
    met = blocks.met(l, r, ["n"], "l", "r")
    got = [tuple(x) for x in met.select("l", "r").collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(30) for b in range(21) if a % 2 == b % 3}
    spread = [x["k"] for x in met.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("k")).collect()]
    assert len(spread) > 2  # two blocks, more tasks


@pytest.mark.parametrize("least", [0.45, 0.8, 0.97])
def test_mean_pairs_by_brute_force(spark, least):
    rng = random.Random(5)
    some = lambda: rng.choice([None, 0.0, float("nan"), *[round(rng.uniform(-3, 30), 1) for _ in range(12)]])
    left, right = [[(f"{s}{i}", rng.choice("xy"), some(), some()) for i in range(60)] for s in "lr"]
    table = lambda rows, k, a, b: spark.createDataFrame(rows, f"{k} string, block string, {a} double, {b} double")
    got = [(x["left_key"], x["right_key"]) for x in bands.mean_pairs(table(left, "left_key", "a", "b"), table(right, "right_key", "c", "d"), [("a", "c"), ("b", "d")], least).collect()]

    def mean(x, y):
        known = [1 - abs(p - q) / max(abs(p), abs(q), 1) for p, q in zip(x[2:], y[2:], strict=True) if not any(v is None or v != v for v in (p, q))]
        return sum(max(0.0, k) for k in known) / len(known) if known else -1

    want = {(x[0], y[0]) for x in left for y in right if x[1] == y[1] and mean(x, y) >= least - 1e-12}
    assert want and len(got) == len(set(got)) and set(got) == want


def test_near_numbers_are_not_joined_again(spark):
    """Pairs that only numbers speak for come with both their rows."""
    from tallyframe import queries

    found = queries.block_field(spark, "/root/testdata/sf0.001")
    assert not re.search(r"left_key#\d+ = left_key#\d+", found._jdf.queryExecution().optimizedPlan().toString())


def test_best_match_of_few_postings(spark):
    """A small corpus goes to the queries: no pair is shuffled, and both ways agree."""
    chance = random.Random(8)
    text = lambda k: " ".join(f"w{int(chance.paretovariate(0.7)) % 60}" for _ in range(k))
    frame = lambda n, k: spark.createDataFrame([("ab"[i % 2], i, text(chance.randrange(k))) for i in range(n)], "block string, id long, text string")
    asked, corpus = frame(150, 60).persist(), frame(60, 20).persist()
    found, pruned = tfidf.best_matches(asked, corpus), tfidf.best_matches(asked, corpus, few=0)
    shown = lambda df: {(r.block, r.left_id, r.right_id, round(r.similarity, 6)) for r in df.collect()}
    assert shown(found) == shown(pruned) and found.count() > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "right_id" in x]


def test_assign_groups_without_all_links(spark, monkeypatch):
    """Equal rows are linked as one, in bands: the same as taking every link in order; copies of rows make no more links."""
    rng = random.Random(11)
    lefts = [(f"c{i}", rng.choice("ab"), rng.choice([None, *range(100, 130)])) for i in rng.sample(range(10_000), 300)]
    rights = [(f"s{i}", rng.choice("ab"), rng.choice([None, *range(100, 130)])) for i in rng.sample(range(10_000), 60)]
    every = [(-(1 - abs(x - y) / 20), a, b) for a, n, x in lefts for b, m, y in rights if n == m and x is not None and y is not None and abs(x - y) <= 8]
    want, used = set(), set()
    for _, a, b in sorted(every):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    made = []

    def near(left, right, least):
        r = right.select(F.col("key").alias("right_key"), F.col("n").alias("m"), F.col("x").alias("y"))
        pairs = left.withColumnRenamed("key", "left_key").join(r, (F.col("n") == F.col("m")) & (F.abs(F.col("x") - F.col("y")) <= 8))
        found = pairs.select("left_key", "right_key", (1 - F.abs(F.col("x") - F.col("y")) / 20).alias("confidence")).where(F.col("confidence") >= (least or 0))
        made.append(found)
        return found

    sides = [spark.createDataFrame(rows, "key string, n string, x int") for rows in (lefts, rights)]
    for bound in (100, 10**6):
        got = [tuple(r) for r in assign.assign_groups(*sides, ["n", "x"], near, bound).collect()]
        assert set(got) == want and len(got) == len(want)
    assert 2 * made[-1].count() < len(every) and len(made) > 4


def test_groups_of_equal_rows_by_brute_force(spark, monkeypatch):
    """Rows of equal values go as one, missing and odd ones too, large groups as several: every pair of rows comes once."""
    monkeypatch.setattr(blocks, "SIDE", 8)
    monkeypatch.setattr(blocks, "RUN", 3)
    rng = random.Random(3)
    left, right = [[(f"{s}{i}", rng.choice("xy"), rng.choice([None, float("nan"), 0.0, 1.5, 1.5, 1.5])) for i in range(n)] for s, n in (("l", 90), ("r", 40))]
    table = lambda rows, k, v: spark.createDataFrame(rows, f"{k} string, block string, {v} double")
    groups = blocks.met_groups(table(left, "l", "a"), table(right, "r", "b"), ["block"], ["a"], ["b"], "l", "r").persist()
    got = [tuple(x) for x in blocks.apart(groups).select("l", "r").collect()]
    assert len(got) == len(set(got)) and set(got) == {(x[0], y[0]) for x in left for y in right if x[1] == y[1]}
    assert groups.agg(F.max(F.size(blocks.LEFT))).first()[0] <= 3 and 3 * groups.count() < len(got)


def _equal_balances(spark, folder, name):
    """A query over one nation of 2,000 customers and 500 suppliers with few balances: its rows against SQL, and the bytes of its files a row."""
    import os

    import duckdb

    import __spark_entry__ as entry

    con, out = duckdb.connect(), f"{folder}/out"
    con.sql(f"COPY (SELECT i AS c_custkey, 'c' AS c_name, 1 AS c_nationkey, (hash(i) % 200) * 37.25 AS c_acctbal, 'm' AS c_mktsegment FROM range(2000) t(i)) TO '{folder}/customer.parquet'")
    con.sql(f"COPY (SELECT i AS s_suppkey, 's' AS s_name, 1 AS s_nationkey, (hash(i + 9000) % 25) * 331.5 AS s_acctbal FROM range(500) t(i)) TO '{folder}/supplier.parquet'")
    entry.queries()[name](spark, str(folder)).write.parquet(out)
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{folder}/customer.parquet'; CREATE VIEW supplier AS SELECT * FROM '{folder}/supplier.parquet'; CREATE TABLE found AS SELECT * FROM '{out}/*.parquet'")
    con.sql(f"CREATE TABLE asked AS {entry.oracle_sql()[name]}")
    columns = ", ".join(x[0] for x in con.sql("SELECT * FROM asked LIMIT 0").description)
    assert con.sql(f"SELECT (SELECT count(*) FROM asked) - (SELECT count(*) FROM found), count(*) FROM (SELECT {columns} FROM asked EXCEPT ALL SELECT {columns} FROM found)").fetchall() == [(0, 0)]
    return sum(os.path.getsize(f"{out}/{f}") for f in os.listdir(out) if f.endswith(".parquet")) / con.sql("SELECT count(*) FROM found").fetchall()[0][0]


def test_pairs_of_equal_balances_are_small(spark, tmp_path):
    """Pairs that are judged alike come after each other, so that files store them as runs."""
    assert _equal_balances(spark, tmp_path, "confidence_dominant") < 1.0


def test_near_pairs_of_equal_balances_are_small(spark, tmp_path):
    assert _equal_balances(spark, tmp_path, "numeric_proximity") < 0.7


@pytest.mark.parametrize("accept", [0.0, 0.6])
def test_equal_numbers_are_scored_as_one(spark, accept):
    """Candidates that only numbers speak for are scored before rows of equal numbers come apart."""
    cfg = EngineConfig.from_dict({"fields": [{"name": "k", "role": "key"}, {"name": "v", "dtype": "money"}], "matching": {"fuzzy_enabled": False, "numeric_enabled": True, "accept_threshold": accept}})
    left, right = [[(f"{s}{i}", i % step) for i in range(n)] for s, n, step in (("l", 40, 7), ("r", 30, 4))]
    table = lambda rows: spark.createDataFrame(rows, "key string, n int").select("key", F.struct("key").alias("ord"), F.when(F.col("n") > 0, F.col("n")).cast("decimal(28,6)").alias("v"))
    found = matching.candidates(table(left), table(right), cfg)
    want = {(a, b, round(1 - abs(x - y) / max(x, y), 4)) for a, x in left for b, y in right if x and y and 1 - abs(x - y) / max(x, y) >= accept}
    got = [(r.left_key, r.right_key, r.confidence) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" in plan and plan.index("Generate inline") < plan.index("round(")
