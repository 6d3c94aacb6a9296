"""Packing, source divergence and ranked search against brute force, with the odd cases of each."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyframe.llm import divergence, lexical, packing, queries, terms

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n long, term string, value long"
ODD = [
    (1, None, "en", "a", 1, "x", None),
    (2, "", None, None, 0, "x", 1),
    (4, "same text here", "en", "b", 5, None, 1),
    (4, "same text here", "en", "b", 5, None, 1),
    (5, "same Text here", "de", "b", 5, "z", 1),
    (None, "here no id at all", "de", "c", 1, "z", 1),
    (None, None, None, None, None, None, None),
    (6, "word " * 30_000, "en", "c", 9, "q", 1),
    (7, "… ✓ 123 \x00 Éa", "fr", "a", 1, "q", 1),
    (8, "here " * 40 + "<|endoftext|>", "en", "a", 1, "q", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def against_sql(spark, name, **tables):
    con = duckdb.connect()
    for n, df in tables.items():
        con.register(n, df.toArrow())
    want = con.sql(queries.ORACLE[name])
    return want.columns, sorted(map(str, want.fetchall()))


# --- terms


@pytest.mark.parametrize("digits", [False, True])
def test_cut(digits):
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+" if digits else r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    texts = ["", None, "Abc abc", "xé", "y Z1 2z", "ÀB-c d", " ", "1a", "…✓", "end", ""]
    codes, words, rows = terms.cut(pa.array(texts).slice(1), digits)
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t)
    want = [(i, w) for i, t in enumerate(texts[1:]) for w in re.findall(pattern, lower(t or ""))]
    assert list(zip(rows.tolist(), words.take(pa.array(codes)).to_pylist(), strict=True)) == want


def test_runs():
    texts = ["a" * n for n in (3, 0, 50, 2, 2, 2, 7, 1)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i:j])], ["text"]) for i, j in ((0, 2), (2, 3), (3, 3), (3, 8))]
    got = [b.column("text").to_pylist() for b in terms.runs(iter(batches), size=6)]
    assert sum(got, []) == texts and all(len(b) == 1 or sum(map(len, b)) <= 6 for b in got)
    got = [b.column("text").to_pylist() for b in terms.runs(iter(batches), size=1000, rows=3)]
    assert [len(b) for b in got] == [3, 3, 2] and sum(got, []) == texts


# --- packing


def slowly(examples, limits, cut):
    """The same packing by loops over lists, the whole pool at once."""
    out, pool = [], []
    for key, n, lead in examples:
        start = 0
        while start < n:
            k = min(n - start, limits.tokens, max(0, lead - start) + limits.loss)
            if k == limits.tokens:
                out.append([(key, start, k)])
            else:
                pool.append([key, start, k, min(k, max(0, lead - start))])
            start += k
    while pool:
        room, placed = [limits.tokens, limits.segments, limits.loss], []
        while pool and room[0] and room[1]:
            best = None
            for whole in (True, False) if cut else (True,):
                for p in pool:
                    k = p[2] if whole else min(room[0], p[3] + room[2])
                    if whole and (p[2] > room[0] or p[2] - p[3] > room[2]) or not k:
                        continue
                    score = sum(d * r / f**2 for d, r, f in zip((k, 1, k - min(k, p[3])), room, (limits.tokens, limits.segments, limits.loss), strict=True)) + 1e-9 * p[2] / (1 + p[2])
                    if best is None or score > best[0] + 1e-15:
                        best = score, k, p
                if best:
                    break
            if not best:
                break
            _, k, p = best
            loss = k - min(k, p[3])
            placed.append((p[0], p[1], k))
            room = [room[0] - k, room[1] - 1, room[2] - loss]
            p[1], p[2], p[3] = p[1] + k, p[2] - k, max(0, p[3] - k)
            if not p[2]:
                pool.remove(p)
        out.append(placed)
    return out


@pytest.mark.parametrize("cut", [True, False])
def test_packer_places_as_the_heuristic_says(cut):
    rng = random.Random(3)
    for limits in (packing.Limits(64, 5, 40), packing.Limits(100, 3, 100), packing.Limits(32, 50, 7)):
        sizes = rng.sample(range(1, 90), 40)
        examples = [(i, n, rng.choice([0, 0, n // 2, n])) for i, n in enumerate(sizes)]
        got = []
        packer = packing.Packer(limits, cut, lambda pieces: got.append([(e.key, s, k, loss) for e, s, k, loss in pieces]))
        for key, n, lead in examples:
            packer.add(packing.Example(key, np.arange(n, dtype=np.uint32), n), n, lead)
        packer.close()
        spread, lead = defaultdict(list), {k: v for k, _, v in examples}
        for s in got:
            assert sum(p[2] for p in s) <= limits.tokens and len(s) <= limits.segments and sum(p[3] for p in s) <= limits.loss
            for key, start, k, loss in s:
                assert loss == max(0, start + k - max(start, lead[key]))
                spread[key].append((start, k))
        for key, n, _ in examples:
            at = 0
            for start, k in sorted(spread[key]):
                assert start == at
                at += k
            assert at == n
        want = slowly(examples, limits, cut)
        want, bare = ([[p[2] for p in s] for s in x] for x in (want, got))  # equal pieces may stand for one another
        if cut:  # the last is cut at powers of two
            while bare[-1:] and bare[-1] and bare[: len(want) - 1] == want[:-1] and len(bare) > len(want):
                assert sum(bare[-1]).bit_count() == 1
                bare.pop()
            assert bare[: len(want) - 1] == want[:-1]
        else:
            assert bare == want


def test_pool_is_bounded():
    limits = packing.Limits(64, 8, 64)
    packer = packing.Packer(limits, True, lambda pieces: None, pool=16)
    for i in range(500):
        packer.add(packing.Example(i, np.arange(i % 60 + 1, dtype=np.uint32), i % 60 + 1), i % 60 + 1, 0)
        assert packer.n <= 32
    packer.close()
    assert packer.n == 0


def whole_pieces(rows, spelt, tokens=1024):
    """Check that pieces tile documents and sequences; ``spelt``: ids of each document (a list: rows may repeat)."""
    at = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id] and r.length > 0
        at[r.sequence_id] += r.length
    assert max(at.values(), default=0) <= tokens
    left = Counter((key, start, crc) for key, ids in spelt for start, crc in [(None, tuple(ids))])
    per = defaultdict(list)
    for r in rows:
        per[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for key, pieces in per.items():
        mine = [ids for (k, _, ids), n in left.items() if k == key for _ in range(n)]
        assert sum(p[1] for p in pieces) == sum(map(len, mine)) and {p[3] for p in pieces} == {len(m) for m in mine}
        for start, length, crc, n in pieces:
            assert any(len(m) == n and zlib.crc32(np.array(m[start : start + length], dtype="<u4").tobytes()) == crc for m in mine)
    assert set(per) == {k for k, _ in spelt}
    return at


def test_op11_packs_every_id_once(spark):
    library = Tokenizer.from_file(queries.vocabulary_path())
    docs = queries.table(spark, SF, "documents")
    rows = queries.op11_packing(spark, SF).collect()
    spelt = [(r.doc_id, [*library.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in docs.collect()]
    at = whole_pieces(rows, spelt)
    total = sum(at.values())
    padding = sum(1024 - n for n in at.values() if n & (n - 1))
    assert padding <= 0.001 * total


def test_packing_odd(spark, odd, none):
    library = Tokenizer.from_file(queries.vocabulary_path())
    got = packing.pack(odd, queries.vocabulary_path()).withColumnsRenamed({"id": "doc_id", "n_tokens": "doc_tokens"})
    whole_pieces(got.collect(), [(r[0], [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in ODD])
    assert packing.pack(none, queries.vocabulary_path()).collect() == []
    with pytest.raises(ValueError):
        packing.pack(odd, "x", parts=[("text", True), ("lang", False)])
    with pytest.raises(ValueError):
        packing.Limits(segments=0)


def test_packing_instructions(spark):
    """Prompts bear no loss; examples stay whole; sequences are spelt and padded."""
    rows = [(i, "ask " * (i % 7), "answer " * (1 + i % 11)) for i in range(60)] + [(99, None, None)]
    limits = packing.Limits(tokens=40, segments=4, loss=20)
    df = spark.createDataFrame(rows, "n long, prompt string, response string").coalesce(1)
    pieces = packing.pack(df, queries.vocabulary_path(), "n", [("prompt", False), ("response", True)], limits, cut=False, end_id=0, with_ids=True)
    got = pieces.collect()
    assert sorted(r.id for r in got) == sorted(r[0] for r in rows) and all(r.start == 0 and r.length == r.n_tokens for r in got)
    load = defaultdict(lambda: np.zeros(3, dtype=int))
    for r in got:
        load[r.sequence_id] += (r.length, 1, r.loss)
    assert all((v <= (40, 4, 20)).all() for v in load.values())
    for s in packing.sequences(pieces, limits, pad_id=7).collect():
        ids = np.frombuffer(s.ids, dtype="<u4")
        assert len(ids) == (s.n_tokens if s.n_tokens & (s.n_tokens - 1) == 0 else 40) and (ids[s.n_tokens :] == 7).all()
        assert ids[: s.n_tokens].tobytes() == b"".join(r.ids for r in sorted((r for r in got if r.sequence_id == s.sequence_id), key=lambda r: r.offset))


# --- divergence


def audited(rows, min_docs, told):
    """The audit by dictionaries."""
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {w[0] for w in words}:
        mine = [(s, t) for x, s, t in words if x == lang]
        df = Counter(w for _, t in mine for w in set(t))
        kept = [w for w, n in df.items() if n >= min_docs]
        count = {s: Counter() for s, _ in mine}
        for s, t in mine:
            count[s].update(w for w in t if df[w] >= min_docs)
        every = sum(count.values(), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))
        for s in count:
            pairs = [(-sum(abs(share(count[s], w) - share(count[o], w)) for w in kept), o) for o in count if o != s]
            marks = [(share(every, w) - share(count[s], w), w) for w in kept if count[s][w] and share(count[s], w) > share(every, w)]
            for part, items, most in (("pair", pairs, None), ("term", marks, told)):
                out += [(lang, s, part, w, -v, i + 1) for i, (v, w) in enumerate(sorted(items, key=lambda x: (x[0], x[1].encode()))[:most])]
    return sorted(out)


def test_divergence_by_dictionaries(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "abcdé" for b in "xyz"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "de", None]), rng.choice("ABCDEFG") if rng.random() < 0.6 else "A") for _ in range(300)]
    rows += [(None, "en", "only null"), ("1 2 3", "xx", "p"), ("", "xx", "q"), ("", "yy", None)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    for min_docs, told in ((3, 4), (30, 50), (1, 2)):
        got = divergence.audit(df, min_docs=min_docs, told=told)
        assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == audited(rows, min_docs, told)


def test_divergence_pairs_of_a_column_in_parts(monkeypatch):
    """Columns that many sources have are met a few sources at a time."""
    rng = random.Random(2)
    column = [[{"sid": s, "n": 1, "p": rng.randint(5, 90), "b": 5 + s} for s in sorted(rng.sample(range(12), k))] for k in (12, 2, 7, 3)]
    kind = pa.list_(pa.struct([("sid", pa.int64()), ("n", pa.int64()), ("p", pa.int64()), ("b", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "x", "y", "x"]), pa.array(column, kind), pa.array([3, 1, 2, 5])], ["lang", "column", "times"])
    seen = []
    for most in (1 << 20, 5):
        monkeypatch.setattr(divergence, "PAIRS", most)
        total = Counter()
        for b in divergence._together(iter([batch])):
            for lang, i, j, v in zip(*(b.column(n).to_pylist() for n in ("lang", "i", "j", "value")), strict=True):
                total[lang, i, j] += v
        seen.append(total)
    want = Counter()
    for lang, c, times in zip("xxyx", column, (3, 1, 2, 5), strict=True):
        for x in c:
            for y in c:
                if x["sid"] < y["sid"]:
                    want[lang, x["sid"], y["sid"]] += times * (abs(x["p"] - y["p"]) - abs(x["p"] - y["b"]) - abs(x["b"] - y["p"]) + abs(x["b"] - y["b"]))
    assert seen[0] == seen[1] == want


def test_divergence_odd(spark, odd, none):
    got = divergence.audit(odd).collect()
    columns, want = against_sql(spark, "op12_divergence", documents=odd)
    assert sorted(str(tuple(r[c] for c in columns)) for r in got) == want
    assert divergence.audit(none).collect() == []


# --- ranked search


def ranked(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    bags = [(d, Counter(split(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(split(text))
    out = []
    for item, ts in asked.items():
        scored = []
        for d, b in bags:
            m = 50 + (50 * sum(b.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in ts if b[t])
            if s > 0:
                scored.append((-s, (d is not None, d or 0), d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scored, key=lambda x: x[:2])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_search_by_brute_force(spark, k):
    rng = random.Random(k)
    words = [f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(400)]
    docs = [(i * 3 % 301, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 5, 40])))) for i in range(301)] + [(1000 + i, "w1 W7 w9") for i in range(40)] + [(None, "w1 w2"), (5, "w3"), (6, None)]
    items = [(i, " ".join(rng.choices(words, k=i % 9))) for i in range(20)] + [(3, "w1 w999"), (None, "w2 w2"), (50, None), (51, "nowhere")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    index = lexical.build(d)
    for block in (2000, 5):
        got = lexical.search(index, q, k, items=block).select("item_id", "rank", "doc_id", "score")
        assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items, k)


def test_tree_opens_few_nodes():
    """Best first: a rare term's documents are found without opening the rest."""
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["a", "b", "c", "d"], k=30)) + (" rare" if i in (700, 3001) else "") for i in range(4096)]
    shard = lexical.shard_of(np.arange(4096), pa.array(texts), 4096, sum(len(t.split()) for t in texts))
    tree = lexical.Tree(shard["doc_ids"], shard["df"], shard["impacts"], shard["bits"])
    opened = []
    inner = tree._open
    tree._open = lambda depth, *a: (opened.append(len(depth)), inner(depth, *a))[1]
    names = shard["terms"].to_pylist()
    best = lexical.Best(2)
    ts = ["rare", "a"]
    tree.search(np.array([names.index(t) for t in ts]), np.array([7000, 1]), best)
    assert sorted(best.ids.tolist()) == [700, 3001] and sum(opened) < 1500


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65])
def test_tree_levels(n):
    """Every level holds the postings of each node by falling impact within a term."""
    rng = random.Random(n)
    texts = [" ".join(rng.choices("abcdef", k=rng.randint(1, 9))) for _ in range(n)]
    shard = lexical.shard_of(np.arange(n) * 10, pa.array(texts), n, sum(len(t.split()) for t in texts))
    tree = lexical.Tree(shard["doc_ids"], shard["df"], shard["impacts"], shard["bits"])
    for term, name in enumerate(shard["terms"].to_pylist()):
        best = lexical.Best(n)
        tree.search(np.array([term]), np.array([1]), best)
        assert sorted(best.ids.tolist()) == [10 * i for i, t in enumerate(texts) if name in t.split()]


def test_search_odd(spark, odd, none):
    q = spark.createDataFrame([(1, "here word"), (2, None), (3, "éa 123 text")], "item_id long, text string")
    got = lexical.search(lexical.build(odd), q).collect()
    columns, want = against_sql(spark, "op13_lexical_search", documents=odd, benchmark=q)
    assert {r.doc_id for r in got if r.item_id == 1} == {4, 5, None, 6, 8}
    # DuckDB sorts nulls last: the row without id is compared apart
    assert sorted(str((r.item_id, r.score)) for r in got) == sorted(str((x[0], x[3])) for x in map(eval, want)) and columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.search(lexical.build(none), q).collect() == []
    assert lexical.search(lexical.build(odd), q.where("item_id < 0")).collect() == []


@pytest.mark.parametrize("name", ["op12_divergence", "op13_lexical_search"])
def test_query_against_sql(spark, name):
    tables = {n: queries.table(spark, SF, n) for n in ("documents", "benchmark")}
    columns, want = against_sql(spark, name, **tables)
    got = queries.QUERIES[name](spark, SF).collect()
    assert sorted(str(tuple(r[c] for c in columns)) for r in got) == want
