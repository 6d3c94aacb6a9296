"""Corpus operators against brute force, round trips and held-out labels, with the odd cases of each."""

import gzip
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import bpe, embeddings, exact_dedup, html_text, langid, mixing, quality, queries, simhash, toxicity, warc
from tallyframe.llm.common import WordMemo, gram_hashes
from tallyframe.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"
ODD = [(1, None, "en", "a", 1, "x"), (2, "", None, None, 0, "x"), (3, "", "en", "a", 0, "y"), (4, "same text here", "en", "b", 5, None), (4, "same text here", "en", "b", 5, None), (5, "same text here", "de", "b", 5, "z"), (None, "no id at all", "de", "c", 1, "z"), (None, None, None, None, None, None), (6, "word " * 30_000, "en", "c", 9, "q"), (7, "… ✓ 123", "fr", "a", 1, "q")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def closure(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_join_hot(spark, monkeypatch):
    from tallyframe.llm import buckets

    monkeypatch.setattr(buckets, "COLD_ROWS", 3)
    monkeypatch.setattr(buckets, "HOT_KEYS", 10)
    rows = [(k, i) for k, n in (("a", 50), ("b", 2), ("c", 1), ("d", 8), (None, 6)) for i in range(n)]
    df, table = spark.createDataFrame(rows, "k string, i long"), spark.createDataFrame([("a", 50, 1), ("b", 2, 2), ("d", 8, 3)], "k string, n long, v long")
    value = {"a": 1, "b": 2, "d": 3}
    for how in ("inner", "left"):
        got = sorted(((r.k, r.i, r.v) for r in buckets.join_hot(df, table, "k", "n", how).collect()), key=str)
        assert got == sorted(((k, i, value.get(k)) for k, i in rows if how == "left" or k in value), key=str)


def test_meetings(spark, monkeypatch):
    from tallyframe.llm import buckets

    for peek, peeked in ((0.02, 100), (0.9, 5)):  # without and with keys taken for hot
        monkeypatch.setattr(buckets, "PEEK", peek)
        monkeypatch.setattr(buckets, "PEEKED", peeked)
        nodes = spark.range(300).withColumnRenamed("id", "node")
        keys_of = lambda n: n.select(F.when(F.col("node") < 100, F.lit(-1)).otherwise(F.expr("node div 2")).alias("key"), "node").union(n.select((-F.col("node") - 2).alias("key"), "node"))
        met = {}
        for r in buckets.meetings(nodes, keys_of, 16).collect():
            met.setdefault((r.key, r.pair), []).append((r.node, r.side))
        pairs = {(a, b) for g in met.values() for a, s in g for b, t in g if a < b and (s == 2 or s != t)}
        assert pairs == {(a, b) for b in range(100) for a in range(b)} | {(a, a + 1) for a in range(100, 300, 2)}
        assert max(map(len, met.values())) < 60


def test_components_of_hubs(spark, monkeypatch):
    from tallyframe.llm import components

    monkeypatch.setattr(components, "HUB_EDGES", 5)
    links = [(0, i) for i in range(1, 40)] + [(500, i) for i in range(400, 440)] + [(39, 1000), (1000, 400)] + [(2000 + i, 2001 + i) for i in range(30)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {n: 2000 if n >= 2000 else 0 for e in links for n in e}


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(200 + i, 201 + i) for i in range(40)]
    want = closure(241, links)
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect())
    ends = {x for e in links for x in e if e[0] != e[1]}
    assert got == {x: want[x] for x in ends}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_trie():
    rng = random.Random(1)
    trie, want = exact_dedup.PatriciaTrie(), {}
    for i in range(3000):
        t = bytes(rng.choice(b"ab") for _ in range(rng.randrange(9)))
        trie.insert(t, i, i, 1)
        w = want.setdefault(t, [i, i, 0])
        w[1], w[2] = i, w[2] + 1
    assert dict(trie.items()) == want


def test_exact_dedup(odd, none, monkeypatch):
    for bound in (exact_dedup.TRIE_BYTES, 10):
        monkeypatch.setattr(exact_dedup, "TRIE_BYTES", bound)
        rows = exact_dedup.mark(odd).collect()
        got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows), key=str)
        assert len(rows) == len(ODD) and (1, 3, 4, False) in got and (3, 3, 4, True) in got and (4, 5, 3, False) in got and (None, None, 1, False) in got
    left = exact_dedup.dedup(odd, keep="smallest")
    assert left.columns == odd.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "4", "6", "7", "None"]
    assert exact_dedup.mark(none).count() == exact_dedup.dedup(none).count() == 0


def fingerprint(text, k):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_query(spark):
    docs = queries.table(spark, SF, "documents").collect()
    docs.sort(key=lambda r: r.doc_id)
    prints = [fingerprint(r.text, 3) for r in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    label = closure(len(docs), links)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash(spark, SF).collect()}
    assert got == {r.doc_id: (f"{p:016x}", docs[c].doc_id) for r, p, c in zip(docs, prints, label, strict=True)}


def test_simhash_links():
    plan = simhash.Plan(1, 2, None, 1000)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, (500, 1), dtype=np.uint64)
    b = a ^ np.array([[(1 << int(x)) | (1 << int(y))] for x, y in rng.integers(0, 64, (500, 2))], dtype=np.uint64)
    assert (plan.keys(a) == plan.keys(b)).any(1).all()
    assert simhash.fingerprint("a B  c", 3).tolist() == [fingerprint("A b c", 3)] and simhash.fingerprint(None).tolist() == [0]
    long = "x " * 100
    assert list(simhash._long_shingles(long.encode(), 3)) == list(simhash._shingles(long.encode(), 3))


def test_near_dedup(spark, odd, none):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(300)]
    near = base[:150] + ["changed"] + base[151:]
    docs = [(10, " ".join(base)), (11, " ".join(near)), (12, " ".join(word() for _ in range(300))), (13, " ".join(base[:40]))]
    left = simhash.dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [10, 12, 13]
    assert simhash.dedup(odd).columns == odd.columns and simhash.dedup(none).count() == 0
    assert len(simhash.mark(odd).collect()) == len(ODD)


def test_near_dedup_of_repeats(spark):
    rng = random.Random(8)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    base, line = words(404), words(7)
    docs = [(1, base), (2, base + ["again"] * 84), (3, words(300) + line * 200), (4, words(300) + line * 200)]
    left = simhash.dedup(spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4]


def test_near_dedup_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    docs = []
    for n in [8, 9, 10, 12, 14, 24, 44, 60, 104, 105, 120, 204, 304]:
        for similarity in (0.75, 0.77, 0.79, 0.8, 0.8, 0.8, 0.81, 0.82, 0.85):
            base, m = words(n), n - 4
            docs += [base, base[: round(m * similarity) + 4]]
            away = round(m * (1 - similarity) / (1 + similarity))  # in place of the last words, others
            docs.append(base[: n - away] + words(away))
    docs.append(words(3))
    sets = [{tuple(d[i : i + 5]) for i in range(len(d) - 4)} or {tuple(d)} for d in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = sorted(set(closure(len(docs), links)))
    rows = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    for bound in (simhash.BLOCK_SHINGLES, 300):
        monkeypatch.setattr(simhash, "BLOCK_SHINGLES", bound)
        left = sorted(r.doc_id for r in simhash.dedup(rows).collect())
        assert left == want


def test_near_dedup_on_documents(spark):
    docs = corpus_pipeline.drop_copies(spark, queries.table(spark, SF, "documents"), SF)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    words = [r.text.encode().lower().split() for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in words]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = {rows[i].doc_id for i in closure(len(rows), links)}
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).select("doc_id").collect()} == want


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 32))
    vectors = [(c + 0.22 * rng.standard_normal(32)).tolist() for c in centres for _ in range(25)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000, None), (1001, [0.0] * 32), (1002, [float("nan")] * 32), (1003, vectors[0]), (1003, vectors[0]), (1004, [None] * 32), (None, vectors[1]), (1005, [1.0, 2.0])]
    got = embeddings.mark(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    unit = {i: np.array(v, dtype=np.float32).astype(float) for i, v in enumerate(vectors)}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    pairs = [(i, j) for i in unit for j in range(i) if unit[i] @ unit[j] >= 0.9]
    found = {r.id: r for r in got if r.id is not None and r.id < 1000}
    extra = sum(2 * (unit[i] @ unit[0] >= 0.9) + (unit[i] @ unit[1] >= 0.9) for i in unit)
    linked = sum(r.n_links for r in found.values())
    assert 0.97 * (2 * len(pairs) + extra) <= linked <= 2 * len(pairs) + extra
    label = closure(len(unit), pairs)
    assert np.mean([found[i].component == label[i] for i in unit]) > 0.97
    odd = {r.id: (r.n_links, r.component, r.kept) for r in got if r.id in (1000, 1001, 1002, 1004, 1005)}
    assert odd == {i: (0, i, True) for i in odd} and len(odd) == 5 and len(got) == len(rows)
    assert embeddings.mark(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bpe(spark, odd, none):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    library, own = tokenizers.Tokenizer.from_file(path), bpe.encoder(path)
    rng = random.Random(5)
    alphabets = ["abc ", "etaoin shrdlu'st", "0123456789., ", "éèß \n\t", "漢字😀 a"]
    texts = ["", "<|endoftext|>a<|endoftext|>", "a" * 4000, "ab" * 900 + " x", *("".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(80))) for _ in range(300))]
    for text, runs in zip(texts, own.encode_many(texts), strict=True):
        ids = np.frombuffer(b"".join(runs), dtype="<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert "".join(own.decode(runs)) == library.decode(ids, skip_special_tokens=False)
    cut = [own.bytes_of.index(b"\xc3"), own.bytes_of.index(b"\xa9"), own.bytes_of.index(b"\xe2")]
    assert "".join(own.decode([np.array(cut[:1], "<u4").tobytes(), np.array(cut[1:], "<u4").tobytes()])) == library.decode(cut)
    assert own.window == 2 * own.lookahead + own.longest
    assert bpe.round_trip(odd, path).count() == len(ODD) and bpe.round_trip(none, path).count() == 0


def test_html_cut_by_name():
    text = html_text.main_text
    assert text('<body><h2 class="section-header">Head</h2><p class="social-science">Of science.</p><p class="ad">Buy</p><div class="social-links">Like</div></body>') == "Head\n\nOf science."
    assert text('<div class="content with-sidebar"><p>The real article is here.</p></div>') == "The real article is here."
    assert text("<p>a</p><!-- hidden > tail secret") == text("<p>a</p><!-- x --><p></p><? y > <a title='cut") == "a"
    assert text("<p>1 < 2 and <b title='a > b'>so</b> on</p>") == "1 < 2 and so on" and text("<p>x<![CDATA[ & y]]> z</p>") == "x z"
    assert text('<p>x</p><a "b > c" ' + '"" ' * 60).startswith("x")


def test_html(spark):
    page = '<html><body class="with-sidebar"><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class="ad">Buy</div><article><h1>Head &amp; more</h1><p>One<br>two &#233;<p>Three <a href=y>four</a></article><section id="comments"><p>me too</p></section><footer>f</footer>'
    assert html_text.main_text(page) == "Head & more\n\nOne two é\n\nThree four"
    assert [html_text.main_text(x) for x in (None, "", "plain\n text", "<p", "<script>x</script>", "<p>a<!-- b --></p><p>c")] == ["", "", "plain text", "", "", "a\n\nc"]
    rows = spark.createDataFrame([(1, None, None, "t", 1), (None, "u", page, "t", 2), (1, "u", "<p>" * 20_000 + "deep", "t", 3), (1, "u", "<p>" * 20_000 + "deep", "t", 3), (2, "v", "<b>" * 30_000 + "<p>long</p>" * 3000, "t", 4)], "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract(rows).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, 0), (None, 34), (1, 4), (1, 4), (2, 17_998)]
    assert html_text.extract(rows.limit(0)).count() == 0


def test_html_density_decides():
    story = "".join(f"<p>{'This is a sentence of the story. ' * 6}{i}</p>" for i in range(5))
    want = "Title\n\n" + "\n\n".join(" ".join(["This is a sentence of the story."] * 6 + [str(i)]) for i in range(5))
    teasers = "".join(f'<div class="t"><h3><a href=x>Teaser {i}</a></h3><p>In short.</p></div>' for i in range(4)) + "<ul>" + "<li><a href=y>A link to go to</a></li>" * 5 + "</ul>"
    assert html_text.main_text(f"<body><main><article><h1>Title</h1>{story}</article>{teasers}</main></body>") == want
    assert html_text.main_text(f"<body><div><h1>Title</h1><div>{story}</div></div><div>{teasers}</div></body>") == want
    assert html_text.main_text(f"<body><article><h1>Title</h1><div>{story}</div><div>{teasers}</div></article></body>") == want


def test_html_comments_as_browsers_read_them():
    for page in ("<!--><p>a</p>", "<!---><p>a</p>", "<!-- x --!><p>a</p>", "<!-- x -- > y --><p>a</p>", "</3 x><p>a</p>", "<?xml y?><p>a</p>", "<!DOCTYPE html><p>a", "<p>a<![CDATA[hidden]]></p>", "</><p>a"):
        assert html_text.main_text(page) == "a", page


def test_html_short_blocks_of_an_article():
    part = "This is a sentence of the story. " * 9
    said = part.strip()
    story = f"<div><p>{part}</p><p>{part}</p></div>"
    links = "<ul>" + "<li><a href=y>A link to go to</a></li>" * 5 + "</ul>"
    for box in ("article", "main", "div"):
        page = f"<body><{box}><p>Short intro.</p>{story}<h2>Notes</h2><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><p>Short close.</p>{links}</{box}><div><p>Elsewhere.</p>{links}</div></body>"
        assert html_text.main_text(page) == f"Short intro.\n\n{said}\n\n{said}\n\nNotes\n\none\n\ntwo\n\na\n\nb\n\nShort close.", box
    assert html_text.main_text(f'<body><div class="ad"><p>{part * 3}</p></div><article><p>Little.</p></article></body>') == "Little."
    twice = html_text.main_text(f"<body><div>{story}</div><div>{story}</div></body>")
    assert twice.count(said) == 4 and twice == html_text.main_text(f"<body><div>{story}</div><div>{story}</div></body>")


def test_html_density_sums_by_brute_force():
    rng = random.Random(11)

    def grow(depth):
        node = html_text.Element(rng.choice(["div", "p", "a", "span", "ul", "section", "b"]), None)
        for _ in range(rng.randrange(0, 5) if depth else rng.randrange(1, 3)):
            child = "x" * rng.randrange(0, 40) + " " if rng.random() < 0.5 or depth > 5 else grow(depth + 1)
            if not isinstance(child, str):
                child.parent = node
            node.children.append(child)
        return node

    def counts(n):
        below = [(c, counts(c)) for c in n.children if not isinstance(c, str)]
        chars = sum(len(c.strip()) for c in n.children if isinstance(c, str)) + sum(x[0] for _, x in below)
        return chars, sum(x[1] + 1 for _, x in below), sum(x[0] if c.name == "a" else x[2] for c, x in below), sum(x[3] + (c.name == "a") for c, x in below)

    for _ in range(60):
        root = grow(0)
        whole = counts(root)
        density = lambda n: html_text.composite_density(*counts(n), whole[0], whole[2])

        def total(n):
            return sum(density(c) for c in n.children if not isinstance(c, str) and (c.name in html_text.BLOCKS or total(c) > 0))

        for n in html_text.measure(root):
            assert (n.chars, n.tags, n.link_chars, n.link_tags) == counts(n) and abs(n.total - total(n)) < 1e-9 and abs(n.density - density(n)) < 1e-9


def test_html_layout_classes():
    story = "".join(f"<p>{'This is a sentence of the story. ' * 6}{i}</p>" for i in range(5))
    want = "\n\n".join(" ".join(["This is a sentence of the story."] * 6 + [str(i)]) for i in range(5))
    for name in ("wrapper has-sidebar", "no-sidebar", "with-header", "sidebar-right", "widget"):
        assert html_text.main_text(f'<body><div class="{name}"><div class="content">{story}</div></div><div class="sidebar">Aside</div></body>') == want, name
        assert html_text.main_text(f'<body><article><div class="{name}">{story}</div></article><div class="ad">{story * 2}</div></body>') == want, name
    part = "<p>" + "One more sentence of it. " * 8 + "</p>"
    text = html_text.main_text(f'<body><div>{story}<div class="entry-share-story">{part}</div><div class="share-links">Share this</div></div><div id="comments"><p>me too</p></div></body>')
    assert text == want + "\n\n" + " ".join(["One more sentence of it."] * 8)


def test_warc(spark):
    rows = [(3, "http://b.example.com/x?q=1", "<p>same</p>"), (1, "https://a.example.com:8443/", "<p>same</p>"), (2, None, None), (5, "not a url", ""), (None, "http://b.example.com/y", "<p>same</p>"), (7, "http://b.example.com/x?q=1", "ü" * 70_000), (7, "http://[bad", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    root = warc.scratch_path(spark, "test-warc")
    directory = warc.write(pages, root, block_lines=2)
    assert directory.count() > 2
    got = {(r.id, r.url): r for r in warc.fetch(warc.locate(directory, root, pages), root, True).collect()}
    assert len(got) == len(rows)
    assert got[3, rows[0][1]].refers_to == 1 and got[3, rows[0][1]].record_type == "revisit" and got[3, rows[0][1]].payload_bytes == 11
    assert got[1, rows[1][1]].record_type == "response" and got[5, "not a url"].refers_to == 2 and got[None, rows[4][1]].refers_to == 1
    assert got[7, rows[5][1]].payload.decode() == "ü" * 70_000
    asked = spark.createDataFrame([("http://B.example.com:80/x?q=1",), ("http://b.example.com/none",)], "url string")
    found = warc.lookup(directory, root, asked).collect()
    assert sorted(r.id for r in found) == [3, 7] and max(len(r.payload) for r in found) == 140_000
    assert warc.surt("http://a.example.com:80/x?q") == "com,example,a)/x?q"
    reader = warc.Reader(root)
    name = warc.locate(directory, root, asked).first().file
    assert gzip.decompress(reader.fs.open_input_file(f"{reader.base}/{name}").read()).startswith(b"WARC/1.1")
    again = spark.createDataFrame([(i % 5, "http://one.example.com/", "same", "x") for i in range(500)] + [(9, None, None, None)] * 3, "page_id long, url string, html string, key string")
    back = warc.round_trip(again).groupBy("id", "record_type", "refers_to").count().collect()
    assert {(r.id, r.record_type, r.refers_to, r["count"]) for r in back} == {(0, "response", None, 100), *((i, "revisit", 0, 100) for i in range(1, 5)), (9, "response", None, 3)}
    plain = warc.round_trip(pages, min_bytes=100)
    assert {r.record_type for r in plain.collect()} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    d = SF.replace("0.001", "0.01")
    docs, labels = queries.table(spark, d, "documents").toPandas(), queries.table(spark, d, "labels").toPandas()
    return docs.merge(labels, on="doc_id")


def test_toxicity(labelled, spark, odd, none):
    rows = list(zip(labelled.text, labelled.toxic, strict=True))
    model = toxicity.fit(rows[:300])
    scores = model.score(model.margin([t for t, _ in rows[300:]], WordMemo(model.words)))
    truth = np.array([y for _, y in rows[300:]])
    assert scores[truth == 1].mean() > 4 * scores[truth == 0].mean() and ((scores >= 0.3) & (truth == 0)).mean() < 0.05
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.reject(odd, model).columns == odd.columns and toxicity.score(none, model).count() == 0
    for few in ([], [("a", 1)]):
        model = toxicity.fit(few)
        assert 0 < model.score(model.margin(["", "x"], WordMemo(model.words)))[0] < 1


def test_quality(labelled, odd, none):
    rows = list(zip(labelled.text, labelled.quality, strict=True))
    model = quality.fit(rows[:300])
    scores = model.score([t for t, _ in rows[300:]], WordMemo(model.words))
    truth = np.array([y for _, y in rows[300:]])
    assert ((scores >= 0.7) == (truth == 1)).mean() > 0.9
    assert quality.score(odd, model).count() == len(ODD) and quality.score(none, model).count() == 0
    assert quality.fit([]).score([""], WordMemo(quality.fit([]).words)).tolist() == [0.5]


def test_language(labelled, spark, odd, none):
    rows = list(zip(labelled.text, labelled.lang, strict=True))
    model = langid.fit(rows[:250])
    memo = WordMemo(model.words)
    guess = [model.languages[i] for i in model.entropies([t for t, _ in rows[250:]], memo).argmin(1)]
    assert np.mean([g == lang for g, (_, lang) in zip(guess, rows[250:], strict=True)]) > 0.97
    for m in model.models:  # probabilities after a known context add up to one
        codes = [ord(c) for c in "    e"]
        text = np.array([[*codes[:4], x] for x in range(1, 0x250)], dtype=np.uint64).ravel()
        every = [langid.gram_hashes(text, k) for k in range(1, 6)]
        at = np.arange(4, len(text), 5)
        p = np.exp(m.log_probability([h[at] for h in every], [np.zeros(len(at), dtype=np.uint64)] + [every[k - 1][at - 1] for k in range(1, 5)]))
        seen = np.isin([h for h in every[0][at]], m.grams[0])
        assert 0.9 < p[seen].sum() < 1.001
    got = {r.id: r for r in langid.identify(odd, model).collect() if r.id is not None}
    assert got[1].lang_pred == got[2].lang_pred == got[7].lang_pred == "und" and got[7].score == 0
    assert langid.identify(odd, langid.fit([])).count() == len(ODD) and langid.identify(none, model).count() == 0


def kneser_ney(words, alphabet):
    """Brute force: log-probability of a character after a context, from dictionaries of counts."""
    padded = [" " * 4 + w + " " for w in words]
    grams = [dict() for _ in range(6)]
    for w in padded:
        for i in range(4, len(w)):
            grams[5][w[i - 4 : i + 1]] = grams[5].get(w[i - 4 : i + 1], 0) + 1
    for k in range(4, 0, -1):
        seen = {w[i - k : i + 1] for w in padded for i in range(4, len(w))}
        for g in seen:
            grams[k][g[1:]] = grams[k].get(g[1:], 0) + 1

    def p(text, k):
        if k == 0:
            return 1 / alphabet
        inside = [c for g, c in grams[k].items() if g[:-1] == text[:-1]]
        if not inside:
            return p(text[1:], k - 1)
        return max(grams[k].get(text, 0) - 0.75, 0) / sum(inside) + 0.75 * len(inside) / sum(inside) * p(text[1:], k - 1)

    return lambda word: sum(np.log(p(t[i - 4 : i + 1], 5)) for t in [" " * 4 + word + " "] for i in range(4, len(t)))


def test_language_brute_force(monkeypatch):
    words = ["the", "then", "hen", "other", "tenth", "one", "the", "thenonether" * 3]
    model = langid.fit([(" ".join(words), "x"), ("zwei drei vier", "y")])
    alphabet = len(set("".join(words) + "zweidreivier")) + 2
    want = kneser_ney(words, alphabet)
    for bound in (1000, 7, 1):  # parts of long words change nothing
        monkeypatch.setattr(langid, "LONG_WORD", bound)
        fitted = langid.fit([(" ".join(words), "x"), ("zwei drei vier", "y")])
        for w in ("the", "hthe", "nether", "q", "onethenonether"):
            assert abs(fitted.words([w])[0][0] - want(w)) < 1e-6 and abs(model.words([w])[0][0] - want(w)) < 1e-6, (bound, w)


def test_toxicity_ratios_and_margins_by_dictionaries():
    rng = random.Random(12)
    nice, rude = ["good", "Morning", "tea", "é", "a1"], ["awful", "GRUMP", "tea", "nasty"]
    rows = [(" ".join(rng.choices(rude if (i % 2 == 0) != (i % 11 == 3) else nice, k=rng.randrange(4, 9))), int(i % 2 == 0)) for i in range(49)]
    bucket_of = {}

    def grams(text):
        found = set()
        for w in text.lower().split():
            for n in toxicity.ORDERS:
                for g in {f" {w} "[i : i + n] for i in range(len(w) + 3 - n)}:
                    if g not in bucket_of:
                        codes = np.array([ord(c) for c in g], dtype=np.uint64)
                        bucket_of[g] = int(gram_hashes(codes, n)[-1] >> np.uint64(40)) % toxicity.BUCKETS
                    found.add(bucket_of[g])
        return found

    held = [(grams(t), y) for t, y in rows]
    n = [sum(y == c for _, y in rows) for c in (0, 1)]
    ratio = {}
    for b in set().union(*(h for h, _ in held)):
        df = [sum(b in h for h, y in held if y == c) for c in (0, 1)]
        r = np.log((df[1] + 0.5) / (n[1] + 1)) - np.log((df[0] + 0.5) / (n[0] + 1))
        if abs(r) / np.sqrt(1 / (df[1] + 0.5) + 1 / (df[0] + 0.5)) > toxicity.SIGNIFICANCE:
            ratio[b] = r
    model = toxicity.fit(rows)
    assert ratio and model.buckets.tolist() == sorted(ratio) and np.allclose(model.ratios, [ratio[b] for b in sorted(ratio)], atol=1e-5)
    place = {b: i for i, b in enumerate(model.buckets.tolist())}
    asked = [t for t, _ in rows] + ["", "Nasty tea " * 3, "grump/awful good"]
    want = [model.bias + sum(model.weights[place[b]] for b in grams(t) if b in place) for t in asked]
    assert np.allclose(model.margin(asked, WordMemo(model.words)), want)


def test_quality_pools_by_loops():
    rng = random.Random(4)
    words = ["plain", "Words", "UPPER", "a,b", "x1", "...", "(it)", "…", "über", "42", "don't", "wOrd"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 30))) for _ in range(80)]
    model = quality.fit([(t, i % 2) for i, t in enumerate(texts)])
    asked = [*texts, "", "plain plain plain", "never_seen 日本"]
    got = model.pooled(asked, WordMemo(model.words))
    for text, row in zip(asked, got, strict=True):
        total, n, last = np.zeros(quality.DIM), 0, None
        for w in text.split():
            for u in ([quality.REPEAT] if w == last else []) + quality.units(w):
                if u in model.places:
                    total, n = total + model.vectors[model.places[u]], n + 1
            last = w
        assert np.allclose(row, total / max(n, 1), atol=1e-5)
    mean, spread, w1, b1, w2, b2 = model.layers
    hidden = np.tanh(((got[3] - mean) / spread) @ w1 + b1)
    assert abs(model.score([asked[3]], WordMemo(model.words))[0] - 1 / (1 + np.exp(-(hidden @ w2 + b2[0]) / model.temperature))) < 1e-6


def test_language_of_long_words(spark):
    model = langid.fit([("a" * 2000 + "bcd" * 800, "x"), ("a" * 2000 + "efg" * 800, "y")])
    assert model.entropies(["bcdbcd", "efgefg"], WordMemo(model.words)).argmin(1).tolist() == [0, 1]
    rows = [(4 * i, "plain words of the first language", "many") for i in range(400)] + [(3, "zzyzx qqq", "rare")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=20)
    assert model.languages == ["many", "rare"]


def raked(cells, targets, budget, rounds=400):
    """Brute force: plain raking of a list of cells (source, language, topic, tokens), then c by halving."""
    share = [float(c[3]) for c in cells]
    for _ in range(rounds):
        for d, dim in enumerate(("source", "lang", "topic")):
            have = {}
            for c, s in zip(cells, share):
                have[c[d]] = have.get(c[d], 0.0) + s
            share = [s * targets[dim].get(c[d], 0.0) / have[c[d]] if have[c[d]] else 0.0 for c, s in zip(cells, share)]
    low, high = 0.0, 1e12
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if sum(min(x[3], c * s) for x, s in zip(cells, share)) < budget * sum(x[3] for x in cells) else (low, c)
    return {x[:3]: min(1.0, high * s / x[3]) for x, s in zip(cells, share)}


def test_mixing(spark, odd, none, monkeypatch):
    rng = random.Random(6)
    docs = [(i, " ".join(f"word{rng.randrange(9)}x" for _ in range(rng.randrange(1, 60))), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", None, "␀"]), rng.choice("xyz"), "mine") for i in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, subject string, mix_kept string")
    targets = {"source": {"a": 0.3, "b": 0.3, None: 0.2, "␀": 0.2}, "lang": {"en": 0.4, "de": 0.4, None: 0.2}, "topic": {"x": 0.5, "y": 0.25, "z": 0.25}}
    rows = mixing.mark(df, topic_col="subject", targets=targets, budget=0.3).collect()
    cells = {}
    for r in rows:
        cells[r.mix_source, r.mix_lang, r.mix_topic] = cells.get((r.mix_source, r.mix_lang, r.mix_topic), 0) + r.mix_tokens
    want = raked([(*k, v) for k, v in cells.items()], targets, 0.3)
    assert max(abs(r.mix_probability - want[r.mix_source, r.mix_lang, r.mix_topic]) for r in rows) < 1e-4
    total = sum(r.mix_tokens for r in rows)
    assert abs(sum(r.mix_tokens for r in rows if r.mix_kept) / total - 0.3) < 0.05
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)  # the other join, the same rows
    assert {(r.doc_id, r.mix_kept) for r in mixing.mark(df, topic_col="subject", targets=targets, budget=0.3, carry=["doc_id"]).collect()} == {(r.doc_id, r.mix_kept) for r in rows}
    kept = mixing.mix(df, topic_col="subject", targets=targets, budget=0.3)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.mix_kept}
    got = mixing.mark(odd).collect()
    assert len(got) == len(ODD) and mixing.mix(odd).columns == odd.columns and mixing.mix(none).count() == mixing.mark(none).count() == 0
    assert {(r.doc_id, r.mix_tokens) for r in got if r.doc_id} == {(1, 0), (2, 0), (3, 0), (4, 3), (5, 3), (6, 30_000), (7, 3)}
    assert len({r.mix_kept for r in got if r.doc_id == 4}) == 1 and all(r.mix_kept for r in got if r.mix_source is None)


def test_mixing_tokens_and_topics():
    texts = ["It's 12345 words…", "漢字かな mixed text", "", None, "état\n\nnouveau ---"]
    plain = mixing.Topics({}, 0)
    assert plain.of([t or "" for t in texts], WordMemo(plain.words)) == (["none"] * 5, [7, 6, 0, 0, 3])
    rng = random.Random(2)
    subjects = [[f"{a}{i}" for i in range(40)] for a in ("apple", "stone", "river")]
    docs = [" ".join(rng.choice(subjects[k % 3]) for _ in range(30)) for k in range(300)]
    model = mixing.fit_topics(docs, n=3)
    said = model.of(docs, WordMemo(model.words))[0]
    assert all(len({said[k] for k in range(s, 300, 3)}) == 1 for s in range(3)) and len(set(said)) == 3
    assert model.of(["", "nothing known"], WordMemo(model.words))[0] == ["none", "none"]
    assert mixing.terms("(stone3)") == ["stone3"] and mixing.terms("漢字か") == ["漢字", "字か"]


def test_pipeline(spark):
    docs = queries.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        before, after = {r.doc_id for r in docs.select("doc_id").collect()}, [r.doc_id for r in kept.select("doc_id").collect()]
        assert set(after) <= before and len(after) == len(set(after))
        if name == "exact_dedup":
            texts = {}
            for r in docs.collect():
                texts[r.text] = min(r.doc_id, texts.get(r.text, r.doc_id))
            assert set(after) == set(texts.values())
        docs = kept
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert out.join(queries.table(spark, SF, "documents"), "doc_id").where(F.sha2("text", 256) != F.col("decoded_sha256")).count() == 0


def test_mixing_topics_of_all_documents(spark):
    """Topics are learnt from every document, whatever the tasks: the same as from all texts at once."""
    rng = random.Random(5)
    subjects = [[f"{a}{i}" for i in range(40)] for a in ("apple", "stone", "river")]
    docs = [" ".join(rng.choice(subjects[k % 3]) for _ in range(12)) for k in range(3000)] + ["rareword alone here"] * 3 + ["漢字 漢字か", "", None]
    rows = spark.createDataFrame([(t,) for t in docs], "text string").repartition(7)
    whole = mixing.fit_topics([t for t in docs if t is not None], n=3)
    found = mixing.train_topics(rows, n=3)
    assert "rareword" in found.scores and list(found.scores) == list(whole.scores)
    assert np.array_equal(found.matrix, whole.matrix)
    assert mixing.train_topics(rows.where("false")).scores == {}
    told, codes, known = mixing._told(["(stone3) ab 漢字か", "état ÉTAT! stone3"])
    assert sorted(zip(told.tolist(), known.take(codes).to_pylist())) == [(0, "stone3"), (0, "字か"), (0, "漢字"), (1, "stone3"), (1, "état"), (1, "état")]


def test_mixing_vectors_are_rows_of_documents(spark, monkeypatch):
    """Topics are learnt from tables with a small row a document, so that no batch of rows grows with the input."""
    rng = random.Random(7)
    docs = [(i, " ".join(rng.sample([f"word{k}" for k in range(90)], 25)), "en", "a") for i in range(2000)]
    seen, write = {}, mixing.materialise
    monkeypatch.setattr(mixing, "materialise", lambda df, name: (seen.setdefault(name, write(df, name)[0]), ""))
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1)
    assert mixing.mark(rows, carry=["doc_id"]).where("mix_topic <> 'none'").count() == 2000
    mixing.train_topics(rows)
    assert seen["measured"].count() == seen["vectors"].count() == 2000 and "blocks" not in seen
    for name in ("measured", "vectors", "terms"):
        for c, kind in seen[name].dtypes:
            assert not kind.startswith("array")
            if kind == "binary":
                assert seen[name].agg(F.max(F.length(c))).first()[0] <= 4 * 25
