"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, embeddings, exact_dedup, html_text, langid, lexical, mixing, packing, quality, simhash, toxicity, warc
from .common import held_out

#: The vocabulary file of op10: a parameter, the same on every machine.
VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def _judged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _judged(toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))), toxicity.THRESHOLD)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mixing.mark(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return marked.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"), F.col("mix_probability").alias("probability"), F.col("mix_kept").alias("kept"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = simhash.mark(table(spark, sf_dir, "documents"), shingle=3, words=1, max_distance=2)
    digits = F.hex("fp")
    big_endian = F.lower(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(8))]))
    return marked.select(F.col("id").alias("doc_id"), big_endian.alias("fingerprint"), F.col("component").alias("component_id"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup.mark(table(spark, sf_dir, "documents").select("doc_id", "text"), keep="largest")
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _judged(quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"))), quality.THRESHOLD)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = embeddings.mark(table(spark, sf_dir, "embeddings"), threshold=0.9)
    return marked.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())
    return done.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary_path(), limits=packing.Limits(tokens=1024, segments=64, loss=1024), end_id=0)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", F.col("n_tokens").alias("doc_tokens"), "sequence_id", "offset")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=30, told=50)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=50)


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_warc": op2_warc,
    "op3_language": op3_language,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_simhash": op6_simhash,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality": op8_quality,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_bpe": op10_bpe,
    "op11_packing": op11_packing,
    "op12_divergence": op12_divergence,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE = {
    "op2_warc": """
        WITH payload AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
                   min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
            FROM pages
        ), five AS (
            SELECT page_id, payload_bytes, first_id,
                   list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS parts
            FROM payload
        )
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(parts, lambda n: array_to_string(list_transform([15, 10, 5, 0], lambda s:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((n >> s) & 31) + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
               CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first_id THEN first_id END AS refers_to
        FROM five
    """,
    "op7_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
    "op9_embedding_dedup": """
        WITH RECURSIVE unit AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        ), link AS (
            SELECT a.vec_id AS u, b.vec_id AS w FROM unit a JOIN unit b ON a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.v, b.v) >= 0.9
        ), reach(u, w) AS (
            SELECT vec_id, vec_id FROM unit
            UNION
            SELECT r.u, l.w FROM reach r JOIN link l ON r.w = l.u
        ), component AS (
            SELECT u, min(w) AS least FROM reach GROUP BY u
        ), degree AS (
            SELECT u, count(*) AS n FROM link GROUP BY u
        )
        SELECT unit.vec_id, coalesce(degree.n, 0) AS n_links, component.least AS component_id, unit.vec_id = component.least AS kept
        FROM unit JOIN component ON component.u = unit.vec_id LEFT JOIN degree ON degree.u = unit.vec_id
    """,
    "op12_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), hit AS (
            SELECT r, lang, source, unnest(terms) AS term FROM d
        ), word AS (
            SELECT lang, term, count(*) AS total FROM hit GROUP BY lang, term HAVING count(DISTINCT r) >= 30
        ), n AS (
            SELECT lang, source, term, count(*) AS n FROM hit SEMI JOIN word USING (lang, term) GROUP BY ALL
        ), g AS (
            SELECT lang, source, coalesce(own.n, 0) AS n, coalesce(v.v, 0) AS v, coalesce(v.n, 0) AS lang_n
            FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY ALL) own USING (lang, source)
                 LEFT JOIN (SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS n FROM word GROUP BY lang) v USING (lang)
        ), p AS (
            SELECT g.lang, g.source, word.term, coalesce(n.n, 0) AS n, 1 + (1000000000 * (coalesce(n.n, 0) + 5)) // (g.n + 5 * g.v) AS p, 1 + (1000000000 * (word.total + 5)) // (g.lang_n + 5 * g.v) AS q
            FROM g JOIN word USING (lang) LEFT JOIN n USING (lang, source, term)
        ), pair AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), every AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
            UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q
        )
        SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM every QUALIFY part = 'pair' OR rank <= 50
    """,
    "op13_lexical_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), size AS (
            SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0
        ), whole AS (
            SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS l FROM size
        ), asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), hit AS (
            SELECT r, unnest(terms) AS term FROM d
        ), tf AS (
            SELECT r, term, count(*) AS tf FROM hit SEMI JOIN asked USING (term) GROUP BY r, term
        ), w AS (
            SELECT term, CAST(floor(1000 * ln((2 * (SELECT n FROM whole) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf GROUP BY term
        ), score AS (
            SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * size.n * whole.n) // whole.l)))) AS BIGINT) AS score
            FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN size USING (r), whole GROUP BY ALL
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM score WHERE score > 0 QUALIFY rank <= 50
    """,
}
