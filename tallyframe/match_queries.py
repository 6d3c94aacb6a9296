"""Registered queries of candidates and assignment with several strategies, and of value sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .config import EngineConfig
from .operators import matching
from .operators import profile as profiles
from .operators.assign import assign_groups
from .operators.bands import mean_pairs
from .plans.reconcile import reconcile
from .queries import _BALANCES, _balances, _block_query, _near_balances, query, table

STRATEGIES = {
    "fields": [{"name": "name", "role": "key"}, {"name": "price", "dtype": "money"}],
    "matching": {"fuzzy_enabled": True, "semantic_enabled": True, "numeric_enabled": True, "fuzzy_threshold": 80, "semantic_threshold": 50, "accept_threshold": 0.75},
}


@query(oracles.match_strategies(STRATEGIES["matching"], EngineConfig.from_dict(STRATEGIES).matching))
def match_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Part names and the same names reversed with mean prices, by fuzzy keys, TF-IDF and near prices together: every accepted pair."""
    prices = table(spark, d, "part").where("p_name is not null").groupBy("p_name").agg(F.avg(F.col("p_retailprice").cast("decimal(28,2)")).cast("decimal(28,6)").alias("price"))
    flipped = F.array_join(F.reverse(F.split("p_name", " ")), " ")
    side = lambda key: prices.select(key.alias("key"), F.struct(key.alias("key")).alias("ord"), key.alias("name"), F.when(F.length("p_name") % 5 != 0, F.col("price")).alias("price"))
    found = matching.candidates(side(F.col("p_name")), side(flipped), EngineConfig.from_dict(STRATEGIES))
    return found.select("left_key", "right_key", F.round("confidence", 3).alias("confidence"), "match_type", F.size("strategy_scores").cast("long").alias("n_scores"))


@query(f"WITH {_BALANCES.replace('USING (n)', 'ON true').replace('l, r, n, round', 'l, r, c.n, round')} SELECT l AS left_key, r AS right_key, confidence FROM p WHERE confidence >= 0.995")
def band_join(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers of near balances, not blocked by anything."""
    return _block_query(spark, d, 0.995).select("left_key", "right_key", "confidence")


@query(f"""
    WITH RECURSIVE {_BALANCES}, ranked AS (SELECT row_number() OVER (ORDER BY confidence DESC, l, r) AS k, l, r FROM p WHERE confidence >= 0.95), {oracles.taken("ranked")}
    SELECT l AS left_key, r AS right_key FROM taken
""")
def assign_near(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one links of customers and suppliers of a nation by nearness of their balances, those of equal balances as one."""
    near = lambda left, right, least: _near_balances(left, right, 0.95 if least is None else least, blocking_field="nation")
    return assign_groups(*_balances(spark, d), ["nation", "balance"], near)


_CELLS = {"c_custkey": "CAST(CAST(c_custkey AS BIGINT) AS VARCHAR)", "c_name": "lower(trim(c_name))", "c_nationkey": "CAST(CAST(c_nationkey AS BIGINT) AS VARCHAR)", "c_mktsegment": "lower(trim(c_mktsegment))"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, CAST(count(DISTINCT {e}) AS BIGINT) AS n_values, min({e}) AS least, max({e}) AS greatest, string_agg(CASE WHEN k <= 5 THEN CAST({c} AS VARCHAR) END, '|' ORDER BY k) AS sample FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS k FROM customer WHERE {c} IS NOT NULL AND trim(CAST({c} AS VARCHAR)) <> '') WHERE k <= 2000" for c, e in _CELLS.items()))
def value_sets(spark: SparkSession, d: str) -> DataFrame:
    """Value sets and samples of the columns of the customers, from one scan (first 2,000 filled cells of each, the feature)."""
    found = profiles.value_sets(table(spark, d, "customer").select(F.col("c_custkey").alias("ord"), *_CELLS), ["ord"])
    return found.select("name", F.size("value_set").cast("long").alias("n_values"), F.array_min("value_set").alias("least"), F.array_max("value_set").alias("greatest"), F.array_join("sample", "|").alias("sample"))


@query("""
    WITH v AS (SELECT c_custkey AS l, CAST(c_acctbal AS DOUBLE) AS a, CAST(c_nationkey AS DOUBLE) AS b FROM customer), w AS (SELECT s_suppkey AS r, CAST(s_acctbal AS DOUBLE) AS c, CAST(s_nationkey AS DOUBLE) AS d FROM supplier)
    SELECT l, r, round((greatest(0.0, 1 - abs(a - c) / greatest(abs(a), abs(c), 1.0)) + greatest(0.0, 1 - abs(b - d) / greatest(abs(b), abs(d), 1.0))) / 2, 6) AS proximity FROM v JOIN w
    ON (greatest(0.0, 1 - abs(a - c) / greatest(abs(a), abs(c), 1.0)) + greatest(0.0, 1 - abs(b - d) / greatest(abs(b), abs(d), 1.0))) / 2 >= 0.98
""")
def band_join_fields(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers that are near in the mean of balance and nation number."""
    c = table(spark, d, "customer").select(F.lit("").alias("block"), F.col("c_custkey").alias("left_key"), F.col("c_acctbal").alias("a"), F.col("c_nationkey").alias("b"))
    s = table(spark, d, "supplier").select(F.lit("").alias("block"), F.col("s_suppkey").alias("right_key"), F.col("s_acctbal").alias("c"), F.col("s_nationkey").alias("d"))
    pairs = mean_pairs(c, s, [("a", "c"), ("b", "d")], 0.98)
    return pairs.where("proximity >= 0.98").select(F.col("left_key").alias("l"), F.col("right_key").alias("r"), F.round("proximity", 6).alias("proximity"))


_PAIRED_TEXTS = f"""
    p AS (SELECT c_custkey AS k, lower(any_value(c_name) || ' ' || any_value(c_mktsegment)) AS a FROM customer GROUP BY 1), s AS (SELECT s_suppkey AS k, lower('Machinery ' || any_value(s_name)) AS b FROM supplier GROUP BY 1),
    texts AS (SELECT p.k, a, b, {oracles._SORTED.format(c="a")} AS x, {oracles._SORTED.format(c="b")} AS y FROM p JOIN s USING (k))
"""


@query(f"""
    WITH RECURSIVE {_PAIRED_TEXTS}, {oracles.lcs("texts")}
    SELECT CAST(k AS VARCHAR) AS key, a = b OR 200 * n / (length(x) + length(y)) >= 55 AS ok FROM texts JOIN lcs USING (x, y)
""")
def compare_text_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Texts of customers against those of suppliers with the same number: the words in any order, 55 percent alike."""
    cfg = {"fields": [{"name": "k", "role": "key", "left_source": "c_custkey", "right_source": "s_suppkey"}, {"name": "t", "left_source": "a", "right_source": "b", "agg": "first", "text_fuzzy_threshold": 55}], "matching": {"fuzzy_enabled": False}}
    left = table(spark, d, "customer").withColumn("a", F.concat_ws(" ", "c_name", "c_mktsegment"))
    right = table(spark, d, "supplier").withColumn("b", F.concat(F.lit("Machinery "), F.col("s_name")))
    return reconcile(left, right, cfg, ["c_custkey"], ["s_suppkey"]).matches.select(F.col("left_key").alias("key"), F.col("t__ok").alias("ok"))
