"""Best match by TF-IDF cosine, relationally and with bounds: what cannot win is never scored.

idf = ln((1 + n) / (1 + df)) + 1 over the corpus of a block; terms outside it carry no weight; of equal similarities the first
of the corpus wins.

The postings of a term know its largest weight. A query's terms are taken rarest first: a text that it first meets at some
term scores at most the sum of (own weight x largest weight) from there on, and at most the length of that rest of the query's
unit vector. First each query meets the postings of its rarest terms; the best of these sets its bar. Then only terms from
which the bar can still be reached are joined, and of the pairs that meet only those whose share so far, with the bound of the
rest, reaches it are scored in full.

A corpus of few postings goes to every task instead: queries are dealt once by their terms in it, and all their pairs are summed,
and the best taken, by the task that has the query. Long texts share terms with most of such a corpus, so bounds would save little.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.scratch import written

#: Rarest terms of a query by which its bar is set.
PROBES = 2
#: Below this a difference of similarities is one of rounding.
SLACK = 1e-7
#: Postings of a corpus that every task may hold (about 100 bytes each), and pairs that a task is meant to sum at a time.
FEW_POSTINGS, TASK_PAIRS = 50_000, 500_000


def _terms(df: DataFrame, text: str) -> DataFrame:
    return df.select("block", "id", F.explode(tokens(F.col(text))).alias("term")).groupBy("block", "id", "term").agg(F.count("*").alias("tf"))


def weights(corpus: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``block, term, idf, df`` and ``block, id, term, w`` (unit vectors) of a corpus ``block, id, text``."""
    size = corpus.groupBy("block").agg(F.count("*").alias("n"))
    terms = written(_terms(corpus, text))
    idf = terms.groupBy("block", "term").agg(F.count("*").alias("df")).join(size, "block").select("block", "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"), "df")
    return idf, _unit(terms.join(idf.drop("df"), ["block", "term"])).select("block", "id", "term", "w")


def _unit(weighed: DataFrame) -> DataFrame:
    raw = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(raw * raw).over(Window.partitionBy("block", "id")))
    return weighed.withColumn("w", raw / norm).drop("tf", "idf")


def _tables(queries: DataFrame, idf: DataFrame, right: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """The terms of queries, rarest first, with what they and those after them can add at most; the postings of the corpus."""
    known = written(idf.join(right.groupBy("block", "term").agg(F.max("w").alias("most")), ["block", "term"]))
    left = _unit(_terms(queries, text).join(known, ["block", "term"]))
    order = Window.partitionBy("block", "id").orderBy("df", "term")
    after = order.rowsBetween(1, Window.unboundedFollowing)
    rest = lambda x: F.coalesce(F.sum(x).over(after), F.lit(0.0))
    left = left.withColumn("place", F.row_number().over(order)).withColumn("rest", F.least(rest(F.col("w") * F.col("most")), F.sqrt(rest(F.col("w") * F.col("w")))))
    return written(left.withColumnRenamed("id", "left_id").withColumnRenamed("w", "wl")), right.withColumnRenamed("id", "right_id").withColumnRenamed("w", "wr")


def _scored(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``block, left_id, right_id, similarity`` (0 to 1) of pairs, over all their terms."""
    own = pairs.join(right, ["block", "right_id"]).join(left.select("block", "left_id", "term", "wl"), ["block", "left_id", "term"])
    return own.groupBy("block", "left_id", "right_id").agg(F.sum(F.col("wl") * F.col("wr")).alias("similarity"))


def _first(found: DataFrame) -> DataFrame:
    """Of each query the pair with the highest similarity, of equals (to nine places of the percentage) that with the smallest id."""
    key = F.struct((-F.round(F.col("similarity") * 100, 9)).alias("s"), "right_id", "similarity")
    return found.groupBy("block", "left_id").agg(F.min(key).alias("best")).select("block", "left_id", "best.right_id", "best.similarity")


def _dealt_best(queries: DataFrame, idf: DataFrame, right: DataFrame, text: str) -> DataFrame:
    """:func:`_first` of every query against a corpus that every task holds; only the queries' terms that the corpus has are shuffled."""
    spark, size = queries.sparkSession, right.select("block", "id").distinct().count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(queries.count() * size / TASK_PAIRS))
    said = queries.select("block", "id", F.explode(tokens(F.col(text))).alias("term")).join(F.broadcast(idf.drop("df")), ["block", "term"])
    left = _unit(said.repartition(tasks, "block", "id").groupBy("block", "id", "term").agg(F.count("*").alias("tf"), F.first("idf").alias("idf")))
    own = left.select("block", F.col("id").alias("left_id"), "term", F.col("w").alias("wl"))
    postings = right.select("block", "term", F.col("id").alias("right_id"), F.col("w").alias("wr"))
    return _first(own.join(F.broadcast(postings), ["block", "term"]).groupBy("block", "left_id", "right_id").agg(F.sum(F.col("wl") * F.col("wr")).alias("similarity")))


def best_matches(queries: DataFrame, corpus: DataFrame, text: str = "text", least: float = 0.0, few: int = FEW_POSTINGS) -> DataFrame:
    """``block, left_id, right_id, similarity`` (0 to 100): of each query the corpus text with the highest similarity; of equals (to nine places) that with the smallest id.

    Matches below ``least`` may be left out. Queries that share no term with their corpus have none. A corpus of ``few`` postings at most is held by every task.
    """
    idf, right = weights(corpus, text)
    right = written(right)
    if right.count() <= few:
        return _dealt_best(queries, idf, right, text).withColumn("similarity", F.col("similarity") * 100)
    left, right = _tables(queries, idf, right, text)
    meet = lambda terms: terms.join(right, ["block", "term"])
    probed = meet(left.where(F.col("place") <= PROBES).select("block", "left_id", "term")).select("block", "left_id", "right_id").distinct()
    bars = written(_first(_scored(probed, left, right)))
    bar = F.greatest(F.coalesce("similarity", F.lit(0.0)), F.lit(least / 100)) - SLACK
    reach = F.col("rest") + F.col("wl") * F.col("most")
    ahead = left.join(bars.select("block", "left_id", "similarity"), ["block", "left_id"], "left").withColumn("bar", bar).where(reach >= F.col("bar"))
    rest_after: Column = F.min(F.struct(F.col("rest"))).alias("last")
    last = ahead.groupBy("block", "left_id").agg(rest_after).select("block", "left_id", F.col("last.rest").alias("unseen"))
    shares = meet(ahead.select("block", "left_id", "term", "wl", "bar")).groupBy("block", "left_id", "right_id").agg(F.sum(F.col("wl") * F.col("wr")).alias("share"), F.first("bar").alias("bar"))
    hopeful = shares.join(last, ["block", "left_id"]).where(F.col("share") + F.col("unseen") >= F.col("bar")).select("block", "left_id", "right_id")
    whole = _scored(hopeful, left, right).unionByName(bars)
    return _first(whole).withColumn("similarity", F.col("similarity") * 100)
