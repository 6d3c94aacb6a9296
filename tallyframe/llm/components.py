"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialise

#: A node with more than ends / HUBS edges, and at least HUB_EDGES, is a hub. All nodes have twice as many edges as
#: there are edges, so hubs are HUBS at most: their least neighbours are broadcast, and no task gets a hub's edges.
HUBS, HUB_EDGES = 10_000, 64


def _with_least(edges: DataFrame, least: DataFrame, bar: int) -> DataFrame:
    """``u, v, m``: each edge with the least node around ``u``."""
    hubs = F.broadcast(least.where(F.col("n") > bar).select("u", "m"))
    rest = least.where(F.col("n") <= bar).select("u", "m")
    of_hubs = edges.join(hubs, "u")
    others = edges.join(hubs.select("u"), "u", "left_anti").join(rest, "u")
    return of_hubs.select("u", "v", "m").union(others.select("u", "v", "m"))


def _large_star(edges: DataFrame, bar: int) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(both.where("v > u"), least, bar).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, bar: int) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(edges, least, bar).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of an edge; ``root`` is the smallest node reachable.

    Alternates large-star and small-star steps until a round changes nothing. Both steps of a round are written to
    the shared folder, so nothing is gathered anywhere and lost executors cost one step at most. Nodes of many edges
    do not meet in one task (see ``HUBS``). Null ends and self loops are left out; an empty edge list gives an empty result.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v")
    now, path = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        bar = max(HUB_EDGES, 2 * seen[0] // HUBS)
        middle, between = materialise(_large_star(now, bar), "edges")
        after, fresh = materialise(_small_star(middle, bar), "edges")
        drop_path(spark, path)
        drop_path(spark, between)
        now, path = after, fresh
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number and sum of hashes of some edges: equal for equal edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
