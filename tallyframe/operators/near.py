"""Pairs of texts whose similarity may reach a threshold, by an index of their rarest grams instead of all pairs.

Texts of ``a`` and ``b`` characters reach the threshold only if their longest common subsequence has ``need`` characters. It falls
into runs of neighbours in both texts, one more than there are characters left over at most, so the texts share at least
``(2 q - 1) need - (q - 1) (a + b + 1)`` grams of ``q`` characters, each moved by no more places than a text has left over. With
the grams of both in one order, rarest first, the first ``k`` that they share so come among the first ``grams - shared + k`` of each.
Only these are joined, filtered by length and place, and ``k`` of them must meet. Pairs of characters are used where they must be
shared, else single ones; how many lead is worked out against the lengths that occur on the other side, so a text has no more
index rows than grams.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sizes of grams, the first that must be shared is used.
GRAMS = (2, 1)
#: Leading grams that must meet, where so many must be shared.
MEET = 8
#: Pairs of possible lengths that are met without an index (a second or two of comparisons in one task).
FEW = 500_000


def _need(total, threshold: float, ceil):
    return ceil(total * (threshold / 200) - 1e-9)


def leading(own: np.ndarray, other: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """``length, q, grams``: how many grams of ``q`` characters lead the index of a text of some length, given the lengths of the other side."""
    rows = []
    for a in own.tolist():
        need = _need(a + other, threshold, np.ceil).astype(np.int64)
        able = need <= np.minimum(a, other)
        done = np.zeros(len(other), dtype=bool)
        for q in GRAMS:
            shared = (2 * q - 1) * need - (q - 1) * (a + other + 1)
            mine = able & ~done & ((shared >= 1) | (q == GRAMS[-1]))
            done |= mine
            if mine.any():
                rows.append((a, q, max(1, a - q + 1 - int((shared - np.minimum(shared, MEET))[mine].min()))))
    return rows


def _grams(df: DataFrame, text: str, key: str, plan: DataFrame, side: int) -> DataFrame:
    """``side, block, key, n, q, keep, gram, at``: every gram of every text; the empty text has an empty one."""
    sized = df.select("block", F.col(key).alias("key"), F.col(text).alias("text"), F.length(text).alias("n")).join(F.broadcast(plan.where(F.col("side") == side)), "n")
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - F.col("q") + 1)), lambda i: F.struct(F.substr("text", i, F.col("q")).alias("gram"), i.alias("at")))
    return sized.select(F.lit(side).alias("side"), "block", "key", "n", "q", "keep", F.explode(each).alias("g")).select("side", "block", "key", "n", "q", "keep", "g.*")


def lengths(left: DataFrame, right: DataFrame, left_text: str, right_text: str) -> tuple[dict[int, int], dict[int, int]]:
    """How many texts of each length either side has: no more entries than the longest text has characters."""
    every = left.select(F.lit(0).alias("side"), F.length(left_text).alias("n")).union(right.select(F.lit(1).alias("side"), F.length(right_text).alias("n")))
    seen: tuple[dict, dict] = ({}, {})
    for r in every.groupBy("side", "n").agg(F.count("*").alias("k")).collect():
        seen[r["side"]][r["n"]] = r["k"]
    return seen


def able_pairs(seen: tuple[dict[int, int], dict[int, int]], threshold: float) -> int:
    """Pairs whose lengths allow the threshold, were all in one block."""
    other = np.array(sorted(seen[1]), dtype=np.int64)
    often = np.array([seen[1][n] for n in other.tolist()], dtype=np.float64)
    return sum(k * int(often[_need(a + other, threshold, np.ceil) <= np.minimum(a, other)].sum()) for a, k in seen[0].items())


def index(left: DataFrame, right: DataFrame, threshold: float, left_text: str, right_text: str, left_key: str, right_key: str, seen: tuple[dict, dict] | None = None) -> DataFrame | None:
    """``side, block, key, n, q, gram, at``: the leading grams of the texts of both sides (0 left, 1 right); None if no lengths go together."""
    own, other = (np.array(sorted(x), dtype=np.int64) for x in seen or lengths(left, right, left_text, right_text))
    rows = [(0, *x) for x in leading(own, other, threshold)] + [(1, *x) for x in leading(other, own, threshold)]
    if not rows:
        return None
    plan = left.sparkSession.createDataFrame(rows, "side int, n int, q int, keep int")
    grams = _grams(left, left_text, left_key, plan, 0).union(_grams(right, right_text, right_key, plan, 1))
    often = grams.groupBy("block", "q", "gram").agg(F.count("*").alias("often"))
    rarest = F.row_number().over(Window.partitionBy("side", "block", "key", "q").orderBy("often", "gram", "at"))
    return grams.join(often, ["block", "q", "gram"]).withColumn("place", rarest).where("place <= keep").select("side", "block", "key", "n", "q", "gram", "at")


def _agree(a: Column, b: Column, moved: Column, size: Column, threshold: float) -> tuple[Column, Column]:
    """Whether lengths and places of a shared gram of ``size`` allow the threshold, and how many must meet."""
    need = _need(a + b, threshold, F.ceil)
    q, shared = F.lit(GRAMS[-1]), need
    for n in reversed(GRAMS[:-1]):
        of_n = (2 * n - 1) * need - (n - 1) * (a + b + 1)
        q, shared = F.when(of_n >= 1, n).otherwise(q), F.when(of_n >= 1, of_n).otherwise(shared)
    return (need <= F.least(a, b)) & (moved <= a - need) & (moved >= need - b) & (size == q), F.least(shared, F.lit(MEET))


def near_pairs(left: DataFrame, right: DataFrame, threshold: float, left_text: str = "left_sorted", right_text: str = "right_sorted", left_key: str = "left_key", right_key: str = "right_key", few: int = FEW) -> DataFrame:
    """``left_key, right_key`` (told by key, once) of all pairs of a ``block`` that may reach ``threshold`` (0 to 100), and of few others.

    Texts and keys must not be null; a threshold of 0 asks for all pairs of a block. Sides that have ``few`` pairs of
    possible lengths at most meet without an index, which costs more than these.
    """
    if threshold <= 0:
        return left.select("block", left_key).join(right.select("block", right_key), "block").select(left_key, right_key)
    seen = lengths(left, right, left_text, right_text)
    if able_pairs(seen, threshold) <= few:
        sized = lambda df, key, text, n: df.select("block", key, F.length(text).alias(n))
        met = sized(left, left_key, left_text, "__a").join(sized(right, right_key, right_text, "__b"), "block")
        return met.where(_need(F.col("__a") + F.col("__b"), threshold, F.ceil) <= F.least("__a", "__b")).select(left_key, right_key)
    rows = index(left, right, threshold, left_text, right_text, left_key, right_key, seen)
    if rows is None:
        return left.select(left_key).crossJoin(right.select(right_key)).limit(0)
    a, b = rows.where("side = 0").alias("l"), rows.where("side = 1").alias("r")
    on = (F.col("l.block") == F.col("r.block")) & (F.col("l.q") == F.col("r.q")) & (F.col("l.gram") == F.col("r.gram"))
    allowed, meet = _agree(F.col("l.n"), F.col("r.n"), F.col("l.at") - F.col("r.at"), F.col("l.q"), threshold)
    met = a.join(b, on & allowed).groupBy(F.col("l.key").alias(left_key), F.col("r.key").alias(right_key)).agg(F.count("*").alias("met"), F.first(meet).alias("meet"))
    return met.where("met >= meet").select(left_key, right_key)
