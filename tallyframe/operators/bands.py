"""Pairs of near numbers by a band join: values in bins as wide as the accepted difference, neighbouring bins met, pairs verified.

The proximity of two numbers is 1 - |a - b| / max(|a|, |b|, 1). Up to 1 the accepted difference is a constant, beyond it a
constant factor, so bins are even up to 1 and logarithmic beyond; near pairs are never more than one bin apart.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import LEFT, RIGHT, alike, apart, met


def proximity(a: Column, b: Column) -> Column:
    """0 to 1; null if either is."""
    a, b = a.cast("double"), b.cast("double")
    share = 1 - F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    return F.when(share.isNotNull(), F.greatest(F.lit(0.0), share))


def mean_proximity(pairs: list[tuple[Column, Column]]) -> Column:
    """Mean of the proximities over the fields that both have; null if there is none."""
    scores = [proximity(a, b) for a, b in pairs]
    total = reduce(lambda x, y: x + y, [F.coalesce(s, F.lit(0.0)) for s in scores])
    n = reduce(lambda x, y: x + y, [s.isNotNull().cast("int") for s in scores])
    return F.when(n > 0, total / n)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value``, worked out once a row: filters on it are not merged with what made the row, whose code would grow too large to compile."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _close(a: str, b: str, least: float) -> Column:
    """Whether two given numbers have a proximity of ``least``, or a trace less."""
    return F.abs(F.col(a) - F.col(b)) <= (1 - least + 1e-9) * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def bin_of(v: Column, least: float) -> Column:
    """The bin of a value: those of two values with a proximity of ``least`` or more are equal or neighbours."""
    low, factor = 1 - least, math.log(1 / least)
    turn = min(max(low / (least * factor), 1.0), 1 / least)  # where a pair around 1 is furthest apart on the scale
    width = max(1.0, (1 - least * turn) / low + math.log(turn) / factor) * (1 + 1e-9)
    size = F.abs(v)
    scale = F.when(size <= 1, size / low).otherwise(1 / low + F.log(size) / factor) / width
    return F.floor(F.when(v < 0, -scale).otherwise(scale)).cast("long")


def band_pairs(left: DataFrame, right: DataFrame, fields: list[tuple[str, str]], least: float, left_key: str = "left_key", right_key: str = "right_key") -> DataFrame:
    """``left_key, right_key`` (told by key, once) of the pairs of a ``block`` that have a proximity of ``least`` or more in one field at least.

    ``fields``: the columns of both sides that are compared. The mean over fields is no more than the largest of them, so no
    pair whose mean reaches ``least`` is missed. ``least`` is above 0: at 0 every pair of a block is near.
    """
    if least <= 0:
        raise ValueError("a band needs a proximity above 0")
    least = min(least, 1 - 1e-9)
    out = None
    for l_name, r_name in fields:
        value = lambda df, n, key: df.select("block", F.col(key), F.col(n).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
        a = value(left, l_name, left_key).withColumn("bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: bin_of(F.col("v"), least) + i))).alias("l")
        b = value(right, r_name, right_key).withColumn("bin", bin_of(F.col("v"), least)).alias("r")
        near = (F.col("l.block") == F.col("r.block")) & (F.col("l.bin") == F.col("r.bin")) & (proximity(F.col("l.v"), F.col("r.v")) >= least - 1e-12)
        found = a.join(b, near).select(left_key, right_key)
        out = found if out is None else out.union(found)
    return out if len(fields) == 1 else out.distinct()


def _near(left: DataFrame, right: DataFrame, fields: list[tuple[str, str]], least: float) -> DataFrame:
    """Groups of both sides that are near in each of the fields, by equal or neighbouring bins."""
    on = ["block"]
    for i, (a, b) in enumerate(fields):
        on.append(f"__bin{i}")
        left = left.where(F.col(a).isNotNull()).withColumn(on[-1], F.explode(F.array(*[bin_of(F.col(a), least) + k for k in (-1, 0, 1)])))
        right = right.where(F.col(b).isNotNull()).withColumn(on[-1], bin_of(F.col(b), least))
    return met(left, right, on, LEFT, RIGHT, F.size).drop(*on[1:]).where(reduce(lambda x, y: x & y, [_close(a, b, least) for a, b in fields]))


def mean_pairs(left: DataFrame, right: DataFrame, fields: list[tuple[str, str]], least: float, left_key: str = "left_key", right_key: str = "right_key") -> DataFrame:
    """The rows of both sides, with all their columns and ``proximity``, of the pairs of a ``block`` whose mean proximity over ``fields`` reaches ``least``, once."""
    return apart(mean_groups(left, right, fields, least, left_key, right_key))


def mean_groups(left: DataFrame, right: DataFrame, fields: list[tuple[str, str]], least: float, left_key: str = "left_key", right_key: str = "right_key") -> DataFrame:
    """:func:`mean_pairs` as pairs of groups of rows that are equal in ``block`` and ``fields``, for what is worked out of these alone; ``blocks.apart`` gives the rows.

    Groups are met, verified and given on in one step: pairs are not shuffled. Where both have all of ``n`` fields, none may be
    less than ``1 - n (1 - least)``, so they meet in bins of two fields at once. A pair with a field missing on one side is met in
    the first of its fields that reaches ``least``. Keys are unique; columns of both sides but ``block`` have different names. ``least`` is above 0.
    """
    if least <= 0:
        raise ValueError("a band needs a proximity above 0")
    band, known = min(least, 1 - 1e-9), lambda names: reduce(lambda x, y: x & y, [F.col(n).isNotNull() for n in names])
    scores = [proximity(F.col(a), F.col(b)) for a, b in fields]
    numbers = lambda df, names: df.withColumns({n: F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double")) for n in names})
    groups = lambda df, names, key, into: alike(numbers(df, names), ["block", *names], key, into)
    left, right = groups(left, [a for a, _ in fields], left_key, LEFT), groups(right, [b for _, b in fields], right_key, RIGHT)

    def by_first(lhs: DataFrame, rhs: DataFrame) -> DataFrame:
        parts = []
        for i, field in enumerate(fields):
            first = reduce(lambda x, y: x & y, [F.coalesce(s < band - 1e-12, F.lit(True)) for s in scores[:i]], scores[i] >= band - 1e-12)
            parts.append(_near(lhs, rhs, [field], band).where(first))
        return reduce(DataFrame.unionByName, parts)

    bound = 1 - len(fields) * (1 - band)
    if len(fields) == 1:
        found = _near(left, right, fields, band)
    elif bound <= 0:
        found = by_first(left, right)
    else:
        whole_left, whole_right = known([a for a, _ in fields]), known([b for _, b in fields])
        found = _near(left.where(whole_left), right.where(whole_right), fields[:2], bound - 1e-9)
        if not left.where(~whole_left).isEmpty():
            found = found.unionByName(by_first(left.where(~whole_left), right))
        if not right.where(~whole_right).isEmpty():
            found = found.unionByName(by_first(left.where(whole_left), right.where(~whole_right)))
    return once(found, "proximity", mean_proximity([(F.col(a), F.col(b)) for a, b in fields])).where(F.col("proximity") >= least - 1e-12)
