"""All pairs of the rows of a block, dealt evenly: blocks are cut into squares of so many rows a side, each met by one task.

A few large blocks so keep every core busy, and no task holds more than one side of a square. What is shuffled are the rows of both
sides, repeated for the squares of their block; pairs are made where they are used.

Rows that are equal in all that a pair is judged by go as one (:func:`alike`), with what else they have in an array: pairs of such groups
are met and judged, and the pairs of their rows are made at the very end (:func:`apart`). Rows of one group so come after each
other with the same judgement, which column formats store as a run.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written

#: Rows of a side of a square.
SIDE = 2048
#: Pairs and rows that a task is meant to have, and tasks at most.
TASK_PAIRS, TASK_ROWS, TASKS = 1_000_000, 250_000, 8192
#: Rows of a group at most: a pair of groups gives all its pairs of rows at once.
RUN = 128
#: The arrays of the rows that groups stand for.
LEFT, RIGHT = "__lefts", "__rights"


def alike(df: DataFrame, on: list[str], key: str, into: str) -> DataFrame:
    """The groups of rows that are equal in ``on`` (missing values too): these columns and ``into``, an array of the other columns of its rows.

    A group of more than ``RUN`` rows is several; one of more than ``SIDE`` rows is dealt by ``key`` before it is gathered, so that no task holds a large one whole.
    """
    large = df.groupBy(*on).agg(F.count("*").alias("__rows")).where(F.col("__rows") > SIDE).select(*[F.col(c).alias(f"__of_{c}") for c in on], "__rows")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in on])
    part = F.when(F.col("__rows").isNotNull(), F.pmod(F.xxhash64(key), F.ceil(F.col("__rows") / SIDE)))
    dealt = df.join(F.broadcast(large), same, "left").select(*df.columns, part.alias("__part"))
    gathered = dealt.groupBy(*on, "__part").agg(F.collect_list(F.struct(*[c for c in df.columns if c not in on])).alias("__all"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("__all") - 1) / RUN).cast("int")), lambda i: F.slice("__all", i * RUN + 1, RUN))
    return written(gathered.select(*on, F.explode(runs).alias(into)))


def apart(pairs: DataFrame) -> DataFrame:
    """The pairs of rows of pairs of groups, with the rows' own columns in place of ``LEFT`` and ``RIGHT``."""
    for rows in (LEFT, RIGHT):
        pairs = pairs.select(*[c for c in pairs.columns if c != rows], F.inline(rows))
    return pairs


def met(left: DataFrame, right: DataFrame, on: list[str], left_key: str, right_key: str, rows: Callable[[str], Column] = lambda key: F.lit(1)) -> DataFrame:
    """The rows of ``left`` and ``right`` that agree in ``on``, with the columns of both (``on`` once).

    ``left_key`` and ``right_key`` deal the rows of a block; other columns must not have a name in common. Groups
    are dealt by their arrays, and ``rows`` tells how many rows they stand for (``F.size``).
    """
    count = lambda df, key, n: df.groupBy(*on).agg(F.sum(rows(key)).alias(n))
    squares = lambda n: F.ceil(F.col(n) / SIDE).cast("int")
    sizes = written(count(left, left_key, "__n").join(count(right, right_key, "__m"), on).select(*on, "__n", "__m", squares("__n").alias("__down"), squares("__m").alias("__across")))
    pairs, rows = sizes.agg(F.sum(F.col("__n").cast("double") * F.col("__m")), F.sum(F.col("__n").cast("double") * F.col("__across") + F.col("__m").cast("double") * F.col("__down"))).first()
    tasks = min(TASKS, max(1, math.ceil(max((pairs or 0) / TASK_PAIRS, (rows or 0) / TASK_ROWS))))

    def dealt(df: DataFrame, key: str, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        placed = df.join(sizes.select(*on, n_own, n_other), on).withColumn(own, F.pmod(F.xxhash64(key), F.col(n_own)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).drop(n_own, n_other).repartition(tasks, *on, "__i", "__j")

    l_rows, r_rows = dealt(left, left_key, "__i", "__down", "__j", "__across"), dealt(right, right_key, "__j", "__across", "__i", "__down")
    return l_rows.join(r_rows, [*on, "__i", "__j"]).drop("__i", "__j")


def met_groups(left: DataFrame, right: DataFrame, on: list[str], left_values: list[str], right_values: list[str], left_key: str, right_key: str) -> DataFrame:
    """:func:`met` as pairs of groups of rows that are equal in ``on`` and the values of their side."""
    return met(alike(left, [*on, *left_values], left_key, LEFT), alike(right, [*on, *right_values], right_key, RIGHT), on, LEFT, RIGHT, F.size)
