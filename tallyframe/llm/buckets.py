"""Groups of rows that share a key, read in order by Arrow tasks, with hot keys split into pairs of blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Rows of a key that one task compares at once; a key with more is cut into blocks, met two by two.
BLOCK_ROWS = 8192
#: A key is hot if it has more than rows / HOT_KEYS rows, and more than COLD_ROWS. So there are HOT_KEYS of them at most, and they may be broadcast.
HOT_KEYS, COLD_ROWS = 5000, 64
#: Share of the rows in which :func:`meetings` looks for hot keys, and how often one must be met there.
PEEK, PEEKED = 0.02, 100


def join_hot(rows: DataFrame, table: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table`` (one row a key), whose column ``weight`` is the number of the rows that have the key.

    Hot keys are joined by broadcast, the others by shuffle, so that no task gets all rows of a hot key. With ``how="left"``
    rows without a partner stay; those without a key do not meet in one task either.
    """
    total, most = table.agg(F.sum(weight), F.max(weight)).first()
    bar = max(COLD_ROWS, int(total or 0) // HOT_KEYS)
    known = rows.where(F.col(key).isNotNull())
    if (most or 0) > bar:
        hot = F.broadcast(table.where(F.col(weight) > bar))
        rest = known.join(hot.select(key), key, "left_anti").join(table.where(F.col(weight) <= bar), key, how)
        out = known.join(hot, key).unionByName(rest)
    else:
        out = known.join(table, key, how)
    return out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else out


def _paired(rows: DataFrame, columns: list[str], block: Column, blocks: Column) -> DataFrame:
    """``columns``, ``pair`` (which two blocks of a key meet) and ``side`` (0 first block, 1 second, 2 a block by itself); each block goes to all its pairs."""
    whole = F.array(F.struct(F.lit(0).alias("pair"), F.lit(2).alias("side")))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct((F.least("block", other) * F.col("blocks") + F.greatest("block", other)).cast("int").alias("pair"), F.when(F.col("block") == other, 2).otherwise((F.col("block") > other).cast("int")).alias("side")),
    )
    placed = rows.withColumn("blocks", blocks.cast("int")).withColumn("block", block)
    return placed.select(*columns, F.explode(F.when(F.col("blocks") > 1, pairs).otherwise(whole)).alias("p")).select(*columns, "p.pair", "p.side")


def _block_of(node: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(node), blocks).cast("int")


def in_blocks(rows: DataFrame, key: str, node: str, weight: str, block_weight: int) -> DataFrame:
    """``rows`` with ``pair`` and ``side``: a key whose rows weigh more than ``block_weight`` is cut by a hash of ``node``.

    A larger key is cut into b blocks; each block goes to its b pairs, so that all its rows still meet one another.
    """
    large = rows.groupBy(key).agg(F.sum(weight).alias("weight_of_key"), F.count("*").alias("rows_of_key")).where(F.col("weight_of_key") > block_weight)
    large, _ = materialise(large, "large")
    blocks = F.ceil(F.coalesce(F.col("weight_of_key"), F.lit(1)) / block_weight)
    return _paired(join_hot(rows, large, key, "rows_of_key", "left"), rows.columns, _block_of(node, F.col("blocks")), blocks)


def meetings(nodes: DataFrame, keys_of: Callable[[DataFrame], DataFrame], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``key, node, pair, side`` for the rows of ``keys_of(nodes)`` (``key, node``) whose key two rows or more have.

    Only these two columns are shuffled, once; a key that no other row has ends here. Keys that are hot among
    a sample of the nodes are cut into blocks before that shuffle, by the size that the sample makes likely; the sample
    only tells which way rows go, and no row is left out.
    """
    peek = keys_of(nodes.sample(PEEK, seed=5)).groupBy("key").agg(F.count("*").alias("seen"))
    peek, _ = materialise(peek.where(F.col("seen") > PEEKED), "peek")
    bar = max(PEEKED, math.ceil((peek.agg(F.sum("seen")).first()[0] or 0) / HOT_KEYS))
    hot = peek.where(F.col("seen") > bar).select("key", F.ceil(F.col("seen") / PEEK / block_rows).cast("int").alias("guess"))
    rows = keys_of(nodes).join(F.broadcast(hot), "key", "left")
    rows = rows.withColumn("block", F.when(F.col("guess") > 1, _block_of("node", F.col("guess"))).otherwise(0))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("key", "block"))).where("n > 1 or guess is not null")
    return _paired(rows, ["key", "node"], _block_of("node", F.col("blocks")), F.coalesce("guess", F.ceil(F.col("n") / block_rows)))


def together(met: DataFrame, payload: DataFrame) -> DataFrame:
    """The rows of :func:`meetings` with the columns that ``payload`` (``node``, ...) has for their nodes, those of a key and pair in one run."""
    return met.join(payload, "node").repartition("key", "pair").sortWithinPartitions("key", "pair")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the bounds of these, from batches sorted by the keys."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest and all(rest[-1].column(k)[-1] == batch.column(k)[0] == batch.column(k)[-1] for k in keys):
            rest.append(batch)
            continue
        table = pa.Table.from_batches([*rest, batch]).combine_chunks()
        cuts = _cuts(table, keys)
        if len(cuts) > 2:
            yield table.slice(0, cuts[-2]), cuts[:-1]
        rest = table.slice(cuts[-2]).to_batches()
    if rest:
        table = pa.Table.from_batches(rest).combine_chunks()
        yield table, np.array([0, table.num_rows])


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of two or more rows with equal keys, from batches sorted by them; lone rows are left out."""
    for table, cuts in whole_groups(batches, keys):
        yield from _runs(table, cuts)


def small_pairs(cuts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within each group of at most ``most`` rows, for all these groups at once."""
    sizes = np.diff(cuts)
    end = np.repeat(np.where(sizes <= most, cuts[1:], 0), sizes)
    here = np.arange(len(end))
    first, second = [], []
    for shift in range(1, most):
        i = here[here + shift < end]
        if not len(i):
            break
        first.append(i)
        second.append(i + shift)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *first]), np.concatenate([none, *second])


def _cuts(table: pa.Table, keys: list[str]) -> np.ndarray:
    fresh = np.zeros(table.num_rows, dtype=bool)
    fresh[0] = True
    for k in keys:
        column = table[k].to_numpy()
        fresh[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(fresh), table.num_rows)


def _runs(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.Table]:
    for i in np.flatnonzero(np.diff(cuts) > 1):
        yield table.slice(cuts[i], cuts[i + 1] - cuts[i])


def star_edges(labels: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest node of its label."""
    names, place = np.unique(labels, return_inverse=True)
    least = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(least, place, nodes)
    to = least[place]
    moved = to != nodes
    return nodes[moved], to[moved]


def merge_labels(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Labels (places of rows) fall to the smallest of the linked rows and of those that share a label with them."""
    while True:
        low = np.minimum(label[x], label[y])
        if (label[x] == low).all() and (label[y] == low).all():
            return
        best = np.arange(len(label))
        np.minimum.at(best, label[x], low)
        np.minimum.at(best, label[y], low)
        while True:
            deeper = best[best]
            if (deeper == best).all():
                break
            best = deeper
        label[:] = best[label]


class Forest:
    """Union-find over the rows of one group, labelled by numpy."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, rows: np.ndarray) -> None:
        old = np.unique(self.label[rows])
        if len(old) > 1:
            self.label[np.isin(self.label, old[1:])] = old[0]


def link_near(near: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int, step: int = 1024) -> np.ndarray:
    """Component labels of rows 0..n-1 under ``near(rows, rows) -> matrix of links``.

    Rows around a leader are joined first; then only rows of different components are compared,
    so a tight group costs one pass, and no link between components is missed.
    """
    forest, pending = Forest(n), np.arange(n)
    for _ in range(int(math.log2(n + 1)) + 1):
        if len(pending) < 2:
            break
        hit = near(pending[:1], pending)[0]
        hit[0] = True
        forest.join(pending[hit])
        pending = pending[~hit]
    for start in range(0, n, step):
        mine = np.arange(start, min(n, start + step))
        if (forest.label == forest.label[0]).all():
            break
        for other in range(start, n, step):
            theirs = np.arange(other, min(n, other + step))
            apart = forest.label[mine][:, None] != forest.label[theirs][None, :]
            rows, columns = apart.any(1), apart.any(0)
            if not rows.any():
                continue
            a, b = mine[rows], theirs[columns]
            for i, j in np.argwhere(near(a, b)):
                if forest.label[a[i]] != forest.label[b[j]]:
                    forest.join(np.array([a[i], b[j]]))
    return forest.label
