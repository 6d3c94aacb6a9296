"""Exact ranked search by dual-sorted wavelet trees, one tree a shard of documents.

A shard holds, end to end, the postings of each of its terms by falling impact. A levelwise wavelet tree over their documents
keeps that order in every node: the first posting of a term in a node is its best among the node's range of documents, and
the leaves are the documents in order of id. So the sequence is sorted both ways. A query keeps a range a term in each node;
the weighed sum of first impacts bounds all documents below, exactly so at leaves. Nodes are opened best first, many at a
time, until none can change the best ``k``. What one shard finds bounds the next shards of its task.

A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), the impact of a posting (UNIT tf) div (1000 tf + 20 m), where
m = 50 + (50 n N) div L for a document of n terms; N documents have terms, L of them in all.

Defined results: a null text has no terms and is never found; repeated rows are documents of their own; a null id sorts before
all others; rows of the query table that share an item id are one item, whose terms count once each; an item without terms, or
none that any document has, has no rows; no documents give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .terms import CHUNK_BYTES, counted, cut, filled, runs

#: Documents and bytes of a shard at most (a longer document alone).
SHARD_DOCS, SHARD_BYTES = 4096, 8 << 20
#: Nodes opened at once; items that a task searches for at once.
WIDTH, ITEMS = 256, 2000
UNIT = 1_000_000_000
#: Stands for a null id.
NO_ID = np.iinfo(np.int64).min
SHARD = "doc_ids binary, terms array<string>, df array<int>, impacts binary, bits binary"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in runs(batches, size=CHUNK_BYTES):
        _, _, rows = cut(batch.column("text"), digits=True)
        yield pa.RecordBatch.from_arrays([pa.array([len(np.unique(rows))]), pa.array([len(rows)])], ["n", "l"])


def measure(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents that have a term, and terms of all documents."""
    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_measure, "n long, l long")
    n, total = found.agg(F.sum("n"), F.sum("l")).first()
    return int(n or 0), int(total or 0)


def depth_of(docs: int) -> int:
    return max(1, (docs - 1).bit_length())


def shard_of(ids: np.ndarray, texts: pa.Array, n_docs: int, n_terms: int) -> dict | None:
    """The columns of ``SHARD`` for some documents (ids ascending); None if they have no terms."""
    codes, words, rows = cut(texts, digits=True)
    if not len(codes):
        return None
    length = np.bincount(rows, minlength=len(ids))
    m = np.array([50 + (50 * n * n_docs) // n_terms for n in length.tolist()], dtype=np.int64)
    keys, tf = counted(codes * len(ids) + rows)
    term, doc = keys // len(ids), keys % len(ids)
    impact = (UNIT * tf) // (1000 * tf + 20 * m[doc])
    order = np.argsort((term << 21) - impact, kind="stable")  # by term, falling impact, document (keys came in its order)
    doc, impact = doc[order], impact[order]
    depth = depth_of(len(ids))
    narrow, bits = doc.astype(np.uint16 if depth <= 16 else np.uint32), []
    for level in range(depth):
        here = narrow[np.argsort(narrow >> (depth - level), kind="stable")] if level else narrow
        bits.append(np.packbits((here >> (depth - 1 - level)).astype(np.uint8) & 1).tobytes())
    return {"doc_ids": ids.astype("<i8").tobytes(), "terms": words, "df": np.bincount(term, minlength=len(words)).astype(np.int32), "impacts": impact.astype("<i4").tobytes(), "bits": b"".join(bits)}


def _build(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    for batch in runs(batches, size=SHARD_BYTES, rows=SHARD_DOCS):
        ids = batch.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        shard = shard_of(ids[order], filled(batch.column("text")).take(pa.array(order)), n_docs, n_terms)
        if shard:
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard["doc_ids"]], pa.binary()), _one(shard["terms"]), _one(pa.array(shard["df"])), pa.array([shard["impacts"]], pa.binary()), pa.array([shard["bits"]], pa.binary())],
                ["doc_ids", "terms", "df", "impacts", "bits"],
            )


def _one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class Index:
    """The shards of a corpus as a table in the shared folder, with what weights need."""

    def __init__(self, shards: DataFrame, n_docs: int, n_terms: int):
        self.shards, self.n_docs, self.n_terms = shards, n_docs, n_terms


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Every row indexed, shards made where rows are: nothing is shuffled. The table is written to the shared folder."""
    n_docs, n_terms = measure(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shards, _ = materialise(rows.mapInArrow(partial(_build, n_docs=n_docs, n_terms=n_terms), SHARD), "shards")
    return Index(shards, n_docs, n_terms)


class Tree:
    """A shard in memory: zeros before each place of each level, and impacts in the order of each level."""

    def __init__(self, doc_ids: bytes, df: np.ndarray, impacts: bytes, bits: bytes):
        self.ids = np.frombuffer(doc_ids, dtype="<i8")
        self.starts = np.concatenate([[0], np.cumsum(df, dtype=np.int64)])
        impact = np.frombuffer(impacts, dtype="<i4")
        self.depth, n = depth_of(len(self.ids)), len(impact)
        packed = np.frombuffer(bits, dtype=np.uint8).reshape(self.depth, -1)
        self.zeros = np.zeros((self.depth, n + 1), dtype=np.int32)
        self.impact = np.zeros((self.depth + 1, n), dtype=np.int32)
        self.impact[0] = impact
        prefix = np.zeros(n, dtype=np.uint16 if self.depth <= 16 else np.uint32)
        for level in range(self.depth):
            bit = np.unpackbits(packed[level], count=n)
            np.cumsum(bit == 0, out=self.zeros[level, 1:])
            prefix = prefix * prefix.dtype.type(2) + bit.astype(prefix.dtype)
            order = np.argsort(prefix, kind="stable")
            prefix = prefix[order]
            self.impact[level + 1] = self.impact[level][order]
        self.edge = np.searchsorted(prefix, np.arange((1 << self.depth) + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Offer to ``best`` all documents that may be among its ``k``."""
        start, end = self.starts[terms][None], self.starts[terms + 1][None]
        depth, prefix = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        bound = (self.impact[0][start] * weights).sum(1)
        while len(bound):
            first = self.ids[np.minimum(prefix << (self.depth - depth), len(self.ids) - 1)]
            keep = best.may(bound, first)
            depth, prefix, bound, start, end = depth[keep], prefix[keep], bound[keep], start[keep], end[keep]
            if not len(bound):
                return
            if len(bound) > WIDTH:
                order = np.argpartition(-bound, WIDTH)
                now, rest = order[:WIDTH], order[WIDTH:]
            else:
                now, rest = np.arange(len(bound)), np.zeros(0, dtype=np.int64)
            opened = self._open(depth[now], prefix[now], start[now], end[now], weights)
            leaf = opened[0] == self.depth
            if leaf.any():
                best.offer(opened[2][leaf], self.ids[opened[1][leaf]])
            depth, prefix, bound, start, end = (np.concatenate([old[rest], new[~leaf]]) for old, new in zip((depth, prefix, bound, start, end), opened, strict=True))

    def _open(self, depth: np.ndarray, prefix: np.ndarray, start: np.ndarray, end: np.ndarray, weights: np.ndarray) -> tuple:
        """Depth, prefix, bound and ranges of the children of some nodes that hold a term of the query."""
        left = self.edge[prefix << (self.depth - depth)]
        right = self.edge[(prefix + 1) << (self.depth - depth)]
        before = self.zeros[depth, left]
        inner = (self.zeros[depth, right] - before)[:, None]
        level, before, left = depth[:, None], before[:, None], left[:, None]
        zs, ze = self.zeros[level, start] - before, self.zeros[level, end] - before
        s = np.concatenate([left + zs, inner + start - zs])
        e = np.concatenate([left + ze, inner + end - ze])
        held = e > s
        below = np.concatenate([level, level]) + 1
        bound = (np.where(held, self.impact[below, np.minimum(s, self.impact.shape[1] - 1)], 0) * weights).sum(1)
        live = held.any(1)
        return below[live, 0], np.concatenate([prefix * 2, prefix * 2 + 1])[live], bound[live], s[live], e[live]


class Best:
    """The ``k`` best documents so far: highest score, then smallest id."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def may(self, bound: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which nodes, of such bounds and first ids, may hold one that belongs here."""
        if len(self.score) < self.k:
            return bound > 0
        return (bound > self.score[-1]) | ((bound == self.score[-1]) & (first < self.ids[-1]))

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        keep = self.may(score, ids)
        score, ids = np.concatenate([self.score, score[keep]]), np.concatenate([self.ids, ids[keep]])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[order], ids[order]


def _frequencies(batches: Iterator[pa.RecordBatch], asked: pa.Array) -> Iterator[pa.RecordBatch]:
    """``place, df`` of the terms asked for, summed over a task."""
    total = np.zeros(len(asked), dtype=np.int64)
    for batch in batches:
        for terms, df in zip(batch.column("terms"), batch.column("df"), strict=True):
            at = pc.index_in(asked, terms.values)
            here = at.is_valid().to_numpy(zero_copy_only=False)
            total[here] += df.values.to_numpy()[at.drop_null().to_numpy()]
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["place", "df"])


def _search(batches: Iterator[pa.RecordBatch], asked: pa.Array, items: list[tuple], k: int) -> Iterator[pa.RecordBatch]:
    """``item, score, id``: the best of a task's shards for each item, given as ``(name, places of terms, weights)``."""
    best = [Best(k) for _ in items]
    for batch in batches:
        for i in range(batch.num_rows):
            terms, df, doc_ids, impacts, bits = (batch.column(n)[i] for n in ("terms", "df", "doc_ids", "impacts", "bits"))
            at = pc.fill_null(pc.index_in(asked, terms.values), -1).to_numpy(zero_copy_only=False)
            if (at < 0).all():
                continue
            tree = Tree(doc_ids.as_buffer(), df.values.to_numpy(), impacts.as_buffer(), bits.as_buffer())
            for (_, places, weights), found in zip(items, best, strict=True):
                here = at[places] >= 0
                if here.any():
                    tree.search(at[places][here], weights[here], found)
    for n, found in enumerate(best):
        if len(found.ids):
            ids = pa.array(found.ids, mask=found.ids == NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), n)), pa.array(found.score), ids], ["item", "score", "id"])


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``item, term`` of every term of every item."""
    for batch in runs(batches):
        codes, words, rows = cut(batch.column("text"), digits=True)
        yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(rows)), words.take(pa.array(codes))], ["item", "term"])


def search(index: Index, queries: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", items: int = ITEMS) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` best documents of each item.

    Items are searched for in blocks of about ``items``; only a block's terms are on the driver or with a task at a time.
    """
    spark = queries.sparkSession
    rows = queries.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    terms, _ = materialise(rows.mapInArrow(_item_terms, "item long, term string").distinct(), "items")
    blocks = max(1, math.ceil(terms.select("item").distinct().count() / items))
    out = spark.createDataFrame([], "item_id long, score long, doc_id long")
    for block in range(blocks):
        mine = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).orderBy("item", "term").toArrow()
        names, words = mine["item"].to_pylist(), mine["term"].to_pylist()
        asked = sorted(set(words))
        if not asked:
            continue
        known = pa.array(asked, pa.string())
        df = np.zeros(len(asked), dtype=np.int64)
        found = index.shards.select("terms", "df").mapInArrow(partial(_frequencies, asked=known), "place long, df long").groupBy("place").agg(F.sum("df").alias("df"))
        for r in found.toLocalIterator():
            df[r["place"]] = r["df"]
        place = dict(zip(asked, range(len(asked)), strict=True))
        weights = np.array([weight(index.n_docs, d) if d else 0 for d in df.tolist()], dtype=np.int64)
        of_item: dict = {}
        for name, term in zip(names, words, strict=True):
            if df[place[term]]:
                of_item.setdefault(name, []).append(place[term])
        wanted = [(name, np.array(p), weights[np.array(p)]) for name, p in of_item.items()]
        if not wanted:
            continue
        hits = index.shards.mapInArrow(partial(_search, asked=known, items=wanted, k=k), "item long, score long, id long")
        labels = F.broadcast(spark.createDataFrame([(i, w[0]) for i, w in enumerate(wanted)], "item long, item_id long"))
        out = out.unionByName(hits.join(labels, "item").select("item_id", "score", F.col("id").alias("doc_id")))
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
