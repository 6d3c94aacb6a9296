"""Near-duplicate vectors: sign hashes in several tables, cosines verified in double precision, components.

A table's signature is the signs of a vector's products with random hyperplanes. Vectors that share a
signature in some table are compared; a pair counts in the first table it shares, so that no pair
counts twice and no list of pairs is ever shuffled. Width and number of the tables follow from the
number of vectors and the recall asked for at the threshold itself; closer pairs are found more surely.

Signatures are wide enough that most have one vector. They are shuffled as ``key, node`` alone; only vectors that share one
are sent (as they came, 4 bytes a component where they are floats) to be compared. Equal vectors are one row from the start.
Signatures with many vectors are cut into blocks of rows.

Defined results: null, zero-length, zero and non-finite vectors, and those with null components, link
with nothing and are components of their own; vectors of different lengths never link; repeated rows
count as vectors; a null id links like any other but names no component; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import join_hot, meetings, merge_labels, small_pairs, star_edges, together, whole_groups
from .common import materialise
from .components import connected_components

#: Share of the pairs exactly at the threshold that share a signature in some table.
RECALL = 0.99
#: Runs of at most so many vectors are compared together, pair by pair.
SMALL = 48
#: Bits by which signatures are wider than the number of vectors needs: of 2**SPARSE unlike vectors about one shares a signature.
SPARSE = 5


def tables_for(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a signature and number of tables for ``n`` vectors."""
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    bits = min(40, max(8, math.ceil(math.log2(max(n, 1))) + SPARSE))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits))


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    vectors = flat.astype(np.float64).reshape(-1, dim)
    unit = vectors / np.abs(vectors).max(1)[:, None]  # so that no square overflows or vanishes
    return unit / np.sqrt((unit * unit).sum(1))[:, None]


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    """The hyperplanes of all tables for vectors of that length, the same in every task."""
    return np.random.default_rng([17, dim]).standard_normal((dim, bits * tables))


def _signatures(unit: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    return (unit @ planes > 0).reshape(len(unit), -1, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _sign(batches: Iterator[pa.RecordBatch], bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    """``key, node``: the signature of each vector in each table, as the table's number and 44 bits that follow from length and signs."""
    planes: dict[int, np.ndarray] = {}
    first = np.arange(tables, dtype=np.int64) << 44
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            if dim not in planes:
                planes[dim] = _planes(dim, bits, tables)
            for part in pa.Table.from_batches([batch]).filter(pa.array(dims == dim)).combine_chunks().to_batches(max_chunksize=512):
                signs = _signatures(_unit(part.column("vector").flatten().to_numpy(zero_copy_only=False), dim), planes[dim], bits).astype(np.uint64)
                mixed = (signs + np.uint64(dim)) * np.uint64(0x9E3779B97F4A7C15)
                keys = first + ((mixed ^ (mixed >> np.uint64(32))) & np.uint64((1 << 44) - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column("node").to_numpy(), tables))], ["key", "node"])


def _verify(batches: Iterator[pa.RecordBatch], threshold: float, bits: int, tables: int, step: int = 1024) -> Iterator[pa.RecordBatch]:
    planes: dict[int, np.ndarray] = {}
    for table, cuts in whole_groups(batches, ["key", "pair"]):
        sizes = np.diff(cuts)
        dims = np.unique(table["dim"].to_numpy())
        for dim in dims.tolist():
            if dim not in planes:
                planes[dim] = _planes(dim, bits, tables)
        alone = len(dims) == 1  # else small runs are taken one by one, too
        if alone and (few := np.repeat((sizes > 1) & (sizes <= SMALL), sizes)).any():
            bounds = np.concatenate([[0], np.cumsum(sizes[(sizes > 1) & (sizes <= SMALL)])])
            yield from _verify_small(table.filter(pa.array(few)).combine_chunks(), bounds, dims[0], planes[dims[0]], threshold, bits)
        for g in np.flatnonzero(sizes > (SMALL if alone else 1)):
            run = table.slice(cuts[g], sizes[g])
            for dim in dims.tolist():
                yield from _verify_run(run.filter(pa.array(run["dim"].to_numpy() == dim)).combine_chunks(), dim, planes[dim], threshold, bits, step)


def _verify_small(rows: pa.Table, cuts: np.ndarray, dim: int, planes: np.ndarray, threshold: float, bits: int) -> Iterator[pa.RecordBatch]:
    """The same as :func:`_verify_run` for many small runs at once. In pairs of blocks only rows of different sides are new to each other."""
    node, copies, side, tab = (rows[c].to_numpy() for c in ("node", "copies", "side", "key"))
    tab = tab >> 44
    unit = _unit(rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False), dim)
    links, label = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
    i, j = small_pairs(cuts, SMALL)
    for at in range(0, len(i), 1 << 15):
        x, y = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
        x, y = (z[(side[x] == 2) | (side[x] != side[y])] for z in (x, y))
        near = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
        x, y = x[near], y[near]
        if not len(x):
            continue
        _, place, named = np.unique(node[np.concatenate([x, y])], return_index=True, return_inverse=True)
        first = np.concatenate([x, y])[place]
        names = np.concatenate([_signatures(unit[first[k : k + 512]], planes, bits) for k in range(0, len(first), 512)])
        for k in range(0, len(x), 1 << 13):
            here = np.arange(k, min(len(x), k + (1 << 13)))
            same = names[named[here]] == names[named[len(x) + here]]
            fresh = here[same[np.arange(len(here)), tab[x[here]]] & (same.argmax(1) == tab[x[here]])]
            np.add.at(links, x[fresh], copies[y[fresh]])
            np.add.at(links, y[fresh], copies[x[fresh]])
            merge_labels(label, x[fresh], y[fresh])
    found = np.flatnonzero(links)
    if len(found):
        least = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(least, label, node)
        yield pa.RecordBatch.from_arrays([pa.array(node[found]), pa.array(links[found]), pa.array(least[label[found]])], ["node", "links", "root"])


def _verify_run(run: pa.Table, dim: int, planes: np.ndarray, threshold: float, bits: int, step: int) -> Iterator[pa.RecordBatch]:
    node, copies, side = (run[c].to_numpy() for c in ("node", "copies", "side"))
    tab = int(run["key"][0].as_py()) >> 44
    unit = _unit(run["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False), dim)
    names = np.full((len(node), tab + 1), -1, dtype=np.int64)  # of the rows with links, in this table and those before it
    one_block = bool((side == 2).all())
    left, right = (np.arange(len(node)),) * 2 if one_block else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    links = np.zeros(len(node), dtype=np.int64)
    label = np.arange(len(node))
    for a in range(0, len(left), step):
        rows = left[a : a + step]
        for b in range(a if one_block else 0, len(right), step):
            columns = right[b : b + step]
            hit = unit[rows] @ unit[columns].T >= threshold
            if one_block and a == b:
                hit = np.triu(hit, 1)
            i, j = np.nonzero(hit)
            i, j = rows[i], columns[j]
            new = np.unique(np.concatenate([i, j]))
            new = new[names[new, 0] < 0]
            for at in range(0, len(new), 512):
                names[new[at : at + 512]] = _signatures(unit[new[at : at + 512]], planes[:, : (tab + 1) * bits], bits)
            for at in range(0, len(i), 1 << 14):
                x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                same = names[x] == names[y]
                fresh = same[:, tab] & ~same[:, :tab].any(1)
                x, y = x[fresh], y[fresh]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                merge_labels(label, x, y)
    if links.any():
        found = np.flatnonzero(links)
        label = label[found]
        _, label = np.unique(label, return_inverse=True)
        root = dict(zip(*star_edges(label, node[found]), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(node[found]), pa.array(links[found]), pa.array([root.get(n, n) for n in node[found].tolist()], pa.int64())], ["node", "links", "root"])


def mark(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = RECALL) -> DataFrame:
    """``id, n_links, component, kept`` for every row."""
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vector"))
    fine = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    # an equal vector is told by 128 bits; a negative zero is a zero
    rows = raw.withColumn("vector", F.when(fine, F.transform("vector", lambda x: F.when(x == 0, F.lit(0).cast(kind[6:-1])).otherwise(x))))
    rows = rows.withColumn("name", F.when(F.col("vector").isNotNull(), F.struct(F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(1), "vector").alias("b"))))
    alike = rows.where("vector is not null").groupBy("name", "vector").agg(F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vector"))
    alike, _ = materialise(alike, "vectors")
    bits, tables = tables_for(alike.count(), threshold, recall)
    keys_of = lambda nodes: nodes.select("node", "dim", "vector").mapInArrow(partial(_sign, bits=bits, tables=tables), "key long, node long")
    met = together(meetings(alike, keys_of), alike.select("node", "copies", "dim", "vector"))
    found, _ = materialise(met.mapInArrow(partial(_verify, threshold=threshold, bits=bits, tables=tables), "node long, links long, root long"), "links")
    roots = connected_components(found, "node", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = alike.select("name", "node", "copies").join(links, "node", "left").join(roots, "node", "left")
    known, _ = materialise(known.select("name", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), "known")
    named = join_hot(rows.select("id", "name"), known, "name", "copies", "left")
    named, _ = materialise(named.select("id", "root", (F.col("links") + F.col("copies") - 1).alias("links")), "named")
    least, _ = materialise(named.where("root is not null").groupBy("root").agg(F.min("id").alias("least"), F.count("*").alias("members")), "least")
    out = join_hot(named, least, "root", "members", "left")
    out = out.select("id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("least", "id").alias("component"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))
