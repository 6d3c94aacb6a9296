"""Near-duplicates by SimHash, found through tables of distances to reference fingerprints (pivots).

For every distinct fingerprint two tables of Hamming distances are computed once:

* distances to pivot pairs that agree on one block of bits and are opposite elsewhere. Half the sum of the two distances,
  less a constant, is the fingerprint's distance to the pivot within the block: a coordinate. Pairs of fingerprints whose
  coordinates differ in too many blocks never meet; the others do by equal coordinates, so no pair of rows is listed.
* distances to random pivots over all bits. Two fingerprints differ in at least as many bits as these distances
  do, so pairs that meet are discarded by the largest difference of coordinates; the survivors are verified.

How rows meet:

* ``exact``: with B blocks and at most d differing bits, two linked fingerprints have equal coordinates in at
  least B - d blocks. Rows meet by the coordinates of each choice of B - d blocks. No pair within d bits is missed.
* ``banded`` (for sets of shingles at a target similarity): rows meet by the coordinates of random small
  blocks of bits, as many as the target similarity and recall ask for; short sets, for which the
  coordinates are too coarse, meet by the shingles of which two such sets must share one, so that no
  pair is missed. Distance is a filter only: within groups that it connects, two sets are linked if
  their exact Jaccard similarity is the target or more (shingles are told apart by 64-bit hashes).

Equal fingerprints are one row from the start, so copies cost nothing. Keys of meetings are shuffled without the
fingerprints; those join only where two rows share a key. Hot groups are cut into blocks of rows.
Components are found from the links, never from pairs of documents.

Defined results: a null text counts as empty; a text without words has fingerprint zero; rows with
a null id get a fingerprint and a component like others but never name one; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain, combinations, islice, repeat
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buckets import in_blocks, join_hot, link_near, meetings, merge_labels, small_pairs, star_edges, together, whole_groups
from .common import materialise, release, small, spare
from .components import connected_components

SEED = 42
#: Bytes of text beyond which words are read one by one instead of all at once.
LONG_TEXT = 8 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def _shingles(data: bytes, k: int) -> Iterator[bytes]:
    if len(data) <= LONG_TEXT:
        words = data.split()
        if len(words) < k:
            return iter([b" ".join(words)] if words else [])
        return map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    return _long_shingles(data, k)


def _long_shingles(data: bytes, k: int) -> Iterator[bytes]:
    window: list[bytes] = []
    whole = True
    for m in _WORD.finditer(data):
        window.append(m.group())
        if len(window) == k:
            yield b" ".join(window)
            del window[0]
            whole = False
    if whole and window:
        yield b" ".join(window)


def _spread(h: np.ndarray, word: int) -> np.ndarray:
    """Further 64 bits from the same hashes (word 0: the hashes themselves)."""
    if word:
        h = (h ^ np.uint64(0x9E3779B97F4A7C15 * (2 * word + 1) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return h


def fingerprint(text: str | None, k: int = 3, words: int = 1) -> np.ndarray:
    """The fingerprint of a text in ``words`` 64-bit words: a bit is 1 if set in over half the shingles' hashes."""
    ones, n = np.zeros(64 * words, dtype=np.int64), 0
    shingles = _shingles((text or "").encode("utf-8", "surrogatepass").lower(), k)
    while True:
        h = np.fromiter(map(xxhash.xxh64_intdigest, islice(shingles, 1 << 16), repeat(SEED)), dtype=np.uint64)
        if not len(h):
            break
        n += len(h)
        ones += _ones(h, words)
    return np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)


def _ones(h: np.ndarray, words: int) -> np.ndarray:
    return np.concatenate([np.unpackbits(_spread(h, w).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for w in range(words)])


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, in order."""
    shingles = _shingles((text or "").encode("utf-8", "surrogatepass").lower(), k)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64))


def set_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """The fingerprint in which every distinct shingle has one vote, however often it is repeated."""
    ones = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += _ones(hashes[at : at + (1 << 16)], words)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)


def _fingerprints(batches: Iterator[pa.RecordBatch], k: int, words: int) -> Iterator[pa.RecordBatch]:
    release()
    for batch in small(batches):
        texts = batch.column("text")
        prints = [fingerprint(texts[i].as_py(), k, words).tobytes() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints, pa.binary())], ["id", "fp"])


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Pivots:
    """Reference fingerprints in opposite pairs, for blocks of bits, and the coordinates they give."""

    def __init__(self, words: int, blocks: list[np.ndarray], per_block: int, seed: int = 7):
        self.words, self.blocks = words, blocks
        rng = np.random.default_rng(seed)
        near, far = [], []
        for bits in blocks:
            mask = np.zeros(64 * words, dtype=np.uint8)
            mask[bits] = 1
            for j in range(per_block):
                pivot = rng.integers(0, 2, 64 * words, dtype=np.uint8)
                if j:  # unit steps within the block, so that few coordinates tell its contents apart
                    pivot[bits] = first[bits]
                    pivot[bits[(j - 1) % len(bits)]] ^= 1
                else:
                    first = pivot
                near.append(pivot)
                far.append(np.where(mask, pivot, 1 - pivot))
        self.near, self.far = (np.packbits(np.array(x, dtype=np.uint8), axis=1, bitorder="little").view(np.uint64) for x in (near, far))
        self.outside = np.array([64 * words - len(b) for b in blocks for _ in range(per_block)])
        self.per_block = per_block

    def table(self, fps: np.ndarray) -> np.ndarray:
        """Distances of each fingerprint to each pair of pivots, and from them the coordinates: rows x blocks x pivots."""
        out = np.empty((len(fps), len(self.near)), dtype=np.int16)
        for j in range(len(self.near)):
            d = _popcount(fps ^ self.near[j]).sum(1, dtype=np.int16) + _popcount(fps ^ self.far[j]).sum(1, dtype=np.int16)
            out[:, j] = (d - self.outside[j]) // 2
        return out.reshape(len(fps), len(self.blocks), self.per_block)


def _key(parts: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit name of coordinates; two that clash only meet for nothing."""
    h = np.full(len(parts), 1469598103934665603 + 31 * salt, dtype=np.uint64)
    for j in range(parts.shape[1]):
        h = (h ^ parts[:, j].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


class Plan:
    """How fingerprints meet: blocks, their pivots, and the choices of blocks whose coordinates must agree."""

    def __init__(self, words: int, max_distance: int, similarity: float | None, expected_rows: int):
        self.words, self.max_distance = words, max_distance
        bits = np.arange(64 * words)
        if similarity is None:
            n_blocks = max_distance + 4
            self.blocks = np.array_split(bits, n_blocks)
            self.choices = list(combinations(range(n_blocks), n_blocks - max_distance))
        else:
            agree = 1 - differing(similarity) - PARITY
            width = max(16, math.ceil(math.log2(max(expected_rows, 1))) + SPARSE)
            tables = math.ceil(math.log(1 - RECALL) / math.log(1 - agree**width))
            rng = np.random.default_rng(11)
            self.blocks = [np.sort(rng.choice(bits, width, replace=False)) for _ in range(tables)]
            self.choices = [(b,) for b in range(tables)]
        self.pivots = Pivots(words, self.blocks, 1 + max(map(len, self.blocks)))

    def keys(self, fps: np.ndarray) -> np.ndarray:
        table = self.pivots.table(fps)
        names = [_key(table[:, b], b) for b in range(len(self.blocks))]
        return np.stack([_key(np.stack([names[b] for b in c], axis=1), i) for i, c in enumerate(self.choices)], axis=1)


def differing(similarity: float) -> float:
    """Share of bits in which large sets of that Jaccard similarity s differ (their cosine is 2s / (1 + s))."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


#: Chance of meeting, in some table, for a pair exactly at the target similarity.
RECALL = 0.99
#: Bits by which blocks are wider than the number of rows needs: of 2**SPARSE unlike rows about one meets another in a table.
SPARSE = 4
#: Sets of at most so many shingles meet by shared shingles instead.
SHORT = 100
#: By how much more sets of over SHORT shingles may differ than large ones (0.0015 at most for 0.8, counted out).
PARITY = 0.002
#: Pivots of the table by which rows that met are discarded before they are verified.
FILTER_PIVOTS = 12


def pivot_distances(fps: np.ndarray) -> np.ndarray:
    """Distances of fingerprints to the random pivots, always the same ones: rows x pivots."""
    rng = np.random.default_rng(3)
    shape = FILTER_PIVOTS, fps.shape[1]
    pivots = rng.integers(0, 2**63, shape, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, shape, dtype=np.uint64)
    return np.stack([_popcount(fps ^ p).sum(1, dtype=np.int16) for p in pivots], axis=1)


def _prints_of(column: pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, words)


def _tabled(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Rows with their distances to the random pivots."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            table = pivot_distances(_prints_of(part.column("fp"), words))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r.tobytes() for r in table], pa.binary())], [*batch.schema.names, "distances"])


def _meet(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            keys = plan.keys(_prints_of(part.column("fp"), plan.words))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column("node").to_numpy(), keys.shape[1]))], ["key", "node"])


def _within(fps: np.ndarray, coordinates: np.ndarray, d: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` and ``b`` are within ``d`` bits: pivot distances may not differ by more; survivors are verified."""
    possible = np.ones((len(a), len(b)), dtype=bool)
    for j in range(coordinates.shape[1]):
        possible &= np.abs(coordinates[a, j][:, None] - coordinates[b, j][None, :]) <= d
    i, j = np.nonzero(possible)
    for at in range(0, len(i), 1 << 18):
        x, y = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
        possible[x, y] = _popcount(fps[a[x]] ^ fps[b[y]]).sum(1) <= d
    return possible


#: Groups of at most so many rows are compared together, pair by pair.
SMALL = 48


def _link(batches: Iterator[pa.RecordBatch], words: int, d: int) -> Iterator[pa.RecordBatch]:
    for table, cuts in whole_groups(batches, ["key", "pair"]):
        shared = np.repeat(np.diff(cuts) > 1, np.diff(cuts))
        if not shared.any():
            continue
        table, cuts = table.filter(pa.array(shared)), np.concatenate([[0], np.cumsum(np.diff(cuts)[np.diff(cuts) > 1])])
        node = table["node"].to_numpy()
        fps = _prints_of(table["fp"], words)
        distances = np.frombuffer(b"".join(table["distances"].to_pylist()), dtype=np.int16).reshape(len(node), -1)
        label = np.arange(len(node))
        i, j = small_pairs(cuts, SMALL)
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            near = np.abs(distances[x] - distances[y]).max(1) <= d
            x, y = x[near], y[near]
            near = _popcount(fps[x] ^ fps[y]).sum(1) <= d
            merge_labels(label, x[near], y[near])
        for g in np.flatnonzero(np.diff(cuts) > SMALL):
            a, b = cuts[g], cuts[g + 1]
            label[a:b] = a + link_near(partial(_within, fps[a:b], distances[a:b], d), b - a)
        u, v = star_edges(label, node)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _links(distinct: DataFrame, keys_of: Callable[[DataFrame], DataFrame], words: int, d: int) -> DataFrame:
    """Edges ``u, v`` among rows that meet by their keys and are within ``d`` bits: a star for each group that such pairs connect."""
    met = together(meetings(distinct, keys_of), distinct.select("node", "fp", "distances"))
    return met.mapInArrow(partial(_link, words=words, d=d), "u long, v long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, words: int = 1) -> DataFrame:
    """``id, fp`` (bytes, least significant first) of every row, written to the shared folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialise(rows.mapInArrow(partial(_fingerprints, k=shingle, words=words), "id long, fp binary"), "fingerprints")[0]


def near_components(prints: DataFrame, words: int, max_distance: int) -> DataFrame:
    """``fp, copies, component`` for every distinct fingerprint; component: smallest id reachable through links."""
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id())
    distinct, _ = materialise(distinct.mapInArrow(partial(_tabled, words=words), "fp binary, least long, copies long, node long, distances binary"), "nodes")
    plan = Plan(words, max_distance, None, 0)
    keys_of = lambda nodes: nodes.select("node", "fp").mapInArrow(partial(_meet, plan=plan), "key long, node long")
    roots, _ = materialise(connected_components(_links(distinct, keys_of, words, max_distance)), "roots")
    named, _ = materialise(distinct.join(roots, "node", "left").select("fp", "copies", "least", F.coalesce("root", "node").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("members"))
    least, _ = materialise(least, "least")
    return materialise(join_hot(named, least, "root", "members").select("fp", "copies", "component"), "components")[0]


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, words: int = 1, max_distance: int = 3) -> DataFrame:
    """``id, fp, component`` of every row. See the module for what links two rows."""
    prints = fingerprints(docs, id_col, text_col, shingle, words)
    return join_hot(prints, near_components(prints, words, max_distance), "fp", "copies").select("id", "fp", "component")


#: For documents: eight words of fingerprint.
NEAR_WORDS = 8
#: Standard deviations that the candidate filter leaves above the bits expected to differ.
DEVIATIONS = 4
#: Bits differ most, among sets at 0.8 or more, for four shingles of five: 3 of 16 (counted out for all sizes).
SHORT_DIFFER = 3 / 16
#: Ids that are broadcast (32 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Shingles of a block of sets that one task compares with another block.
BLOCK_SHINGLES = 2_000_000


def distance_at(similarity: float, words: int) -> int:
    """Bits by which sets of shingles of that Jaccard similarity may differ, whatever their size."""
    differ = max(differing(similarity), SHORT_DIFFER)
    n = 64 * words
    return math.ceil(n * differ + DEVIATIONS * math.sqrt(n * differ * (1 - differ)))


def _name(shingles: np.ndarray) -> int:
    """A 64-bit name of a set; with its size, fingerprint and first shingles it tells sets apart."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def _set_prints(batches: Iterator[pa.RecordBatch], k: int, words: int, similarity: float) -> Iterator[pa.RecordBatch]:
    release()
    for batch in small(batches):
        names, size, fp, heads = [], [], [], []
        for text in batch.column("text"):
            shingles = shingle_set(text.as_py(), k)
            n = len(shingles)
            # of two sets at the similarity, each shares all but this many of its shingles; one more must hold a shared one
            head = n - math.ceil(similarity * n - 1e-9) + 1 if 0 < n <= SHORT / similarity else 0
            names.append(_name(shingles))
            size.append(n)
            fp.append(set_fingerprint(shingles, words).tobytes())
            heads.append(shingles[:head].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.int64()), pa.array(size, pa.int64()), pa.array(fp, pa.binary()), pa.array(heads, pa.binary())], ["id", "name", "size", "fp", "head"])


def _meet_sets(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            long = np.flatnonzero(part.column("size").to_numpy() > SHORT)
            heads = [np.frombuffer(h, dtype=np.int64) for h in part.column("head").to_pylist()]
            keys, rows = [np.concatenate(heads)], [np.repeat(np.arange(len(heads)), [len(h) for h in heads])]
            if len(long):
                tables = plan.keys(_prints_of(part.column("fp").take(pa.array(long)), plan.words))
                keys.append(tables.ravel())
                rows.append(np.repeat(long, tables.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), part.column("node").take(pa.array(np.concatenate(rows)))], ["key", "node"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        found = [(i, s) for i, t in enumerate(batch.column("text")) if _name(s := shingle_set(t.as_py(), k)) == batch.column("name")[i].as_py()]
        rows = pa.array([i for i, _ in found], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("root").take(rows), batch.column("node").take(rows), pa.array([max(len(s), 256) for _, s in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())], ["root", "node", "weight", "shingles"])


def _alike(places: np.ndarray, cuts: np.ndarray, similarity: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which sets of ``a`` and ``b`` have that Jaccard similarity or more. Sets are runs of places among all shingles."""
    size = np.diff(cuts)
    ends = np.concatenate([[0], np.cumsum(size[b])])
    theirs = np.concatenate([places[cuts[r] : cuts[r + 1]] for r in b])
    has = np.zeros(places.max(initial=0) + 1, dtype=bool)
    out = np.zeros((len(a), len(b)), dtype=bool)
    for i, r in enumerate(a):
        mine = places[cuts[r] : cuts[r + 1]]
        has[mine] = True
        shared = np.diff(np.concatenate([[0], np.cumsum(has[theirs])])[ends])
        has[mine] = False
        out[i] = shared / np.maximum(size[r] + size[b] - shared, 1) >= similarity
    return out


def _verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for table, cuts in whole_groups(batches, ["root", "pair"]):
        nodes = table["node"].to_numpy()
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if end - start < 2:
                continue
            sets = [np.frombuffer(s, dtype=np.uint64) for s in table["shingles"].slice(start, end - start).to_pylist()]
            places = np.unique(np.concatenate(sets), return_inverse=True)[1]
            bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            u, v = star_edges(link_near(partial(_alike, places, bounds, similarity), end - start), nodes[start:end])
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def near_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """``id``: the smallest of each component under links of that Jaccard similarity of shingle sets, or more."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = rows.mapInArrow(partial(_set_prints, k=shingle, words=NEAR_WORDS, similarity=similarity), "id long, name long, size long, fp binary, head binary")
    distinct = prints.groupBy("name", "size", "fp", "head").agg(F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id())
    distinct, _ = materialise(distinct.mapInArrow(partial(_tabled, words=NEAR_WORDS), "name long, size long, fp binary, head binary, least long, node long, distances binary"), "nodes")
    d = distance_at(similarity, NEAR_WORDS)
    plan = Plan(NEAR_WORDS, d, similarity, distinct.count())
    keys_of = lambda nodes: nodes.select("node", "size", "fp", "head").mapInArrow(partial(_meet_sets, plan=plan), "key long, node long")
    groups = connected_components(_links(distinct, keys_of, NEAR_WORDS, d))
    candidates, _ = materialise(distinct.join(groups, "node").select(F.col("least").alias("id"), "name", "node", "root"), "candidates")
    wanted = F.broadcast(candidates) if candidates.count() <= BROADCAST_IDS else candidates
    sets, _ = materialise(rows.join(wanted, "id").mapInArrow(partial(_sets, k=shingle), "root long, node long, weight long, shingles binary"), "sets")
    placed = in_blocks(sets, "root", "node", "weight", BLOCK_SHINGLES)
    links = placed.repartition("root", "pair").sortWithinPartitions("root", "pair").mapInArrow(partial(_verify, similarity=similarity), "u long, v long")
    roots, _ = materialise(connected_components(links), "roots")
    named = distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return named.groupBy("root").agg(F.min("least").alias("id")).select("id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of documents that links of at least ``similarity`` (exact Jaccard of shingle sets) connect: that with the smallest id.

    A row with a null id takes part under a number that follows from its columns and is above all ids.
    """
    columns = docs.columns
    key, place = spare(columns, "near_id", "near_place")
    stand_in = F.lit(1 << 62) + F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(1 << 61))
    named = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), stand_in))
    keep = near_sets(named, key, text_col, shingle, similarity).select(F.col("id").alias(key)).distinct()
    first = Window.partitionBy(key).orderBy(*[F.col(c).cast("string") for c in columns if c != id_col])
    kept = named.join(keep, key, "left_semi")
    return kept.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).select(*columns)
