"""Exact deduplication by Patricia tries that own partitions of length and content hash.

Each input partition first inserts its texts into compressed radix tries of its own, so copies of
a text leave it as one row. Rows then go to the owner of their length and content hash, ordered by
both; the owner inserts the full byte strings into a trie for a range of lengths and hashes, whose terminal nodes keep
the smallest and largest identifier and the number of rows. As rows come in order, a finished
subtree is never met again: it is spilled (emitted) as soon as the trie is over its memory bound.

Defined results: a null text counts as empty; a null id never wins against another id, and a group
that has only null ids keeps none; repeated ids count as rows, and the rows with the winning id all
count as kept; no rows give no rows; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buckets import join_hot
from .common import materialise, spare

#: Bytes of distinct texts that a trie may hold before its finished subtrees are spilled.
TRIE_BYTES = 24 << 20

OWNED = "digest binary, length long, min_id long, max_id long, n_rows long"


class Node:
    """A node of a compressed radix trie over byte strings: its edge label, children by first byte, and what ends here."""

    __slots__ = ("label", "children", "ends")

    def __init__(self, label: bytes, ends: list | None = None):
        self.label, self.ends = label, ends
        self.children: dict[int, Node] = {}


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by doubling and halving slices."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """Byte strings with the smallest and largest identifier and the number of rows of each."""

    def __init__(self):
        self.root, self.bytes = Node(b""), 0

    def insert(self, text: bytes, low: int | None, high: int | None, count: int) -> list:
        node, rest = self.root, text
        while True:
            if not rest:
                if node.ends is None:
                    node.ends = [None, None, 0]
                    self.bytes += 200
                return _merge(node.ends, low, high, count)
            child = node.children.get(rest[0])
            if child is None:
                child = node.children[rest[0]] = Node(rest, [None, None, 0])
                self.bytes += len(rest) + 300
                return _merge(child.ends, low, high, count)
            shared = _common(child.label, rest)
            if shared < len(child.label):
                upper = Node(child.label[:shared])
                child.label = child.label[shared:]
                upper.children[child.label[0]] = child
                node.children[rest[0]] = upper
                self.bytes += 300
                child = upper
            node, rest = child, rest[shared:]

    def items(self) -> Iterator[tuple[bytes, list]]:
        stack = [(self.root, b"")]
        while stack:
            node, prefix = stack.pop()
            whole = prefix + node.label
            if node.ends is not None:
                yield whole, node.ends
            stack.extend((c, whole) for c in node.children.values())


def _merge(ends: list, low: int | None, high: int | None, count: int) -> list:
    if low is not None and (ends[0] is None or low < ends[0]):
        ends[0] = low
    if high is not None and (ends[1] is None or high > ends[1]):
        ends[1] = high
    ends[2] += count
    return ends


def _pre_aggregate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The copies that a partition holds become one row; over the memory bound, tries are emitted and begun anew."""
    tries: dict[int, PatriciaTrie] = {}
    held = 0
    for batch in batches:
        ids, texts = batch.column("id").to_pylist(), batch.column("text")
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            trie = tries.get(len(text))
            if trie is None:
                trie = tries[len(text)] = PatriciaTrie()
            before = trie.bytes
            trie.insert(text, ids[i], ids[i], 1)
            held += trie.bytes - before
            if held > TRIE_BYTES:
                yield from _emit_partial(tries)
                tries, held = {}, 0
    yield from _emit_partial(tries)


def _emit_partial(tries: dict[int, PatriciaTrie]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for trie in tries.values():
        for text, ends in trie.items():
            rows.append((text, *ends))
            size += len(text)
            if size > 4 << 20:
                yield _partial_batch(rows)
                rows, size = [], 0
    if rows:
        yield _partial_batch(rows)


def _partial_batch(rows: list[tuple]) -> pa.RecordBatch:
    text, low, high, count = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(text, pa.binary()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(count, pa.int64())], ["text", "min_id", "max_id", "n_rows"])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Final tries of an owner. Rows come ordered by length and digest; a group is finished when the digest moves on."""
    trie, subtree, held = PatriciaTrie(), [], 0
    last, open_digest = None, None
    ready: list[tuple] = []
    for batch in batches:
        texts = batch.column("text")
        rest = zip(*(batch.column(n).to_pylist() for n in ("digest", "length", "min_id", "max_id", "n_rows")), strict=True)
        for i, (digest, length, low, high, count) in enumerate(rest):
            if digest != open_digest and trie.bytes > TRIE_BYTES:
                ready += _finished(subtree)
                trie, subtree = PatriciaTrie(), []
            open_digest = digest
            ends = trie.insert(texts[i].as_py(), low, high, count)
            if ends is not last:
                subtree.append((digest, length, ends))
                last = ends
        if len(ready) > 5000:
            yield _owned_batch(ready)
            ready = []
    ready += _finished(subtree)
    if ready:
        yield _owned_batch(ready)


def _finished(subtree: list[tuple]) -> list[tuple]:
    """Terminal nodes, each once; two texts under one digest would make the digest useless as a name, so that is an error."""
    found = {}
    for digest, length, ends in subtree:
        if found.setdefault((digest, length), ends) is not ends:
            raise ValueError("two texts of one length share a SHA-256 digest")
    return [(d, n, *e) for (d, n), e in found.items()]


def _owned_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["digest", "length", "min_id", "max_id", "n_rows"])


def text_bytes(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def _digest(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct text: ``digest, length, min_id, max_id, n_rows``."""
    data = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(F.col(text_col)).alias("text"))
    partial = data.mapInArrow(_pre_aggregate, "text binary, min_id long, max_id long, n_rows long")
    keyed = partial.select(_digest(F.col("text")).alias("digest"), F.length("text").cast("long").alias("length"), "text", "min_id", "max_id", "n_rows")
    return keyed.repartition("length", "digest").sortWithinPartitions("length", "digest").mapInArrow(_own, OWNED)


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` (replaced where they exist).

    ``keep`` names the row of a group that stays: that with the ``largest`` or ``smallest`` id.
    """
    winner = {"largest": "max_id", "smallest": "min_id"}[keep]
    digest, kept, size = spare(docs.columns, "digest_of_text", "id_of_kept", "rows_of_text")
    owned, _ = materialise(groups(docs, id_col, text_col).select(F.col("digest").alias(digest), F.col(winner).alias(kept), F.col("n_rows").alias(size)), "owners")
    own = [c for c in docs.columns if c.lower() not in ("keep_id", "group_size", "kept", "text_sha256")]
    marked = join_hot(docs.select(*docs.columns, _digest(text_bytes(F.col(text_col))).alias(digest)), owned, digest, size)
    return marked.select(
        *own,
        F.col(kept).alias("keep_id"),
        F.col(size).alias("group_size"),
        F.coalesce(F.col(id_col) == F.col(kept), F.lit(False)).alias("kept"),
        F.lower(F.hex(digest)).alias("text_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with their own columns.

    Where repeated rows share the winning id, one of them stays; a group without any id keeps one row.
    Rows meet their winner by text and id together, so copies of a text do not meet in one task.
    """
    columns = docs.columns
    digest, name, place = spare(columns, "digest_of_text", "name_of_row", "place_of_row")
    winner = {"largest": "max_id", "smallest": "min_id"}[keep]
    named = lambda c: F.coalesce(c.cast("long").cast("string"), F.lit("null"))
    owned, _ = materialise(groups(docs, id_col, text_col).select(F.col("digest").alias(digest), named(F.col(winner)).alias(name)), "owners")
    rows = docs.select(*columns, _digest(text_bytes(F.col(text_col))).alias(digest), named(F.col(id_col)).alias(name))
    first = Window.partitionBy(digest, name).orderBy(*[F.col(c).cast("string") for c in columns if c not in (text_col, id_col)])
    return rows.join(owned, [digest, name], "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).select(*columns)
