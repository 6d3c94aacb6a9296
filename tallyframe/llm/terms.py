"""Terms of many texts at once, cut byte by byte: ASCII letters (digits too, if asked for) and all characters beyond ASCII.

Every byte of a character beyond ASCII is 0x80 or more, so runs of bytes are runs of characters. Only A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are cut at once (a longer text alone).
CHUNK_BYTES = 8 << 20


def _table(digits: bool) -> np.ndarray:
    """What each byte becomes; 0 where terms end."""
    table = np.zeros(256, dtype=np.uint8)
    table[0x80:] = np.arange(0x80, 0x100)
    table[ord("a") : ord("z") + 1] = table[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    if digits:
        table[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
    return table


_TABLES = {digits: _table(digits) for digits in (False, True)}


def filled(texts: pa.Array) -> pa.Array:
    return texts.fill_null("") if texts.null_count else texts


def runs(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with at most ``size`` bytes of text and ``rows`` rows, one row at least; small batches are put together."""
    waiting: list[pa.RecordBatch] = []
    held = count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(_lengths(filled(batch.column(column))))
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = int(np.searchsorted(ends, done + size - held, "right"))
            if rows:
                to = min(to, at + rows - count)
            to = max(to, at if waiting else at + 1)
            if to > at:
                waiting.append(batch.slice(at, to - at))
                held, count = held + int(ends[to - 1]) - done, count + to - at
            if to < batch.num_rows or held >= size:
                yield _joined(waiting)
                waiting, held, count = [], 0, 0
            at = to
    if waiting:
        yield _joined(waiting)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _offsets(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    return np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def _lengths(texts: pa.Array) -> np.ndarray:
    return np.diff(_offsets(texts))


def cut(texts: pa.Array, digits: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of every term its place in the vocabulary, the vocabulary, and the row of every term, in order. A null has no terms."""
    texts = filled(texts)
    none = np.zeros(0, dtype=np.int64)
    if not len(texts):
        return none, pa.array([], pa.string()), none
    offsets = _offsets(texts)
    size = int(offsets[-1] - offsets[0])
    if not size:
        return none, pa.array([], pa.string()), none
    low = _TABLES[digits][np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    inside = low > 0
    first = np.zeros(size + 1, dtype=bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= first[1:-1] | ~inside[:-1]
    at = np.flatnonzero(begins)
    if not len(at):
        return none, pa.array([], pa.string()), none
    rows = np.searchsorted(offsets, at, "right") - 1
    ends = np.zeros(len(at) + 1, dtype=np.int64)
    kept = np.cumsum(inside, dtype=np.int64)
    ends[:-1] = kept[at] - 1
    ends[-1] = kept[-1]
    words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(low[inside])])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.string()), rows


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each comes."""
    keys = np.sort(keys)
    fresh = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[fresh], np.diff(np.append(fresh, len(keys)))
