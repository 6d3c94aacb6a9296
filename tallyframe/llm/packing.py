"""Vector bin packing: examples go into sequences under limits on tokens, segments and loss-bearing tokens at once.

Each task packs the rows of its partition, so nothing is shuffled. It holds a pool of pieces. Into the open sequence goes
the piece that fits with the largest dot product of its demand and what the sequence has left, both as shares of the limits
(the dot-product heuristic); where none fits whole and pieces may be cut, the head with the largest dot product fills the rest.
A partition's last sequence is cut at powers of two, which need no padding.

Defined results: a null text is an empty one; every row is an example of its own, whatever its id; an example longer than
the limits allow is cut even where examples are to stay whole; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PIECES, _WIDE, byte_alphabet
from .common import held, small

#: Pieces that a task chooses among.
POOL = 2048
PIECE = "id long, start long, length long, loss long, ids_crc32 long, n_tokens long, sequence_id long, offset long, ids binary"


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most."""

    tokens: int = 1024
    segments: int = 64
    loss: int = 1024

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits must be 1 or more")


class Tokens:
    """Ids of texts as the tokenizers library gives them.

    Texts of Latin letters go through tiktoken on the same vocabulary, four times as fast; the classes of all other
    characters depend on the Unicode version, so their texts go through the library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.fast = self._same_ranks(path)

    @staticmethod
    def _same_ranks(path: str):
        """tiktoken's encoding, where the order of merges is the order of ids, as it needs; else None."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        ranks = [vocabulary[m] for m in merged]
        if ranks != sorted(ranks) or (ranks and ranks[0] < 256):
            return None
        return tiktoken.Encoding("same", pat_str=PIECES, mergeable_ranks={bytes(letters[c] for c in t): i for t, i in vocabulary.items()}, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and not _WIDE.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


class Example:
    """The ids of an example, or those of a part of it that begins at ``at``."""

    __slots__ = ("key", "ids", "n", "at")

    def __init__(self, key, ids: np.ndarray, n: int, at: int = 0):
        self.key, self.ids, self.n, self.at = key, ids, n, at

    def head(self, start: int, length: int) -> Example:
        """What is held of it while it waits: no more than the piece."""
        return Example(self.key, self.ids[start - self.at : start - self.at + length].copy(), self.n, start)

    def spelt(self, start: int, length: int) -> bytes:
        return self.ids[start - self.at : start - self.at + length].tobytes()


class Packer:
    """The pool and the open sequence of a task. ``emit(pieces)`` gets each finished sequence as ``(example, start, length, loss)``."""

    def __init__(self, limits: Limits, cut: bool, emit, pool: int = POOL):
        self.limits, self.cut, self.emit, self.pool = limits, cut, emit, pool
        self.full = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)
        self.n = 0
        self.start, self.length, self.free = (np.zeros(2 * pool, dtype=np.int64) for _ in range(3))
        self.example: list[Example] = []

    def add(self, example: Example, n_tokens: int, loss_from: int) -> None:
        """An example; its tokens from ``loss_from`` on bear loss."""
        start = 0
        while start < n_tokens:
            free, left = max(0, loss_from - start), n_tokens - start
            length = min(left, self.limits.tokens, free + self.limits.loss)
            if length == self.limits.tokens:
                self.emit([(example, start, length, length - min(length, free))])
            else:
                self._hold(example.head(start, length), start, length, free)
            start += length

    def _hold(self, example: Example, start: int, length: int, free: int) -> None:
        if self.n == len(self.start):
            while self.n > self.pool:
                self.fill()
        i, self.n = self.n, self.n + 1
        self.start[i], self.length[i], self.free[i] = start, length, min(free, length)
        self.example.append(example)

    def _drop(self, i: int) -> None:
        self.n -= 1
        for a in (self.start, self.length, self.free):
            a[i] = a[self.n]
        self.example[i] = self.example[self.n]
        self.example.pop()

    def _best(self, take: np.ndarray, room: np.ndarray) -> int:
        """The piece of which ``take`` tokens (0: none) have the largest dot product with the room, of equals the longest; -1 if there is none."""
        loss = take - np.minimum(take, self.free[: self.n])
        score = take * (room[0] / self.full[0] ** 2) + loss * (room[2] / self.full[2] ** 2) + room[1] / self.full[1] ** 2
        score += 1e-9 * self.length[: self.n] / (1 + self.length[: self.n])  # of equals the longest
        score[take == 0] = -1
        i = int(score.argmax())
        return i if score[i] >= 0 else -1

    def fill(self) -> list:
        """Fill and emit one sequence."""
        room, placed = self.full.copy(), []
        while self.n and room[0] >= 1 and room[1] >= 1:
            length, free = self.length[: self.n], self.free[: self.n]
            whole = (length <= room[0]) & (length - free <= room[2])
            take = np.where(whole, length, 0)
            i = self._best(take, room)
            if i < 0 and self.cut:
                take = np.minimum(free + int(room[2]), int(room[0]))
                i = self._best(take, room)
            if i < 0:
                break
            k = int(take[i])
            loss = k - min(k, int(free[i]))
            placed.append((self.example[i], int(self.start[i]), k, loss))
            room -= (k, 1, loss)
            if k == length[i]:
                self._drop(i)
            else:
                self.start[i] += k
                self.length[i] -= k
                self.free[i] = max(0, self.free[i] - k)
        last = self.cut and not self.n and sum(p[2] for p in placed) < self.limits.tokens
        for part in _powers(placed) if last else [placed]:
            self.emit(part)
        return placed

    def close(self) -> None:
        while self.n:
            self.fill()


def _powers(placed: list) -> Iterator[list]:
    """A sequence cut into ones whose sizes are powers of two, largest first."""
    left = sum(p[2] for p in placed)
    rest, part = list(reversed(placed)), []
    while left:
        want = 1 << (left.bit_length() - 1)
        left -= want
        while want:
            example, start, length, loss = rest.pop()
            k = min(length, want)
            mine = max(0, loss - (length - k))
            part.append((example, start, k, mine))
            if k < length:
                rest.append((example, start + k, length - k, loss - mine))
            want -= k
        yield part
        part = []


def _packed(batches: Iterator[pa.RecordBatch], path: str, names: list[str], bears: list[bool], limits: Limits, cut: bool, end_id: int | None, with_ids: bool) -> Iterator[pa.RecordBatch]:
    tokens = held(("tokens", path), lambda: Tokens(path))
    base = TaskContext.get().partitionId() << 40
    end = np.array([] if end_id is None else [end_id], dtype=np.uint32)
    rows: list[tuple] = []
    done = 0

    def emit(pieces: list) -> None:
        nonlocal done
        offset = 0
        for example, start, length, loss in pieces:
            spelt = example.spelt(start, length)
            rows.append((example.key, start, length, loss, zlib.crc32(spelt), example.n, base + done, offset, spelt if with_ids else None))
            offset += length
        done += 1

    def flush() -> pa.RecordBatch:
        types = (*[pa.int64()] * 8, pa.binary())
        columns = list(zip(*rows, strict=True)) or [[]] * 9
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "start", "length", "loss", "ids_crc32", "n_tokens", "sequence_id", "offset", "ids"])

    packer = Packer(limits, cut, emit)
    for batch in small(batches):
        ids = batch.column("id").to_pylist()
        texts = [batch.column(n).to_pylist() for n in names]
        for i, key in enumerate(ids):
            parts = [tokens.encode(t[i] or "") for t in texts]
            whole = np.concatenate([*parts, end]).astype("<u4")
            lead = sum(len(p) for p, b in zip(parts, bears, strict=True) if not b)
            packer.add(Example(key, whole, len(whole)), len(whole), lead)
            if len(rows) >= 8192:
                yield flush()
    packer.close()
    yield flush()


def pack(rows: DataFrame, path: str, id_col: str = "doc_id", parts: list[tuple[str, bool]] = (("text", True),), limits: Limits = Limits(), cut: bool = True, end_id: int | None = 0, with_ids: bool = False) -> DataFrame:
    """A row a piece: ``id, start, length, loss, ids_crc32, n_tokens, sequence_id, offset, ids`` (the last only if asked for).

    ``parts``: the text columns that make up an example, and whether their tokens bear loss; those that do come last (a prompt
    without, its response with). ``end_id`` ends every example and bears loss with its last part; None: no such id.
    ``cut``: pieces may be cut to fill sequences. ``path``: the vocabulary file, on each executor at the same place.
    """
    names, bears = [p[0] for p in parts], [bool(p[1]) for p in parts]
    if not names or sorted(bears) != bears:
        raise ValueError("parts that bear loss come after those that do not")
    texts = [F.col(n).cast("string").alias(f"part{i}") for i, n in enumerate(names)]
    shown = rows.select(F.col(id_col).cast("long").alias("id"), *texts)
    return shown.mapInArrow(partial(_packed, path=path, names=[f"part{i}" for i in range(len(names))], bears=bears, limits=limits, cut=cut, end_id=end_id, with_ids=with_ids), PIECE)


def sequences(pieces: DataFrame, limits: Limits = Limits(), pad_id: int = 0) -> DataFrame:
    """``sequence_id, n_tokens, ids``: whole sequences of pieces packed ``with_ids``, padded to the limit but where their size is a power of two.

    A sequence has ``limits.segments`` pieces at most, so its group is bounded.
    """
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    spelt = F.concat_ws("", F.transform("p", lambda x: F.hex(x["ids"])))
    pad = F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), limits.tokens - F.col("n_tokens").cast("int"))
    exact = F.bit_count("n_tokens") == 1
    return joined.select("sequence_id", "n_tokens", F.unhex(F.when(exact, spelt).otherwise(F.concat(spelt, pad))).alias("ids"))
