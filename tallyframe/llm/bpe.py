"""Byte-level BPE as a streaming transducer of bounded lookahead, and its decoder as a state machine.

The merge list alone tells how far ahead of a token its merges can still be changed by what follows
(:func:`sufficient_lookahead`). The transducer reads a piece into a window of twice that and a token's
length, merges within the window, emits the tokens that end a lookahead or more before its end (they
are stable), and slides on from the last of them; what is left when the piece ends is emitted as it
is. So memory is constant however long a piece is, and a piece that fits in a window takes one.
Windows of many pieces are merged at once by numpy, and the ids of short pieces are remembered.

Decoding appends the bytes of each token to a UTF-8 state machine that holds at most three bytes;
ill-formed sequences become U+FFFD as the library's decoder makes them.

Defined results: a null text is an empty one; special tokens' strings in a text become their ids,
as the library does by default.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import math
import re
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, held, slices, small

#: How the byte-level pre-tokeniser cuts a text (fixed by the tokenizer's format).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts without the characters of ``_WIDE``, where ranges say what the classes say; twice as fast.
_LATIN = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
PLAIN_PIECES = re.compile(rf" ?[{_LATIN}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")
_WIDE = re.compile("[\x1c-\x1f\x85\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")
#: Characters of text that are cut into pieces at once.
CHUNK = 1 << 16
#: Pieces that a worker remembers in each of two generations.
WORDS = 80_000
#: Rank of a pair that never merges.
NEVER = 2**31 - 1


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after which a token can no longer change, whatever follows.

    Worlds with and without further input differ from some place on. The place moves left only by a merge (c, d)
    across it which one world can do and the other cannot: d begins where, at an earlier merge (a, b), a began,
    so a is a prefix of d and (c, d) comes later in the list. It moves by the length of c. The longest such
    chain bounds how far the difference reaches.
    """
    reach: dict[bytes, int] = {}
    longest = 0
    for c, d in merges:
        far = len(c) + max((reach.get(d[:n], 0) for n in range(1, len(d) + 1)), default=0)
        if far > reach.get(c, 0):
            reach[c] = far
            longest = max(longest, far)
    return longest


class Encoder:
    """The transducer of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = [b""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        merges = [tuple(map(raw, m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
        self.lookahead = sufficient_lookahead(merges)
        self.rank = {(self.ids[a], self.ids[b]): r for r, (a, b) in enumerate(merges)}
        self.longest = max(map(len, self.ids))
        self.window = 2 * self.lookahead + self.longest
        self.lengths = np.array([len(x) for x in self.bytes_of], dtype=np.int64)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.spelling = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.start = np.array([self.ids[bytes((b,))] for b in range(256)], dtype=np.int64)
        self.made = np.array([self.ids[a + b] for a, b in merges], dtype=np.int64)
        self.size = len(self.bytes_of)
        self._hash_ranks()
        self.pieces = regex.compile(PIECES)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = WordMemo(self._pieces, WORDS)

    def _hash_ranks(self) -> None:
        """Ranks of pairs in a table with open addressing, an eighth full at most."""
        self.bits = max(4, math.ceil(math.log2(8 * len(self.rank) + 8)))
        self.slot_key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.slot_rank = np.full(1 << self.bits, NEVER, dtype=np.int32)
        for (a, b), r in self.rank.items():
            key = a * self.size + b
            at = int(self._slots(np.array([key]))[0])
            while self.slot_key[at] >= 0:
                at = (at + 1) % (1 << self.bits)
            self.slot_key[at], self.slot_rank[at] = key, r

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of ids; ``NEVER`` where there is none (or an id is -1)."""
        keys = np.where((a < 0) | (b < 0), -2, a * self.size + b)
        at = self._slots(keys)
        held = self.slot_key[at]
        out = np.where(held == keys, self.slot_rank[at], NEVER)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % (1 << self.bits)
            held = self.slot_key[at[open_]]
            found = held == keys[open_]
            out[open_[found]] = self.slot_rank[at[open_[found]]]
            open_ = open_[~found & (held >= 0)]
        return out

    def merge(self, windows: list[bytes]) -> list[np.ndarray]:
        """Ids of each window: in every round each window does its first merge of lowest rank."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(windows)
        order = sorted(range(len(windows)), key=lambda i: len(windows[i]))
        at = 0
        while at < len(order):
            n = 1
            width = max(8, len(windows[order[at]]) * 5 // 4)
            while at + n < len(order) and len(windows[order[at + n]]) <= width and n * width < 1 << 18:
                n += 1
            rows = order[at : at + n]
            for i, ids in zip(rows, self._merge([windows[i] for i in rows]), strict=True):
                out[i] = ids
            at += n
        return out

    def _merge(self, windows: list[bytes]) -> list[np.ndarray]:
        sizes = np.array([len(w) for w in windows])
        width = max(1, int(sizes.max()))
        here = np.arange(width)
        ids = np.full((len(windows), width), -1, dtype=np.int64)
        ids[here < sizes[:, None]] = self.start[np.frombuffer(b"".join(windows), dtype=np.uint8)]
        done = [np.zeros(0, dtype=np.int64)] * len(windows)
        rank = np.full((len(windows), width), NEVER, dtype=np.int32)
        rank[:, :-1] = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(windows), -1)
        name = np.arange(len(windows))
        while len(name):
            row = np.arange(len(name))
            j = rank.argmin(1)
            best = rank[row, j]
            over = best == NEVER
            if over.any():
                for i in np.flatnonzero(over):
                    done[name[i]] = ids[i, : sizes[i]]
                keep = ~over
                name, ids, rank, sizes, j, best = name[keep], ids[keep], rank[keep], sizes[keep], j[keep], best[keep]
                if not len(name):
                    break
                row = np.arange(len(name))
            width = int(sizes.max())
            after = np.minimum(here[: width - 1] + (here[: width - 1] > j[:, None]), width - 1)
            ids = np.take_along_axis(ids[:, :width], after, 1)
            rank = np.take_along_axis(rank[:, :width], np.minimum(here[: width - 1] + (here[: width - 1] >= j[:, None]), width - 1), 1)
            sizes = sizes - 1
            ids[row, j] = self.made[best]
            short = sizes < width - 1
            ids[short, sizes[short]] = -1
            right = np.where(j + 1 < sizes, ids[row, np.minimum(j + 1, width - 2)], -1)
            rank[row, j] = self.ranks(ids[row, j], right)
            left = np.flatnonzero(j > 0)
            rank[left, j[left] - 1] = self.ranks(ids[left, j[left] - 1], ids[left, j[left]])
        return done

    def stream(self, blocks: Iterable[bytes]) -> Iterator[np.ndarray]:
        """Ids of one piece that comes in blocks of bytes, as soon as they are stable."""
        held = bytearray()
        for block in blocks:
            for at in range(0, len(block), self.window):
                held += block[at : at + self.window]
                while len(held) >= self.window:
                    ids = self.merge([bytes(held[: self.window])])[0]
                    ends = np.cumsum(self.lengths[ids])
                    n = int(np.searchsorted(ends, self.window - self.lookahead, "right"))
                    yield ids[:n]
                    del held[: int(ends[n - 1])]
        if held:
            yield self.merge([bytes(held)])[0]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        out = [b""] * len(data)
        small = [i for i, d in enumerate(data) if len(d) < self.window]
        for i, ids in zip(small, self.merge([data[i] for i in small]), strict=True):
            out[i] = ids.astype("<u4").tobytes()
        for i, d in enumerate(data):
            if len(d) >= self.window:
                out[i] = b"".join(x.astype("<u4").tobytes() for x in self.stream([d]))
        return out

    def cut(self, text: str) -> list[str]:
        return self.pieces.findall(text) if _WIDE.search(text) else PLAIN_PIECES.findall(text)

    def encode(self, text: str | None) -> Iterator[bytes]:
        """Runs of ids, little-endian and 32 bits each, in order."""
        return iter(self.encode_many([text])[0])

    def encode_many(self, texts: list[str | None]) -> list[list[bytes]]:
        """Runs of ids of several texts; new pieces of all of them are merged together."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[list, int, list[str]]] = []
        size = 0

        def settle() -> None:
            vocabulary = list(set().union(*(w for _, _, w in waiting)))
            known = dict(zip(vocabulary, self.words.values(vocabulary), strict=True)).__getitem__
            for runs, place, words in waiting:
                runs[place] = b"".join(map(known, words))
            waiting.clear()

        for i, text in enumerate(texts):
            for part, special in self._ordinary(text or ""):
                if special is not None:
                    out[i].append(np.array([special], dtype="<u4").tobytes())
                    continue
                for chunk in _chunks(part):
                    waiting.append((out[i], len(out[i]), self.cut(chunk)))
                    out[i].append(b"")
                    size += len(chunk)
                    if size > 16 * CHUNK:
                        settle()
                        size = 0
        if waiting:
            settle()
        return out

    def _ordinary(self, text: str) -> Iterator[tuple[str, int | None]]:
        at = 0
        for m in self.specials.finditer(text) if self.specials else ():
            yield text[at : m.start()], None
            yield "", self.special[m.group()]
            at = m.end()
        yield text[at:], None

    def decode(self, runs: Iterable[bytes], run: int = 8192) -> Iterator[str]:
        """Text of runs of ids, as it becomes known."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in runs:
            values = np.frombuffer(ids, dtype="<u4")
            for at in range(0, len(values), run):
                part = values[at : at + run]
                n = self.lengths[part]
                yield machine.decode(self.spelling[np.repeat(self.begin[part] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))].tobytes())
        yield machine.decode(b"", True)


def _chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Parts of a text that are cut into pieces alike apart or together: each begins at a blank after a non-blank."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while True:
            cut = text.find(" ", cut)
            if cut < 0:
                break
            if not text[cut - 1].isspace():
                break
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def encoder(path: str) -> Encoder:
    """A worker's encoder of a vocabulary file."""
    return held(("vocabulary", path), lambda: Encoder(path))


def _round_trip(batches: Iterator[pa.RecordBatch], path: str, ids: bool) -> Iterator[pa.RecordBatch]:
    bpe = encoder(path)
    for batch in small(batches):
        texts, rows = [x or "" for x in batch.column("text").to_pylist()], []
        for start, end in slices(texts, 8 * CHUNK):
            for runs in bpe.encode_many(texts[start:end]):
                said, spelt, n = hashlib.sha256(), hashlib.sha256(), 0
                for r in runs:
                    said.update(r)
                    n += len(r) // 4
                for part in bpe.decode(runs):
                    spelt.update(part.encode("utf-8", "surrogatepass"))
                rows.append((n, said.hexdigest(), spelt.hexdigest(), b"".join(runs) if ids else None))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        types = (pa.int64(), pa.string(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256, ids`` of every row; ``ids`` (little-endian) only if asked for.

    ``path`` is the vocabulary file, on each executor at the same place.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_round_trip, path=path, ids=with_ids), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")
