"""What the corpus operators share: scratch tables, folds, samples, word memos."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a fresh folder is made.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tallyframe-")
        _ROOTS[app] = f"{base.rstrip('/')}/tallyframe-{uuid.uuid4().hex}"
        atexit.register(_forget, spark, _ROOTS[app])
    return _ROOTS[app]


def _forget(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file systems, whatever store it is in."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def held_out(doc_id: Column) -> Column:
    """The evaluation fold: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_of(rows: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of all their columns; all rows if there are fewer."""
    total = rows.count()
    if total <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), *rows.columns), F.lit(1_000_000_000)) < int(1_000_000_000 * bound / total))


def rows_of(batch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def small(batches, rows: int = 256) -> Iterator:
    """The same rows in small record batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(at, rows)


def slices(texts: list, chars: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about so many characters in all, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > chars:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


class WordMemo:
    """Values of words, computed for many unseen words at once; two generations bound the memory."""

    def __init__(self, compute: Callable[[list[str]], list], limit: int = 60_000):
        self.compute, self.limit = compute, limit
        self.young: dict = {}
        self.old: dict = {}

    def values(self, words: list[str]) -> list:
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = [w for w in words if w not in young]
        fresh = []
        for w in new:
            if w in old:
                young[w] = old[w]
            else:
                fresh.append(w)
        if fresh:
            young.update(zip(fresh, self.compute(fresh), strict=True))
        return [young[w] for w in words]


_HELD: list = [None, None]


def held(name, make: Callable):
    """The one large object that a worker holds at a time; another name takes the place of an earlier stage's object."""
    if _HELD[0] != name:
        _HELD[:] = [None, None]
        _HELD[:] = [name, make()]
    return _HELD[1]


def release() -> None:
    """Forget what an earlier stage left in this worker."""
    _HELD[:] = [None, None]


def memo_of(model) -> WordMemo:
    """The memo of a worker for the words of a model; it lasts while tasks bring the same model."""
    memo = held(model.mark, lambda: WordMemo(model.words))
    memo.compute = model.words
    return memo


def spare(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column (in any case) has it."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def indexed(docs: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of some documents, every word's place among them, and the bounds of the documents."""
    vocabulary = list(set().union(*docs)) if docs else []
    place = dict(zip(vocabulary, range(len(vocabulary)), strict=True))
    ends = np.zeros(len(docs) + 1, dtype=np.int64)
    np.cumsum([len(d) for d in docs], out=ends[1:])
    return vocabulary, np.fromiter(map(place.__getitem__, chain.from_iterable(docs)), dtype=np.int64, count=int(ends[-1])), ends


def word_codes(words: list[str], left: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``words``, each after ``left`` blanks and before one, end to end; and the word of each."""
    pad = " " * left
    text = "".join([f"{pad}{w} " for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + left + 1 for w in words])
    return codes, owner


_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """64-bit hashes of the ``order`` code points that end at each place (places before ``order - 1`` are void)."""
    h = np.zeros(len(codes), dtype=np.uint64)
    for back in range(order):
        shifted = np.zeros_like(codes)
        shifted[back:] = codes[: max(len(codes) - back, 0)]
        h = (h + shifted + np.uint64(1)) * _STEP
        h ^= h >> np.uint64(29)
    return (h + np.uint64(order)) * _MIX


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` in a sorted array by binary search, and whether each is there."""
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return at, (sorted_keys[at] == keys) if len(sorted_keys) else np.zeros(len(keys), dtype=bool)
