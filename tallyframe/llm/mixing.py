"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Tokens are counted by source, language and topic over all documents. Raking scales the cells in turn until each
marginal has its target shares (natural shares to a power, or given ones). A cell's documents are then kept
with probability min(1, c x wanted tokens / tokens held), with c set so that the expected tokens are the budget.
Whether a document is kept follows from a hash of its id, so reruns agree.

The cells of a source are one row of a DataFrame. A sweep scales every source to its target in the tasks and adds up
the tokens of each language and topic; these few sums (languages x topics) are scaled to their targets on the driver. The same steps run
whatever the number of cells. Where targets contradict each other (a language that only one topic has, say), raking
stops when the error no longer falls.

Tokens are the pieces that tokenizers begin with: runs of letters, of up to three digits and of other
signs, and each letter of a script that is written without blanks. A topic is a column, or the nearest of
``TOPICS`` centroids of weighed words (spherical k-means over all documents, in rounds of distributed sums).

Defined results: a null source, language or topic is a value of its own; documents without pieces have no
tokens, count for nothing and are kept where their cell has none; a document none of whose words the topics know has topic
``none``; rows with a null id are drawn by their text; repeated rows share their fate; no rows give no rows.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import join_hot
from .common import materialise, memo_of, slices, small, spare, WordMemo

#: Letters of scripts whose words are not set apart by blanks.
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
PIECE = regex.compile(rf"{UNSPACED}|(?:(?!{UNSPACED})[\p{{L}}\p{{M}}])+|\p{{N}}{{1,3}}|[^\s\p{{L}}\p{{M}}\p{{N}}]+")
_UNSPACED = regex.compile(UNSPACED)
#: Texts are measured together up to so many characters.
SLICE_CHARS = 4_000_000
#: Number of topics, and words that tell them apart.
TOPICS, TOPIC_WORDS = 8, 3000
#: Parts of unit vectors are added up in whole steps, this many to 1: sums are the same in any order.
STEPS = float(1 << 30)
#: Documents that are tried for each first centre, and documents that a pass over the vectors has in hand at a time.
SEEDS, RUN = 4, 512
#: A document's pieces and vector: a number that follows from its text, the places of its terms, how often it has them and their
#: parts of the unit vector (lists of numbers as bytes, which pass through Spark as they are). Rows are small, so batches are, too.
VECTOR = "pieces long, mark long, places binary, times binary, parts binary"
#: Sweeps at most, and the error of a marginal share at which they end.
ROUNDS, TOLERANCE = 100, 1e-6
#: Powers of the natural shares that make the default targets: 1 keeps them, 0 makes all values equal.
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.9}
#: Expected share of all tokens that is kept by default.
BUDGET = 0.8
#: Cells whose probabilities are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_CELLS = 100_000
#: Values of the factor c that one pass tries.
TRIED = 64
OUT = ("mix_source", "mix_lang", "mix_topic", "mix_tokens", "mix_probability", "mix_kept")
SIGNS = ".,;:!?\"'()[]{}«»“”‘’…-–—*_#<>/\\|+=~"


def split_words(texts: list[str]) -> pa.ListArray:
    """The lower-cased words of each text, cut at white space; a text that begins or ends with some has an empty word there."""
    return pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))


def terms(word: str) -> list[str]:
    """What a word of a text says about its topic: itself without signs around it, or its pairs of letters where a script has no blanks."""
    if not word.isascii() and _UNSPACED.search(word):
        return [word[i : i + 2] for i in range(len(word) - 1)] or [word]
    return [w] if len(w := word.strip(SIGNS)) > 2 else []


@dataclass
class Known:
    """The terms that tell topics apart; a term's place is that in the list."""

    terms: list[str]
    mark: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self) -> None:
        self.places = {t: i for i, t in enumerate(self.terms)}

    def words(self, words: list[str]) -> list[tuple[int, list[int] | None]]:
        """Number of pieces of words that are not plainly letters between signs, and the places in those whose letters are read in pairs."""
        return [(len(PIECE.findall(w)), [self.places[t] for t in terms(w) if t in self.places] if not w.isascii() and _UNSPACED.search(w) else None) for w in words]

    def told(self, texts: list[str], memo: WordMemo) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, place and number of times of each term that is known, by text and place; and the number of pieces of each text."""
        lists = split_words(texts)
        owner = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
        coded = lists.flatten().dictionary_encode()
        at, vocabulary = coded.indices.to_numpy(), coded.dictionary
        right = pc.utf8_ltrim(vocabulary, SIGNS)
        core = pc.utf8_rtrim(right, SIGNS)
        lead, trail = pc.not_equal(pc.binary_length(vocabulary), pc.binary_length(right)), pc.not_equal(pc.binary_length(right), pc.binary_length(core))
        number = (pc.add(lead.cast("int64"), trail.cast("int64")).to_numpy() + 1) * (pc.binary_length(vocabulary).to_numpy() > 0)
        place = pc.fill_null(pc.index_in(core, pa.array(self.terms, core.type)), -1).to_numpy().astype(np.int64)
        unspaced = pc.match_substring_regex(vocabulary, UNSPACED)
        odd = np.flatnonzero(pc.and_(pc.or_(pc.invert(pc.utf8_is_alpha(core)), unspaced), pc.greater(pc.binary_length(vocabulary), 0)).to_numpy(zero_copy_only=False))
        paired = {}
        for i, (n, places) in zip(odd, memo.values(vocabulary.take(pa.array(odd)).to_pylist()), strict=True):
            number[i] = n
            if places is not None:
                place[i], paired[i] = -1, places
        pieces = np.bincount(owner, weights=number[at], minlength=len(texts)).astype(np.int64)
        doc, of = owner[place[at] >= 0], place[at][place[at] >= 0]
        if paired:
            often = np.zeros(len(vocabulary), dtype=np.int64)
            often[list(paired)] = [len(x) for x in paired.values()]
            held = np.flatnonzero(often[at] > 0)
            doc = np.concatenate([doc, np.repeat(owner[held], often[at[held]])])
            of = np.concatenate([of, np.array([p for i in at[held].tolist() for p in paired[i]], dtype=np.int64)])
        return *_pairs(doc, of, len(self.terms)), pieces


@dataclass
class Topics:
    """Scores of words for each topic."""

    scores: dict[str, np.ndarray]
    n: int

    def __post_init__(self) -> None:
        self.known = Known(list(self.scores))
        self.mark, self.words = self.known.mark, self.known.words
        self.matrix = np.array(list(self.scores.values())).reshape(len(self.scores), self.n)

    def named(self, doc: np.ndarray, place: np.ndarray, times: np.ndarray, size: int) -> list[str]:
        """The topic of each of ``size`` texts with such terms."""
        if not self.n:
            return ["none"] * size
        scores = np.stack([np.bincount(doc, weights=self.matrix[place, k] * times, minlength=size) for k in range(self.n)], 1)
        return [f"t{k}" if ok else "none" for k, ok in zip(scores.argmax(1), scores.any(1), strict=True)]

    def of(self, texts: list[str], memo: WordMemo) -> tuple[list[str], list[int]]:
        """Topic and number of pieces of each text."""
        topics: list[str] = []
        pieces: list[int] = []
        for start, end in slices(texts, SLICE_CHARS):
            *found, counts = self.known.told(texts[start:end], memo)
            topics += self.named(*found, len(counts))
            pieces += counts.tolist()
        return topics, pieces


def _told(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The text of each term of some texts, the term's place among the distinct terms, and those."""
    lists = split_words(texts)
    owner = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    at, words = coded.indices.to_numpy(), coded.dictionary
    core = pc.utf8_trim(words, SIGNS)
    spelling = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], "int32"), words.cast("string")), "")[0].as_py()
    letters = [c for c in map(chr, np.flatnonzero(np.bincount(np.frombuffer(spelling.encode("utf-32-le"), np.uint32)))) if _UNSPACED.match(c)]
    paired = pc.match_substring_regex(words, "[" + "".join(f"\\x{{{ord(c):x}}}" for c in letters) + "]").to_numpy(zero_copy_only=False) if letters else np.zeros(len(words), dtype=bool)
    whole = ~paired & (pc.utf8_length(core).to_numpy() > 2)
    odd = np.flatnonzero(paired)
    parts = [terms(w) for w in words.take(pa.array(odd)).to_pylist()]
    number = whole.astype(np.int64)
    number[odd] = [len(x) for x in parts]
    spelt = pa.concat_arrays([core.filter(pa.array(whole)), pa.array([t for x in parts for t in x], core.type)]).dictionary_encode()
    of_word = np.concatenate([np.flatnonzero(whole), np.repeat(odd, number[odd])])
    codes = spelt.indices.to_numpy()[np.argsort(of_word, kind="stable")]
    n, start = number[at], (np.cumsum(number) - number)[at]
    place = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.repeat(owner, n), codes[place], spelt.dictionary


def _pairs(doc: np.ndarray, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document and code that occur together, once, and how often."""
    keys, times = np.unique(doc * size + code, return_counts=True)
    return keys // max(size, 1), keys % max(size, 1), times


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of texts: their terms, and in how many of the texts each is; the number of texts stands at null."""
    for batch in small(batches, 2048):
        every = batch.column("text").to_pylist()
        for start, end in slices(every, SLICE_CHARS):
            doc, code, known = _told(every[start:end])
            keys = np.sort(doc * max(len(known), 1) + code)
            held = np.bincount(keys[np.diff(keys, prepend=-1) > 0] % max(len(known), 1), minlength=len(known))
            for at in range(0, len(known), 10_000):
                yield pa.RecordBatch.from_arrays([known[at : at + 10_000].cast("string"), pa.array(held[at : at + 10_000], "int64")], ["term", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([None], "string"), pa.array([end - start], "int64")], ["term", "n"])


def _place_type(terms: int) -> type:
    return np.uint16 if terms <= 1 << 16 else np.uint32


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of numbers as bytes."""
    ends = np.concatenate([[0], np.cumsum(sizes) * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())])


def _read(lists: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`_lists` was given: all numbers, and how many each run has."""
    lists = lists.cast(pa.large_binary())
    ends = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1]
    size = np.dtype(kind).itemsize
    count = int(ends[-1] - ends[0]) // size
    values = np.frombuffer(lists.buffers()[2], kind, count, int(ends[0])) if count else np.zeros(0, kind)
    return values, np.diff(ends) // size


def _vectors(texts: list[str], known: Known, idf: np.ndarray, memo: WordMemo) -> Iterator[pa.StructArray]:
    """Pieces and unit vectors of texts, in runs: see ``VECTOR``; those without known terms have empty ones."""
    for start, end in slices(texts, SLICE_CHARS):
        doc, place, times, pieces = known.told(texts[start:end], memo)
        part = np.log1p(times.astype(np.float64))
        part /= np.sqrt(np.bincount(doc, weights=(part * idf[place]) ** 2, minlength=len(pieces)))[doc]
        size = np.bincount(doc, minlength=len(pieces))
        marks = b"".join(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest() for t in texts[start:end])
        lists = [_lists(x, size) for x in (place.astype(_place_type(len(known.terms))), times.astype(np.int32), part.astype(np.float32))]
        yield pa.StructArray.from_arrays([pa.array(pieces, "int64"), pa.array(np.frombuffer(marks, np.int64)), *lists], ["pieces", "mark", "places", "times", "parts"])


def _opened(batches: Iterator[pa.RecordBatch], weighed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of runs of documents (each with an entry) the number and the size of each; place and part of each entry; cosines of documents and centres."""
    kind = _place_type(weighed.shape[1])
    for batch in batches:
        for start in range(0, batch.num_rows, RUN):
            run = batch.slice(start, RUN)
            places, sizes = _read(run.column("places"), kind)
            part, place = _read(run.column("parts"), np.float32)[0], places.astype(np.intp)
            wide, shares, starts = part.astype(np.float64), np.empty(len(part)), np.cumsum(sizes) - sizes
            cosines = np.empty((len(weighed), len(sizes)))
            for row, out in zip(weighed, cosines, strict=True):
                np.take(row, place, out=shares, mode="clip")
                np.multiply(shares, wide, out=shares)
                np.add.reduceat(shares, starts, out=out)
            yield run.column("mark").to_numpy(), sizes, place, part, cosines


def _race(marks: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    """When each document comes in the race number ``k``, in which chances grow with the distances ``far``; those at a centre never do."""
    h = marks.view(np.uint64) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    time = -np.log(((h ^ (h >> np.uint64(31))) >> np.uint64(12)).astype(np.float64) / 2.0**52 + 2.0**-53)
    return np.divide(time, far, out=np.full(len(far), np.inf), where=far > 1e-9)


def _seeds(batches: Iterator[pa.RecordBatch], weighed: np.ndarray, tried: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Were each of ``tried`` a centre beside ``weighed``: the distances left (a sum in ``STEPS``), and the ``SEEDS`` documents that come first in the next race."""
    left, firsts = [0] * len(tried), [[] for _ in tried]
    for marks, sizes, place, part, cosines in _opened(batches, np.vstack([weighed, tried])):
        best, ends = cosines[: len(weighed)].max(0, initial=0), np.concatenate([[0], np.cumsum(sizes)])
        for j, cosine in enumerate(cosines[len(weighed) :]):
            far = 1 - np.maximum(best, cosine)
            left[j] += int(np.rint(far * STEPS).sum())
            time = _race(marks, far, len(weighed) + 1)
            rows = [(time[k], marks[k], place[ends[k] : ends[k + 1]].copy(), part[ends[k] : ends[k + 1]].copy()) for k in np.lexsort((marks, time))[:SEEDS] if np.isfinite(time[k])]
            firsts[j] = sorted(firsts[j] + rows, key=lambda r: r[:2])[:SEEDS]
    rows = [(j, left[j], None, None, None, None) for j in range(len(tried))] + [(j, 0, *row) for j, found in enumerate(firsts) for row in found]
    types = (pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32()))
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["at", "left", "time", "mark", "places", "parts"])


def _moved(batches: Iterator[pa.RecordBatch], weighed: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of the unit vectors (in ``STEPS``) that are nearest to each centre."""
    n, size = weighed.shape
    total = np.zeros(n * size, dtype=np.int64)
    for _, sizes, place, part, cosines in _opened(batches, weighed):
        total += np.bincount(np.repeat(cosines.argmax(0) * size, sizes) + place, weights=np.rint(part * STEPS), minlength=n * size).astype(np.int64)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, "int32"), pa.array(total[at])], ["at", "value"])


def _placed(found: pa.Table, size: int) -> np.ndarray:
    out = np.zeros(size)
    out[found.column("at").to_numpy()] = found.column("value").to_numpy()
    return out


def _drawn(rows: list, size: int) -> tuple[np.ndarray, list[list]]:
    """For each centre tried the distances left, and the documents that come first; ``rows`` are a few a task."""
    left, firsts = np.zeros(size), [[] for _ in range(size)]
    for r in rows:
        if r["time"] is None:
            left[r["at"]] += r["left"]
        else:
            firsts[r["at"]].append(r)
    return left, [sorted(f, key=lambda r: (r["time"], r["mark"]))[:SEEDS] for f in firsts]


def _worth(total: int, n: float) -> float:
    return n * np.log(total / n) ** 2


def _centred(chosen: list[str], idf: np.ndarray, n: int, rounds: int, seeds: Callable, sums: Callable) -> Topics:
    """Spherical k-means: ``seeds`` and ``sums`` put together what :func:`_seeds` and :func:`_moved` give for all vectors."""
    if not chosen:
        return Topics({}, n)
    centres, started = np.zeros((0, len(chosen))), False
    tried = np.zeros((1, len(chosen)))  # none: the first race is even
    while len(centres) < n:  # each next one is that of some drawn far from those before that leaves documents the nearest
        left, firsts = seeds(partial(_seeds, weighed=centres * idf, tried=tried * idf), len(tried))
        if started:
            centres = np.vstack([centres, tried[left.argmin()]])
        started, rows = True, firsts[left.argmin()]
        tried = np.zeros((len(rows), len(chosen))) if rows else centres[-1:].copy()  # no rows: all documents are at a centre
        for seed, row in zip(tried, rows):
            places = np.array(row["places"])
            seed[places] = np.array(row["parts"]) * idf[places]
    for _ in range(rounds):
        moved = sums(partial(_moved, weighed=centres * idf), centres.size).reshape(centres.shape) / STEPS * idf
        length = np.linalg.norm(moved, axis=1, keepdims=True)
        moved = np.divide(moved, length, out=centres.copy(), where=length > 0)
        if np.allclose(moved, centres, atol=1e-6):
            break
        centres = moved
    scores = (centres * idf).T
    return Topics({t: scores[i] for i, t in enumerate(chosen)}, n)


def fit_topics(texts: list[str], n: int = TOPICS, words: int = TOPIC_WORDS, rounds: int = 25) -> Topics:
    """What :func:`train_topics` gives for the same texts, worked out here: for few texts."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    held: Counter = Counter()
    for b in _counted(iter([batch])):
        held.update({t: k for t, k in zip(*(c.to_pylist() for c in b.columns), strict=True) if t is not None})
    total = len(texts)
    worth = {t: _worth(total, k) for t, k in held.items() if 3 <= k <= 0.4 * total}
    chosen = sorted(worth, key=lambda t: (-worth[t], t))[:words]
    known, idf = Known(chosen), np.array([np.log(total / held[t]) for t in chosen])
    found = [pa.RecordBatch.from_struct_array(v) for v in _vectors(texts, known, idf, WordMemo(known.words))]

    def vectors() -> Iterator[pa.RecordBatch]:
        return (v.filter(pc.greater(pc.binary_length(v.column("places")), 0)) for v in found)

    def seeds(step: Callable, size: int) -> tuple[np.ndarray, list[list]]:
        return _drawn([r for b in step(vectors()) for r in b.to_pylist()], size)

    def sums(step: Callable, size: int) -> np.ndarray:
        return _placed(pa.Table.from_batches(step(vectors())), size)

    return _centred(chosen, idf, n, rounds, seeds, sums)


def _telling(texts: DataFrame, words: int) -> tuple[Known, np.ndarray]:
    """The words of ``text`` that tell topics apart, and their inverse document frequencies."""
    each = texts.where("text is not null").mapInArrow(_counted, "term string, n long")
    held, _ = materialise(each.groupBy("term").agg(F.sum("n").alias("n")).where("n >= 3 or term is null"), "terms")
    total = held.where("term is null").agg(F.sum("n")).first()[0] or 0
    worth = F.col("n") * F.pow(F.log(F.lit(float(total)) / F.col("n")), F.lit(2.0))
    best = held.where(F.col("term").isNotNull() & (F.col("n") <= 0.4 * total)).repartition(16).orderBy(worth.desc(), "term").limit(words).collect() if total else []
    return Known([r["term"] for r in best]), np.array([np.log(total / r["n"]) for r in best])


def _vector(text: Column, known: Known, idf: np.ndarray) -> Column:
    """The struct ``VECTOR`` of a text."""

    def of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo, none = memo_of(known), next(_vectors([""], known, idf, WordMemo(known.words)))[:0]
        for column in columns:
            yield pa.concat_arrays([none, *(v for at in range(0, len(column), 2048) for v in _vectors(column.slice(at, 2048).to_pylist(), known, idf, memo))])

    of.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(of, VECTOR)(F.coalesce(text, F.lit("")))


def _fitted(vectors: DataFrame, known: Known, idf: np.ndarray, n: int, rounds: int) -> Topics:
    """Centres of ``mark, places, parts``; each first centre and each round of moves is a pass over these columns."""
    vectors = vectors.where("length(places) > 0").coalesce(vectors.sparkSession.sparkContext.defaultParallelism)  # each task of a pass gives sums of its own

    def seeds(step: Callable, size: int) -> tuple[np.ndarray, list[list]]:
        return _drawn(vectors.mapInArrow(step, "at int, left long, time double, mark long, places array<int>, parts array<float>").collect(), size)

    def sums(step: Callable, size: int) -> np.ndarray:
        return _placed(vectors.mapInArrow(step, "at int, value long").groupBy("at").agg(F.sum("value").alias("value")).toArrow(), size)

    return _centred(known.terms, idf, n, rounds, seeds, sums)


def train_topics(docs: DataFrame, text_col: str = "text", n: int = TOPICS, words: int = TOPIC_WORDS, rounds: int = 25) -> Topics:
    """Centroids of all documents as unit vectors of logarithmic counts times inverse document frequencies.

    Every document counts, copies as often as they come. Texts are read twice, for the words and for the vectors. The driver gets
    the chosen words and the sums of the centres.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    known, idf = _telling(texts, words)
    if not known.terms:
        return Topics({}, n)
    vectors, _ = materialise(texts.select(_vector(F.col("text"), known, idf).alias("v")).select("v.mark", "v.places", "v.parts"), "vectors")
    return _fitted(vectors, known, idf, n, rounds)


def draw(id_col: Column, text: Column, seed: int) -> Column:
    """A number from 0 to 1 that follows from the id (or, where it is null, the text)."""
    return F.pmod(F.xxhash64(F.lit(seed), F.coalesce(id_col.cast("string"), text)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each cell of a batch of sources its source's row, its language and topic, its tokens; and the sources' targets."""
    cells = batch.column("cells")
    parts = cells.flatten()
    row = np.repeat(np.arange(batch.num_rows), cells.value_lengths().to_numpy())
    return row, parts.field("lt").to_numpy(), parts.field("tokens").to_numpy().astype(np.float64), batch.column("want").to_numpy()


def _source_factor(row: np.ndarray, weighed: np.ndarray, want: np.ndarray) -> np.ndarray:
    have = np.bincount(row, weights=weighed, minlength=len(want))
    return np.divide(want, have, out=np.zeros(len(want)), where=have > 0)


def _sweep(batches: Iterator[pa.RecordBatch], w: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Tokens of each language and topic, once every source is scaled to its target."""
    total = np.zeros(len(w))
    for batch in batches:
        row, lt, held, want = _flat(batch)
        total += np.bincount(lt, weights=held * _source_factor(row, held * w[lt], want)[row], minlength=len(w))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "value"])


def _expected(batches: Iterator[pa.RecordBatch], w: np.ndarray, tried: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Expected tokens for each factor tried."""
    total = np.zeros(len(tried))
    for batch in batches:
        row, lt, held, want = _flat(batch)
        ratio = _source_factor(row, held * w[lt], want)[row] * w[lt]
        for i, c in enumerate(tried):
            total[i] += (held * np.minimum(1.0, c * ratio)).sum()
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tried), dtype=np.int32)), pa.array(total)], ["at", "value"])


def _chances(batches: Iterator[pa.RecordBatch], w: np.ndarray, c: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, lt, held, want = _flat(batch)
        ratio = _source_factor(row, held * w[lt], want)[row] * w[lt]
        p = np.where(held > 0, np.minimum(1.0, c * ratio), 1.0)
        yield pa.RecordBatch.from_arrays([batch.column("source").take(pa.array(row)), pa.array(lt), batch.column("cells").flatten().field("n"), pa.array(p)], ["source", "lt", "n", "probability"])


def _sums(sources: DataFrame, step: Callable, size: int) -> np.ndarray:
    out = np.zeros(size)
    for r in sources.mapInArrow(step, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


def _raked(held: np.ndarray, w: np.ndarray, want: list[np.ndarray]) -> np.ndarray:
    """Factors for languages x topics that give the sums ``held`` their target shares, by scaling rows and columns in turn."""
    for _ in range(200):
        before = w
        for axis, target in enumerate(want):
            have = (held * w).sum(1 - axis)
            factor = np.divide(target, have, out=np.zeros_like(target), where=have > 0)
            w = w * (factor[:, None] if axis == 0 else factor[None, :])
        if np.abs(held * (w - before)).max(initial=0) < TOLERANCE / 100:
            break
    return w


def _shares(values: list, held: np.ndarray, given: dict | None, power: float) -> np.ndarray:
    if given is not None:
        return np.array([float(given.get(v, 0.0)) for v in values])
    raised = np.where(held > 0, np.maximum(held, 1e-300) ** power, 0.0)
    return raised / (raised.sum() or 1.0)


def _source_targets(cells: DataFrame, given: dict | None, power: float) -> DataFrame:
    """``source, want`` of every source."""
    held = cells.groupBy("source").agg(F.sum("tokens").alias("held"))
    if given is not None:
        wanted = cells.sparkSession.createDataFrame([(v, float(x)) for v, x in given.items()], "named string, want double")
        return held.join(wanted, F.col("source").eqNullSafe(F.col("named")), "left").select("source", F.coalesce("want", F.lit(0.0)).alias("want"))
    raised = held.select("source", F.when(F.col("held") > 0, F.pow("held", F.lit(power))).otherwise(0.0).alias("raised"))
    norm = raised.agg(F.sum("raised")).first()[0] or 1.0
    return raised.select("source", (F.col("raised") / norm).alias("want"))


def probabilities(cells: DataFrame, targets: dict[str, dict] | None = None, powers: dict[str, float] = POWERS, budget: float = BUDGET) -> DataFrame:
    """``source, lang, topic, n, probability`` of cells ``source, lang, topic, tokens, n``."""
    spark = cells.sparkSession
    pairs = cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).collect()  # languages x topics
    langs, topics = (sorted({r[d] for r in pairs}, key=lambda v: (v is not None, v or "")) for d in ("lang", "topic"))
    held = np.zeros((len(langs), len(topics)))
    for r in pairs:
        held[langs.index(r["lang"]), topics.index(r["topic"])] = r["tokens"]
    total = held.sum()
    want = [_shares(v, held.sum(1 - i), targets and targets[d], powers[d]) for i, (v, d) in enumerate(((langs, "lang"), (topics, "topic")))]
    named = [(lang, topic, i * len(topics) + j) for i, lang in enumerate(langs) for j, topic in enumerate(topics)]
    codes = F.broadcast(spark.createDataFrame(named, "of_lang string, of_topic string, lt int"))
    coded = cells.join(codes, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("topic").eqNullSafe(F.col("of_topic"))).select("source", F.struct("lt", "tokens", "n").alias("cell"))
    wanted = _source_targets(cells, targets and targets["source"], powers["source"]).withColumnRenamed("source", "of_source")
    grouped = coded.groupBy("source").agg(F.collect_list("cell").alias("cells"))
    sources, _ = materialise(grouped.join(wanted, F.col("source").eqNullSafe(F.col("of_source"))).select("source", "want", "cells"), "sources")

    w, last, stalled = np.full(held.shape, 1 / max(total, 1.0)), np.inf, 0
    for _ in range(ROUNDS if total else 0):
        sums = _sums(sources, partial(_sweep, w=w.ravel()), held.size).reshape(held.shape)
        share = sums * w
        off = max(float(np.abs(share.sum(1 - i) - target).max(initial=0)) for i, target in enumerate(want))
        stalled = stalled + 1 if off > 0.99 * last else 0
        if off < TOLERANCE or stalled == 3:
            break
        last, w = off, _raked(sums, w, want)
    aim, low, high = budget * total, 0.0, np.inf
    for _ in range(6 if total else 0):  # each pass narrows the range of c by the number of values tried
        tried = np.linspace(low, high, TRIED) if np.isfinite(high) else max(aim, 1.0) * 2.0 ** np.arange(TRIED)
        reached = _sums(sources, partial(_expected, w=w.ravel(), tried=tried), TRIED) >= aim * (1 - 1e-12)
        first = int(reached.argmax()) if reached.any() else TRIED - 1
        low, high = float(tried[first - 1]) if first else low, float(tried[first])
    chances = sources.mapInArrow(partial(_chances, w=w.ravel(), c=high if total else 1.0), "source string, lt int, n long, probability double")
    return chances.join(codes, "lt").select("source", F.col("of_lang").alias("lang"), F.col("of_topic").alias("topic"), "n", "probability")


def _marked(docs: DataFrame, carry: list[str], names: list[str], id_col: str, text_col: str, source_col: str, lang_col: str, topic_col: str | None, topics: Topics | None, targets: dict[str, dict] | None, powers: dict[str, float], budget: float, seed: int) -> DataFrame:
    source, lang, topic, count, chance, kept = names
    text = F.col(text_col).cast("string")
    learnt = topics is None and topic_col is None
    known, idf = _telling(docs.select(text.alias("text")), TOPIC_WORDS) if learnt else (Known([]), np.zeros(0))
    model = topics or Topics({}, 0)

    def said(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = memo_of(model)
        for t in texts:
            found = model.of([x or "" for x in t], memo)
            yield pd.DataFrame({"topic": pd.Series(found[0], dtype=object), "pieces": pd.Series(found[1], dtype="int64")})

    def named(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for places, times in columns:
            (place, sizes), (often, _) = _read(places, _place_type(len(model.scores))), _read(times, np.int32)
            yield pa.array(model.named(np.repeat(np.arange(len(sizes)), sizes), place.astype(np.intp), often, len(sizes)), "string")

    said.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    named.__annotations__ = {"columns": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    number = draw(F.col(id_col), F.coalesce(text, F.lit("")), seed)
    measured, mark, places, times, parts = spare(carry + names, "measured_text", "vector_mark", "vector_places", "vector_times", "vector_parts")
    given = F.col(topic_col).cast("string") if topic_col is not None else F.lit(None).cast("string")
    # of texts whose topics are learnt the vectors are kept, and topics are read from these
    measure = _vector(text, known, idf) if learnt else F.pandas_udf(said, "topic string, pieces long")(text)
    rows = docs.select(*carry, F.col(source_col).cast("string").alias(source), F.col(lang_col).cast("string").alias(lang), given.alias(topic), measure.alias(measured), number.alias(kept))
    part = lambda n, name: F.col(f"{measured}.{n}").alias(name)
    vector = [part("mark", mark), part("places", places), part("times", times), part("parts", parts)] if learnt else []
    rows = rows.select(*carry, source, lang, topic if topic_col is not None or learnt else part("topic", topic), part("pieces", count), kept, *vector)
    rows, _ = materialise(rows, "measured")
    if learnt:
        model = _fitted(rows.select(F.col(mark).alias("mark"), F.col(places).alias("places"), F.col(parts).alias("parts")), known, idf, TOPICS, 25) if known.terms else Topics({}, TOPICS)
        rows = rows.withColumn(topic, F.arrow_udf(named, "string")(places, times)).drop(mark, places, times, parts)
    cells = rows.groupBy(F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(topic).alias("topic")).agg(F.sum(count).alias("tokens"), F.count("*").alias("n"))
    p, _ = materialise(probabilities(materialise(cells, "cells")[0], targets, powers, budget), "chances")
    (cell,) = spare(rows.columns + names, "cell_of_row")
    p = p.select(F.struct("source", "lang", "topic").alias(cell), F.col("n").alias(f"{cell}_n"), F.col("probability").alias(chance))
    keyed = rows.withColumn(cell, F.struct(F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(topic).alias("topic")))
    joined = keyed.join(F.broadcast(p), cell) if p.count() <= BROADCAST_CELLS else join_hot(keyed, p, cell, f"{cell}_n")
    return joined.select(*carry, source, lang, topic, count, chance, (F.col(kept) < F.col(chance)).alias(kept))


def mark(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic_col: str | None = None,
    topics: Topics | None = None,
    targets: dict[str, dict] | None = None,
    powers: dict[str, float] = POWERS,
    budget: float = BUDGET,
    seed: int = 42,
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns ``carry`` of ``docs`` (by default all), and those named in ``OUT`` (replaced where they exist).

    ``targets`` gives shares by value for source, lang and topic; by default natural shares to ``powers``.
    """
    carried = [c for c in (docs.columns if carry is None else carry) if c.lower() not in OUT]
    return _marked(docs, carried, list(OUT), id_col, text_col, source_col, lang_col, topic_col, topics, targets, powers, budget, seed)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic_col: str | None = None,
    topics: Topics | None = None,
    targets: dict[str, dict] | None = None,
    powers: dict[str, float] = POWERS,
    budget: float = BUDGET,
    seed: int = 42,
) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their own columns. Options as for :func:`mark`."""
    names = spare(docs.columns, *OUT)
    drawn = _marked(docs, docs.columns, names, id_col, text_col, source_col, lang_col, topic_col, topics, targets, powers, budget, seed)
    return drawn.where(F.col(names[-1])).select(*docs.columns)
