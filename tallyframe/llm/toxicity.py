"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams (3 to 6 characters, within words and the blanks around them) that a text
holds. On a bounded sample of labelled rows each gets the log of the ratio of its smoothed shares in toxic and other texts;
those whose ratio is significant are kept, and a logistic regression is fitted to features scaled by these
ratios. A fifth of the sample is left out and calibrates the score.

Defined results: null and empty texts score as a text without any feature; rows whose label is null
teach nothing; with one class only, or none, every text gets that class's smoothed share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, held_out, indexed, memo_of, sample_of, slices, small, word_codes, WordMemo

#: Labelled rows that the classifier is fitted on at most.
SAMPLE_ROWS = 4000
ORDERS = (3, 4, 5, 6)
#: Buckets that n-grams are hashed to; all whose ratio is significant are features.
BUCKETS = 1 << 21
SMOOTHING, SIGNIFICANCE = 0.5, 3.0
#: Score from which a document counts as toxic.
THRESHOLD = 0.3
_NONE = np.zeros(0, dtype=np.int64)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of some words."""
    codes, owner = word_codes(words, 1)
    place, bucket = [], []
    for n in ORDERS:
        inside = np.zeros(len(codes), dtype=bool)
        inside[n - 1 :] = owner[n - 1 :] == owner[: len(owner) - n + 1] if len(codes) >= n else False
        place.append(owner[inside])
        bucket.append((gram_hashes(codes, n)[inside] >> np.uint64(40)).astype(np.int64) % BUCKETS)
    return np.concatenate(place), np.concatenate(bucket)


@dataclass
class Model:
    buckets: np.ndarray  # of the features, in order
    ratios: np.ndarray
    weights: np.ndarray  # already times the ratios
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    mark: str = field(default_factory=lambda: uuid.uuid4().hex)

    def words(self, words: list[str]) -> list[np.ndarray]:
        """The features of each word."""
        if not len(self.buckets):
            return [_NONE] * len(words)
        slot = self.__dict__.get("_slot")
        if slot is None:
            slot = np.full(BUCKETS, -1, dtype=np.int32)
            slot[self.buckets] = np.arange(len(self.buckets))
            self.__dict__["_slot"] = slot
        of, bucket = word_features(words)
        feature = slot[bucket]
        of, feature = of[feature >= 0], feature[feature >= 0].astype(np.int64)
        pairs = np.unique(of * len(self.buckets) + feature) if len(of) else _NONE
        out = [_NONE] * len(words)
        if len(pairs):
            of, feature = np.divmod(pairs, len(self.buckets))
            cuts = np.flatnonzero(np.diff(of, prepend=-1))
            for i, f in zip(of[cuts], np.split(feature, cuts[1:]), strict=True):
                out[i] = f
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_slot"}

    def held(self, texts: list[str], memo: WordMemo) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) pairs, each once."""
        vocabulary, at, ends = indexed([t.lower().split() for t in texts])
        if not vocabulary:
            return _NONE, _NONE
        features = memo.values(vocabulary)
        sizes = np.array([len(f) for f in features])
        marked = sizes[at] > 0
        doc = np.repeat(np.arange(len(texts)), np.diff(ends))[marked]
        doc, word = np.divmod(np.unique(doc * len(vocabulary) + at[marked]), len(vocabulary))
        if not len(doc):
            return _NONE, _NONE
        pairs = np.unique(np.repeat(doc, sizes[word]) * len(self.buckets) + np.concatenate([features[w] for w in word]))
        return np.divmod(pairs, len(self.buckets))

    def margin(self, texts: list[str], memo: WordMemo) -> np.ndarray:
        doc, feature = self.held(texts, memo)
        return self.bias + np.bincount(doc, weights=self.weights[feature], minlength=len(texts))

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -40, 40)))


def logistic(row: np.ndarray, column: np.ndarray, value: np.ndarray, shape: tuple[int, int], y: np.ndarray, l2: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on all rows of a sparse matrix."""
    w, b = np.zeros(shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        margin = np.bincount(row, weights=w[column] * value, minlength=shape[0]) + b
        error = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y
        g = np.append(np.bincount(column, weights=error[row] * value, minlength=shape[1]) / len(y) + l2 * w, error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model from (text, label) rows; every fifth row calibrates and is left out of the rest."""
    y = np.array([label for _, label in rows], dtype=np.float32)
    if len(rows) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(_NONE, np.zeros(0), np.zeros(0), float(np.log(share / (1 - share))))
    texts = [t for t, _ in rows]
    learn = np.arange(len(rows)) % 5 != 0 if len(rows) >= 50 else np.ones(len(rows), dtype=bool)
    df = np.zeros((2, BUCKETS), dtype=np.float32)
    for start, end in slices(texts, 400_000):
        docs = [t.lower().split() for t in texts[start:end]]
        vocabulary, at, ends = indexed(docs)
        if not vocabulary:
            continue
        of, bucket = word_features(vocabulary)
        order = np.argsort(of, kind="stable")
        bucket, bounds = bucket[order], np.searchsorted(of[order], np.arange(len(vocabulary) + 1))
        for j in range(end - start):
            if learn[start + j]:
                words = np.unique(at[ends[j] : ends[j + 1]])
                held = np.unique(np.concatenate([_NONE, *(bucket[bounds[w] : bounds[w + 1]] for w in words)]))
                df[int(y[start + j]), held] += 1
    n = np.array([(y[learn] == c).sum() for c in (0, 1)])
    ratio = np.log((df[1] + SMOOTHING) / (n[1] + 2 * SMOOTHING)) - np.log((df[0] + SMOOTHING) / (n[0] + 2 * SMOOTHING))
    weight = np.abs(ratio) / np.sqrt(1 / (df[1] + SMOOTHING) + 1 / (df[0] + SMOOTHING))
    kept = np.flatnonzero(weight > SIGNIFICANCE)
    model = Model(kept, ratio[kept].astype(np.float64), np.zeros(len(kept)), 0.0)
    memo, pairs = WordMemo(model.words), [(_NONE, _NONE)]
    for start, end in slices(texts, 400_000):
        doc, feature = model.held(texts[start:end], memo)
        pairs.append((start + doc, feature))
    doc, feature = (np.concatenate(x) for x in zip(*pairs, strict=True))
    place = np.cumsum(learn) - 1
    used = learn[doc]
    w, model.bias = logistic(place[doc[used]], feature[used], model.ratios[feature[used]], (int(learn.sum()), len(kept)), y[learn], l2=1e-4)
    model.weights = w * model.ratios
    check = ~learn if len(rows) >= 50 else learn
    if y[check].min() != y[check].max():
        margin = model.bias + np.bincount(doc, weights=model.weights[feature], minlength=len(rows))[check]
        every = np.arange(len(margin))
        scale, model.shift = logistic(every, np.zeros_like(every), np.clip(margin / 4, -8, 8), (len(margin), 1), y[check], l2=1e-3)
        model.scale = max(float(scale[0]) / 4, 0.05)
    return model


def _score(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    memo = memo_of(model)
    for batch in small(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        scores = [model.score(model.margin(texts[a:b], memo)) for a, b in slices(texts)]
        yield pa.RecordBatch.from_arrays([*(c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"), pa.array(np.concatenate(scores) if scores else np.zeros(0))], [*(n for n in batch.schema.names if n != "text"), "score"])


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, bound: int) -> list[tuple[str, int]]:
    """(text, label) of the rows that are not held out, ``bound`` at most, in order of id."""
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    marks = sample_of(marks.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")), bound)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(marks), "id")
    return [(r["text"], r["label"]) for r in sorted(rows.collect(), key=lambda r: (r["id"], r["label"], r["text"]))]


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    return fit(labelled(docs, labels, label_col, id_col, text_col, sample_rows))


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", scorer=_score) -> DataFrame:
    """``id, score`` of every row, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(scorer, shared=shared), f"id {rows.schema['id'].dataType.simpleString()}, score double")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    named = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col(text_col).cast("string").alias("text"))
    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    scored = named.mapInArrow(partial(_score, shared=shared), f"{fields}, score double")
    return scored.where(F.col("score") < threshold).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
