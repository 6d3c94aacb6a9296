"""Language identification by interpolated Kneser-Ney character models.

One model a language, over the characters of words with the blanks around them, fitted on a bounded
sample of labelled documents. A model is sorted arrays: hashes of its n-grams with their interpolated
log-probabilities, and hashes of its contexts with their back-off weights; lookups are binary
searches. A text goes to the language of the lowest cross-entropy a character. The posterior is
sharpened and the entropy above which a text is rejected is set on documents that were
left out of the counts.

Defined results: a null text, or one without any letter, is ``und`` with score 0; if there is
nothing to learn from every text is ``und``; ties go to the language first in order of name.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import find, gram_hashes, held_out, indexed, memo_of, slices, small, WordMemo

#: Documents of each language that its model is fitted on at most.
SAMPLE_DOCS = 1000
#: Longest n-gram and absolute discount.
ORDER, DISCOUNT = 5, 0.75
#: Characters of a word that are hashed at once. Longer words come in parts that begin with the characters before them, so that nothing changes.
LONG_WORD = 1000
UNKNOWN = "und"


@dataclass
class KneserNey:
    """One language's model: for each order sorted hashes of n-grams and contexts, with log-probabilities and back-off weights."""

    grams: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    floor: float = -12.0

    @classmethod
    def fit(cls, words: Counter, alphabet: int) -> KneserNey:
        parts = [(p, n) for w, n in words.items() for p in _parts(w)]
        codes, owner = _codes([p for p, _ in parts])
        count = np.array([n for _, n in parts], dtype=np.float64)[owner]
        inside = _inside(owner, ORDER - 1)
        hashes = [gram_hashes(codes, k) for k in range(1, ORDER + 1)]
        contexts = [np.zeros_like(codes)] + [np.roll(hashes[k - 1], 1) for k in range(1, ORDER)]
        model = cls(floor=-np.log(alphabet))
        counts: list[np.ndarray] = [None] * ORDER
        unique: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(ORDER):
            keys, at, inverse = np.unique(hashes[k][inside], return_index=True, return_inverse=True)
            unique.append((keys, np.flatnonzero(inside)[at]))
            if k == ORDER - 1:
                counts[k] = np.bincount(inverse, weights=count[inside], minlength=len(keys))
        for k in range(ORDER - 1):  # below the longest, in how many ways an n-gram is continued to the left
            keys = unique[k][0]
            counts[k] = np.bincount(np.searchsorted(keys, hashes[k][unique[k + 1][1]]), minlength=len(keys)).astype(np.float64)
        lower = np.full(1, 1.0 / alphabet)
        for k in range(ORDER):
            keys, place = unique[k]
            ctx, back = np.unique(contexts[k][place], return_inverse=True)
            total = np.bincount(back, weights=counts[k], minlength=len(ctx))
            kinds = np.bincount(back, minlength=len(ctx))
            weight = DISCOUNT * kinds / total
            below = lower[np.searchsorted(unique[k - 1][0], hashes[k - 1][place])] if k else lower[0]
            p = np.maximum(counts[k] - DISCOUNT, 0) / total[back] + weight[back] * below
            model.grams.append(keys)
            model.values.append(np.log(p))
            model.contexts.append(ctx)
            model.weights.append(np.log(weight))
            lower = p
        return model

    def log_probability(self, hashes: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Of each place, whose n-gram and context hashes are given by order."""
        n = len(hashes[0])
        out, open_ = np.full(n, self.floor), np.arange(n)
        owed = np.zeros(n)
        for k in reversed(range(ORDER)):
            at, there = find(self.grams[k], hashes[k][open_])
            out[open_[there]] = owed[open_[there]] + self.values[k][at[there]]
            open_ = open_[~there]
            if not len(open_):
                break
            at, known = find(self.contexts[k], contexts[k][open_])
            owed[open_[known]] += self.weights[k][at[known]]
            out[open_] = self.floor + owed[open_]
        return out


def _parts(word: str) -> list[str]:
    """A word with the blanks around it, in parts that begin with the ``ORDER - 1`` characters before what they predict."""
    padded = " " * (ORDER - 1) + word + " "
    return [padded[i : i + LONG_WORD + ORDER - 1] for i in range(0, len(word) + 1, LONG_WORD)]


def _codes(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the parts end to end, and the part of each."""
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    return codes, np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def _inside(owner: np.ndarray, left: int) -> np.ndarray:
    """Places that are predicted: all but the first ``left`` of each part."""
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    inside = np.ones(len(owner), dtype=bool)
    for i in range(left):
        inside[first + i] = False
    return inside


@dataclass
class Model:
    languages: list[str]
    models: list[KneserNey]
    sharpness: float = 1.0
    reject_above: float = float("inf")
    mark: str = field(default_factory=lambda: uuid.uuid4().hex)

    def words(self, words: list[str]) -> list[np.ndarray]:
        """For each word its log-probability in every language, and the number of predicted characters."""
        cut = [_parts(w) for w in words]
        parts = [p for c in cut for p in c]
        codes, owner = _codes(parts)
        inside = np.flatnonzero(_inside(owner, ORDER - 1))
        every = [gram_hashes(codes, k) for k in range(1, ORDER + 1)]
        longest, at, back = np.unique(every[-1][inside], return_index=True, return_inverse=True)
        place = inside[at]
        hashes = [h[place] for h in every]
        contexts = [np.zeros(len(place), dtype=np.uint64)] + [every[k - 1][place - 1] for k in range(1, ORDER)]
        sums = np.empty((len(parts), len(self.models) + 1))
        for j, m in enumerate(self.models):
            sums[:, j] = np.bincount(owner[inside], weights=m.log_probability(hashes, contexts)[back], minlength=len(parts))
        sums[:, -1] = np.bincount(owner[inside], minlength=len(parts))
        if len(parts) != len(words):
            of = np.repeat(np.arange(len(words)), [len(c) for c in cut])
            sums = np.stack([np.bincount(of, weights=sums[:, j], minlength=len(words)) for j in range(sums.shape[1])], axis=1)
        return list(sums)

    def entropies(self, texts: list[str], memo: WordMemo) -> np.ndarray:
        """Cross-entropy a character of each text in each language; not a number where a text has no word."""
        vocabulary, at, ends = indexed([t.split() for t in texts])
        out = np.full((len(texts), len(self.models)), np.nan)
        if vocabulary:
            table = np.array(memo.values(vocabulary))
            for j in range(len(texts)):
                total = table[at[ends[j] : ends[j + 1]]].sum(0)
                if total[-1]:
                    out[j] = -total[:-1] / total[-1]
        return out

    def posterior(self, entropies: np.ndarray) -> np.ndarray:
        z = -self.sharpness * (entropies - entropies.min(1, keepdims=True))
        e = np.exp(z)
        return e / e.sum(1, keepdims=True)


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model from (text, language) rows; every fifth row calibrates and is left out of the counts."""
    languages = sorted({lang for _, lang in rows})
    counts = {lang: Counter() for lang in languages}
    learn = [r for i, r in enumerate(rows) if i % 5] if len(rows) >= 50 else rows
    check = rows[::5] if len(rows) >= 50 else rows
    for text, lang in learn:
        counts[lang].update(text.split())
    alphabet = len(set().union(*(set(w) for c in counts.values() for w in c))) + 2
    blank = Counter({"": 1})
    model = Model(languages, [KneserNey.fit(counts[lang] or blank, alphabet) for lang in languages])
    if len(languages) > 1:
        memo = WordMemo(model.words)
        h = model.entropies([t for t, _ in check], memo)
        fine = ~np.isnan(h[:, 0])
        truth = np.array([languages.index(lang) for _, lang in check])[fine]
        h = h[fine]
        if len(h):
            losses = []
            for sharpness in (grid := np.geomspace(0.5, 60, 25)):
                model.sharpness = float(sharpness)
                losses.append(-np.log(model.posterior(h)[np.arange(len(h)), truth] + 1e-6).mean())
            model.sharpness = float(grid[int(np.argmin(losses))])
            model.reject_above = float(np.quantile(h.min(1), 0.995)) + 0.5
    return model


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _predict(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    memo = memo_of(model)
    for batch in small(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        lang, score, entropy = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
        if model.languages:
            for start, end in slices(texts):
                h = model.entropies(texts[start:end], memo)
                fine = np.flatnonzero(~np.isnan(h[:, 0]))
                if len(fine):
                    p = model.posterior(h[fine])
                    best = p.argmax(1)
                    for i, b, q in zip(fine + start, best, p.max(1), strict=True):
                        if _has_letter(texts[i]):
                            lang[i], score[i], entropy[i] = model.languages[b], q, h[i - start, b]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang), pa.array(score), pa.array(entropy), pa.array(entropy > model.reject_above)], ["id", "lang_pred", "score", "entropy", "rejected"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from the labelled rows that are not held out: ``sample_docs`` of each language at most, so that every language is learned."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    share = known.groupBy("lang").agg((F.lit(1e9 * sample_docs) / F.count("*")).cast("long").alias("below"))
    chosen = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64(F.lit("sample"), "id", "text"), F.lit(1_000_000_000)) < F.col("below"))
    return fit([(r["text"], r["lang"]) for r in sorted(chosen.collect(), key=lambda r: (r["id"], r["lang"], r["text"]))])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score, entropy, rejected`` of every row, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, entropy double, rejected boolean"
    return rows.mapInArrow(partial(_predict, shared=shared), schema)
