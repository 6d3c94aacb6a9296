"""Quality by random-indexing word vectors, pooled over a document, and a two-layer network in numpy.

Units are words, the shapes of words, runs of punctuation, and repeats of the word before. Each has a
sparse random index vector; its own vector adds up those of the units around it in a bounded sample of labelled
documents. A document is the mean of its units' vectors. The network's probabilities are divided by a
temperature that is fitted on a fifth of the sample which is left out of the rest.

Defined results: null and empty texts score as a document without units (the zero vector); rows whose
label is null teach nothing; with one class only, or none, every text gets that class's smoothed share.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .common import indexed, memo_of, slices, small, WordMemo
from .toxicity import labelled
from .toxicity import score as scored

#: Labelled rows that the classifier is fitted on at most.
SAMPLE_ROWS = 4000
#: Length of vectors, entries of an index vector that are not zero, reach of contexts, hidden units, and sampled documents that must hold a unit.
DIM, NONZERO, WINDOW, HIDDEN, HELD_BY = 48, 4, 2, 24, 2
#: Score from which a document counts as good.
THRESHOLD = 0.7
REPEAT = "<repeat>"
_UNIT = re.compile(r"[^\W_]+|[\W_]+")


#: What a piece's letters and length look like, by its kind and a quarter of its length.
_SHAPES = {kind: [f"<{kind}{n}>" for n in range(5)] for kind in ("digit", "upper", "title", "lower", "mixed")}


def shape(piece: str) -> str:
    kind = "lower" if piece.islower() else "digit" if piece.isdigit() else "upper" if len(piece) > 1 and piece.isupper() else "title" if piece.istitle() else "mixed"
    return _SHAPES[kind][min(len(piece) // 4, 4)]


def units(word: str) -> list[str]:
    """The units of a word (which has no white space)."""
    if word.isalpha():
        return [word.lower(), shape(word)]
    out = []
    for piece in _UNIT.findall(word):
        if piece[0].isalnum():
            out += [piece.lower(), shape(piece)]
        else:
            out.append(piece if len(piece) < 4 else f"<{piece[0]}{min(len(set(piece)), 3)}>")
    return out


@dataclass
class Model:
    places: dict[str, int]
    vectors: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0
    prior: float | None = None
    mark: str = field(default_factory=lambda: uuid.uuid4().hex)

    def words(self, words: list[str]) -> list[tuple[int, ...]]:
        """For each word the places of its units."""
        place = self.places.get
        return [tuple([p for u in units(w) if (p := place(u)) is not None]) for w in words]

    def table(self, places: list[tuple[int, ...]]) -> np.ndarray:
        """For each word the sum of its units' vectors, and their number."""
        n = np.fromiter(map(len, places), dtype=np.int64, count=len(places))
        out = np.zeros((len(places), DIM + 1), dtype=np.float32)
        flat, start = np.fromiter(chain.from_iterable(places), dtype=np.int64, count=int(n.sum())), np.cumsum(n) - n
        for k in range(int(n.max(initial=0))):  # most words have two units
            more = np.flatnonzero(n > k)
            out[more, :DIM] += self.vectors[flat[start[more] + k]]
        out[:, DIM] = n
        return out

    def pooled(self, texts: list[str], memo: WordMemo) -> np.ndarray:
        docs = [t.split() for t in texts]
        vocabulary, at, ends = indexed(docs)
        out = np.zeros((len(texts), DIM), dtype=np.float32)
        if not vocabulary:
            return out
        table = self.table(memo.values(vocabulary))
        again = self.vectors[self.places[REPEAT]] if REPEAT in self.places else np.zeros(DIM, dtype=np.float32)
        for j, words in enumerate(docs):
            total = np.zeros(DIM + 1, dtype=np.float64)
            for a in range(ends[j], ends[j + 1], 1 << 15):
                total += table[at[a : min(a + (1 << 15), ends[j + 1])]].sum(0)
            repeats = sum(map(eq, words, words[1:]))
            if total[-1] + repeats:
                out[j] = (total[:-1] + repeats * again) / (total[-1] + repeats)
        return out

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(pooled), np.log(self.prior / (1 - self.prior)))
        mean, spread, w1, b1, w2, b2 = self.layers
        return np.tanh((pooled - mean) / spread @ w1 + b1) @ w2 + b2[0]

    def score(self, texts: list[str], memo: WordMemo) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.pooled(texts, memo)) / self.temperature, -40, 40).astype(np.float64)))


def random_index(texts: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Places of the units that ``HELD_BY`` documents or more hold, and their vectors."""
    held: Counter = Counter()
    spelt: dict[str, list[str]] = {}
    for t in texts:
        words = set(t.split())
        for w in words:
            if w not in spelt:
                spelt[w] = [*map(sys.intern, units(w))]
        held.update(set(chain.from_iterable(map(spelt.__getitem__, words))))
    names = [REPEAT, *sorted(u for u, n in held.items() if n >= HELD_BY)]
    places = dict(zip(names, range(len(names)), strict=True))
    known = {w: [p for u in us if (p := places.get(u)) is not None] for w, us in spelt.items()}
    rng = np.random.default_rng(5)
    index = np.zeros((len(names), DIM), dtype=np.float32)
    spots = rng.random((len(names), DIM)).argpartition(NONZERO, axis=1)[:, :NONZERO]
    np.put_along_axis(index, spots, rng.choice(np.array([-1.0, 1.0], dtype=np.float32), (len(names), NONZERO)), axis=1)
    met, often = np.zeros(0, dtype=np.int64), np.zeros(0)  # neighbours as unit x units + unit, and how often they meet
    for start, end in slices(texts, 400_000):
        sequence = []
        for t in texts[start:end]:
            last = None
            for w in t.split():
                if w == last:
                    sequence.append(0)
                sequence += known[w]
                last = w
        s = np.array(sequence, dtype=np.int64)
        pairs = np.concatenate([met, *(s[:-off] * len(names) + s[off:] for off in range(1, WINDOW + 1))])
        met, place = np.unique(pairs, return_inverse=True)
        often = np.bincount(place, weights=np.concatenate([often, np.ones(len(pairs) - len(often))]), minlength=len(met))
    a, b = np.divmod(met, len(names))
    context = np.zeros((len(names), DIM))
    for d in range(DIM):
        context[:, d] = np.bincount(a, weights=np.log1p(often) * index[b, d], minlength=len(names)) + np.bincount(b, weights=np.log1p(often) * index[a, d], minlength=len(names))
    vectors = index * np.sqrt(DIM / NONZERO) + context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6) * 2
    return places, vectors.astype(np.float32)


def network(x: np.ndarray, y: np.ndarray, rounds: int = 400) -> list[np.ndarray]:
    """Two layers by Adam on all rows; the bias begins at the log odds of the classes."""
    rng = np.random.default_rng(9)
    mean, spread = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / spread
    layers = [rng.standard_normal((DIM, HIDDEN)) / np.sqrt(DIM), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.array([np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in layers]
    for t in range(1, rounds + 1):
        w1, b1, w2, b2 = layers
        h = np.tanh(z @ w1 + b1)
        error = (1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -40, 40))) - y) / len(y)
        back = error[:, None] * w2[None, :] * (1 - h * h)
        for i, g in enumerate((z.T @ back + 1e-4 * w1, back.sum(0), h.T @ error + 1e-4 * w2, np.array([error.sum()]))):
            m, v = moments[i]
            m[:], v[:] = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            layers[i] = layers[i] - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return [mean, spread, *layers]


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model from (text, label) rows; every fifth row sets the temperature and is left out of the rest."""
    y = np.array([label for _, label in rows], dtype=np.float64)
    if len(rows) == 0 or y.min() == y.max():
        return Model({}, np.zeros((0, DIM), dtype=np.float32), [], prior=float((y.sum() + 0.5) / (len(y) + 1)))
    learn = np.arange(len(rows)) % 5 != 0 if len(rows) >= 50 else np.ones(len(rows), dtype=bool)
    texts = [t for t, _ in rows]
    places, vectors = random_index([t for t, use in zip(texts, learn, strict=True) if use])
    model = Model(places, vectors, [])
    memo = WordMemo(model.words)
    x = np.concatenate([model.pooled(texts[a:b], memo) for a, b in slices(texts)]).astype(np.float64)
    model.layers = network(x[learn], y[learn])
    check = ~learn if len(rows) >= 50 else learn
    logit, truth = model.logit(x[check]), y[check]
    grid = np.geomspace(0.3, 10, 60)
    losses = [np.logaddexp(0, np.where(truth > 0, -1, 1) * logit / t).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])
    return model


def _score(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    memo = memo_of(model)
    for batch in small(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        scores = [model.score(texts[a:b], memo) for a, b in slices(texts)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["id", "score"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    return fit(labelled(docs, labels, label_col, id_col, text_col, sample_rows))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every row, from its whole text."""
    return scored(docs, model, id_col, text_col, scorer=_score)
