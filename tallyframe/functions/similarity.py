"""Token-sort similarity: 200 x longest common subsequence / total length, of texts with their tokens in order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a machine word: texts of so many are compared many pairs at a time.
WORD = 64
#: Pairs compared at once.
PAIRS = 1 << 15


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def common_subsequences(texts: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`common_subsequence` of ``texts[a]`` and ``texts[b]``, all texts of ``WORD`` characters at most: a bit row of each pair in one word."""
    alphabet = {ch: i + 1 for i, ch in enumerate(sorted(set().union(*texts)))} if texts else {}
    codes = np.zeros((len(texts), WORD), dtype=np.int32)
    for i, t in enumerate(texts):
        codes[i, : len(t)] = [alphabet[ch] for ch in t]
    places = np.zeros((len(texts), len(alphabet) + 1), dtype=np.uint64)
    for at in range(WORD):
        np.bitwise_or.at(places, (np.arange(len(texts)), codes[:, at]), np.uint64(1 << at))
    places[:, 0] = 0
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.zeros(len(a), dtype=np.int64)
    for start in range(0, len(a), PAIRS):
        x, y = a[start : start + PAIRS], b[start : start + PAIRS]
        row = np.full(len(x), np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(int(sizes[y].max(initial=0))):
            hit = row & places[x, codes[y, at]]
            row = (row + hit) | (row - hit)
        unused = np.array([(1 << n) - 1 for n in range(WORD + 1)], dtype=np.uint64)[sizes[x]]
        out[start : start + PAIRS] = sizes[x] - np.bitwise_count(row & unused)
    return out


def _sorted_tokens(text: str) -> str:
    return " ".join(sorted(text.split()))


def ratio(a: str | None, b: str | None) -> float:
    x, y = _sorted_tokens(a or ""), _sorted_tokens(b or "")
    total = len(x) + len(y)
    return 100.0 if not total else 200.0 * common_subsequence(x, y) / total


def ratios(a: pd.Series, b: pd.Series) -> np.ndarray:
    """:func:`ratio` of many pairs; each text is cut and coded once."""
    codes, names = pd.factorize(pd.concat([a, b], ignore_index=True))
    texts = [_sorted_tokens(t) for t in names]
    x, y = codes[: len(a)], codes[len(a) :]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    total = sizes[x] + sizes[y]
    short = (sizes[x] <= WORD) & (sizes[y] <= WORD)
    common = np.zeros(len(x), dtype=np.int64)
    few, place = np.unique(np.concatenate([x[short], y[short]]), return_inverse=True)
    n = int(short.sum())
    common[short] = common_subsequences([texts[i] for i in few], place[:n], place[n:])
    for i in np.flatnonzero(~short):
        common[i] = common_subsequence(texts[x[i]], texts[y[i]])
    return np.where(total > 0, 200.0 * common / np.maximum(total, 1), 100.0)


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(ratios(a, b), dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """0 to 100. A null counts as an empty text."""
    return F.pandas_udf(_ratios, "double")(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """False only where the lengths alone keep the similarity below ``threshold``."""
    la, lb = F.length(a), F.length(b)
    return F.lit(200.0) * F.least(la, lb) >= F.lit(float(threshold)) * (la + lb)
