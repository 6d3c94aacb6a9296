"""How the sources of a language differ in their words: every pair of sources, and the words that mark each source.

Counts are gathered by Arrow tasks and summed a word, language and source. Words with the same counts in the same sources
(the same sparse column) are one column with a multiplicity: every pair of sources in it is met once a distinct column.
For a pair of sources with shares ``p`` and shares ``b`` of a word they do not have, the sum of ``|p - p'|`` over all words is that
over the columns that both have, corrected by what each alone adds against the other's ``b``; the latter comes from a
histogram of each source's shares by binary search. So words that only one or none of them has are not met pair by pair.

Defined results: null text, language and source count as ''; repeated rows and ids are documents of their own; a source without
words takes part in all pairs; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .terms import counted, cut, filled, runs

#: Documents of a language that a word must be in; what is added to each count; words told of a source.
MIN_DOCS, ADDED, TOLD = 30, 5, 50
#: What shares are told in.
UNIT = 1_000_000_000
#: Pairs of sources that a task holds at once.
PAIRS = 1 << 20


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, docs`` of runs of rows."""
    for batch in runs(batches):
        codes, words, rows = cut(batch.column("text"))
        lang, source = (filled(batch.column(n)).dictionary_encode() for n in ("lang", "source"))
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        if not len(codes):
            continue
        each, tf = counted(rows * len(words) + codes)
        keys = group[each // len(words)] * len(words) + each % len(words)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        found = keys[first]
        of_group = found // len(words)
        yield pa.RecordBatch.from_arrays(
            [
                lang.dictionary.take(pa.array(of_group // len(source.dictionary))).cast(pa.string()),
                source.dictionary.take(pa.array(of_group % len(source.dictionary))).cast(pa.string()),
                words.take(pa.array(found % len(words))),
                pa.array(np.add.reduceat(tf[order], first)),
                pa.array(np.diff(np.append(first, len(keys)))),
            ],
            ["lang", "source", "term", "n", "docs"],
        )


def _share(n: Column, total: Column, words: Column) -> Column:
    """1 + floor(UNIT * (n + ADDED) / (total + ADDED * words)), exactly; null where there are no words."""
    whole = lambda c: c.cast("decimal(24,0)")
    top, bottom = whole(n + ADDED) * F.lit(UNIT).cast("decimal(10,0)"), whole(total + F.lit(ADDED) * words)
    return F.when(words > 0, F.call_function("div", top, F.when(words > 0, bottom)) + 1)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, i, j, value``: over columns that both sources have, the difference less what :func:`_apart` adds for them."""
    for batch in batches:
        column = batch.column("column")
        parts = column.flatten()
        sid, p, b = (parts.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("sid", "p", "b"))
        sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        times = np.repeat(batch.column("times").to_numpy(), sizes)
        lang = batch.column("lang").dictionary_encode()
        tongue = np.repeat(lang.indices.to_numpy().astype(np.int64), sizes)
        later = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(sid)) - 1
        ends, most = np.cumsum(later), int(sid.max(initial=0)) + 1
        at = 0
        while at < len(sid):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            n = later[at:to]
            one = np.repeat(np.arange(at, to), n)
            two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
            value = np.abs(p[one] - p[two]) - np.abs(p[one] - b[two]) - np.abs(b[one] - p[two]) + np.abs(b[one] - b[two])
            keys = (tongue[one] * most + sid[one]) * most + sid[two]
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            at = to
            if not len(keys):
                continue
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            found = keys[first]
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(found // most // most)).cast(pa.string()), pa.array(found // most % most), pa.array(found % most), pa.array(np.add.reduceat((value * times[one])[order], first))],
                ["lang", "i", "j", "value"],
            )


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, i, j, value``: a source's own words against the share that each other source gives a word it does not have."""
    for batch in batches:
        for lang, sid, shares, bases in zip(*(batch.column(n) for n in ("lang", "sid", "shares", "bases")), strict=True):
            i, base = sid.as_py(), bases.values.to_numpy(zero_copy_only=False).astype(np.int64)
            p, m = (shares.values.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("p", "m"))
            words, sums = np.concatenate([[0], np.cumsum(m)]), np.concatenate([[0], np.cumsum(m * p)])
            k = np.searchsorted(p, base, "right")
            value = (sums[-1] - 2 * sums[k]) - base * (words[-1] - 2 * words[k])
            other = np.arange(len(base))
            keep = other != i
            low, high = np.minimum(other, i)[keep], np.maximum(other, i)[keep]
            yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(low), pa.string()), pa.array(low), pa.array(high), pa.array(value[keep])], ["lang", "i", "j", "value"])


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term, source, n, total``: occurrences in each source that has the word, and in the language, of words in enough documents.

    Words are summed by tasks first, then once more where those of a language and word meet: one shuffle.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(text_col).alias("text"), text(lang_col).alias("lang"), text(source_col).alias("source"))
    found = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    summed = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    word = Window.partitionBy("lang", "term")
    return summed.withColumn("total", F.sum("n").over(word)).withColumn("df", F.sum("docs").over(word)).where(F.col("df") >= min_docs).select("lang", "term", "source", "n", "total")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, told: int = TOLD) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each source of a language all others by difference, and the words that mark it (``told`` at most)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kept, _ = materialise(counts(docs, text_col, lang_col, source_col, min_docs), "words")
    occurring = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source")).distinct()
    words = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.count("*").alias("own_words"))
    # A row a source and language: what follows has as many rows as there are pairs of them.
    named = occurring.withColumn("sid", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    named = named.join(own, ["lang", "source"], "left").join(words, "lang", "left").fillna(0, ["own_n", "own_words", "v", "lang_n"])
    groups, _ = materialise(named.withColumn("b", F.coalesce(_share(F.lit(0), F.col("own_n"), F.col("v")), F.lit(0))), "sources")

    placed = kept.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("own_n"), F.col("v")))
    columns = placed.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("sid", "n", "p", "b"))).alias("column"))
    distinct = columns.groupBy("lang", "column").agg(F.count("*").alias("times")).where(F.size("column") > 1)
    pair = "lang string, i long, j long, value long"
    both = distinct.mapInArrow(_together, pair)

    shares = placed.groupBy("lang", "sid", "p").agg(F.count("*").alias("m")).groupBy("lang", "sid").agg(F.array_sort(F.collect_list(F.struct("p", "m"))).alias("shares"))
    bases = groups.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("sid", "b"))), lambda x: x["b"]).alias("bases"))
    alone = shares.join(bases, "lang").mapInArrow(_apart, pair)

    side = lambda tag: groups.select("lang", F.col("sid").alias(tag), F.col("source").alias(f"{tag}_source"), F.col("b").alias(f"{tag}_b"), F.col("own_words").alias(f"{tag}_words"), *(["v"] if tag == "i" else []))
    pairs = side("i").join(side("j"), "lang").where("i < j")
    rest = pairs.select("lang", "i", "j", ((F.col("v") - F.col("i_words") - F.col("j_words")) * F.abs(F.col("i_b") - F.col("j_b"))).alias("value"))
    values = both.unionByName(alone).unionByName(rest).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    told_pairs = values.join(pairs.select("lang", "i", "j", "i_source", "j_source"), ["lang", "i", "j"])
    either = F.explode(F.array(F.struct(F.col("i_source").alias("source"), F.col("j_source").alias("item")), F.struct(F.col("j_source").alias("source"), F.col("i_source").alias("item"))))
    differ = told_pairs.select("lang", either.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    q = _share(F.col("total"), F.col("lang_n"), F.col("v"))
    marks = placed.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(differ).unionByName(ranked(marks).where(F.col("rank") <= told)).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
