"""From raw records to one canonical row a composite key: map, coerce, filter, drop duplicates, aggregate.

A side is any DataFrame. ``ord`` gives the order of its rows (columns, most significant first); ``file_col``
names the column with the source file. A canonical side has ``key, ord, <fields>, source_files, row_count``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EngineConfig, FieldConfig
from ..functions import dates, numbers, text
from .ontology import with_term

SEPARATOR = "|"


def _cell_text(df: DataFrame, c: str, cfg: EngineConfig) -> Column:
    """The text of a cell; whole numbers, decimals, dates and times have none to trim or collapse."""
    if isinstance(df.schema[c].dataType, T.IntegralType | T.DecimalType | T.DateType | T.TimestampType):
        shown = df[c].cast("string")
        return F.when(shown.isin(*cfg.norm.null_tokens), None).otherwise(shown) if cfg.norm.null_tokens else shown
    return text.clean(df[c].cast("string"), cfg.norm.null_tokens, cfg.norm.strip_non_english)


def _coerced(df: DataFrame, f: FieldConfig, side: str, cfg: EngineConfig, terms: dict[str, str]) -> tuple[Column, Column]:
    """The typed value of a field, and the text by which it names keys and duplicates. ``terms``: columns of fields whose synonyms are looked up."""
    source = f.source(side)
    if source is None or source not in df.columns:
        kind = {"money": numbers.MONEY, "numeric": numbers.MONEY, "date": "date"}.get(f.dtype, "string")
        return F.lit(None).cast(kind), F.lit(None).cast("string")
    c, dtype = df[source], df.schema[source].dataType
    if f.is_number:
        value = numbers.number_of(c, dtype, cfg.norm.null_tokens)
        return value, F.when(value.isNotNull(), numbers.number_text(c, dtype, cfg.norm.null_tokens))
    if f.dtype == "date":
        value = dates.date_of(c, dtype, cfg.norm.dayfirst)
        return value, value.cast("string")
    value = df[terms[f.name]] if f.name in terms else _cell_text(df, source, cfg)
    if f.role == "key" and cfg.norm.casefold_keys and (f.name in terms or not isinstance(dtype, T.IntegralType | T.DecimalType)):
        value = text.casefold(value)
    return value, value


def mapped(df: DataFrame, cfg: EngineConfig, side: str, ord_cols: Sequence[str], file_col: str | None = None, ontology=None) -> DataFrame:
    """Canonical fields (``ontology``: an alias table for text keys) with their texts (``t_<field>``), ``key``, ``__ord`` and ``__file``; rows without any key are left out."""
    terms = {f.name: f"term_{i}_of_key" for i, f in enumerate(cfg.keys) if f.dtype == "text" and f.source(side) in df.columns} if ontology is not None else {}
    for f in cfg.keys:
        if f.name in terms:
            df = with_term(df, _cell_text(df, f.source(side), cfg), ontology, terms[f.name])
    values, texts = {}, {}
    for f in cfg.fields:
        values[f.name], texts[f.name] = _coerced(df, f, side, cfg, terms)
    order = F.struct(*[df[c] for c in ord_cols]) if ord_cols else F.struct(F.lit(0))
    file = df[file_col].cast("string") if file_col else F.lit("").cast("string")
    rows = df.select(*[v.alias(n) for n, v in values.items()], *[t.alias(f"t_{n}") for n, t in texts.items()], order.alias("__ord"), file.alias("__file"))
    key = F.concat_ws(SEPARATOR, *[F.coalesce(F.col(f"t_{k.name}"), F.lit("")) for k in cfg.keys])
    return rows.where(F.coalesce(*[F.col(f"t_{k.name}") for k in cfg.keys]).isNotNull()).withColumn("key", key)


def without_duplicates(rows: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Of rows that agree in all canonical texts the first. An aggregation, so that copies merge before the shuffle."""
    signature = [f"t_{f.name}" for f in cfg.fields]
    rest = [c for c in rows.columns if c not in signature]
    first = F.min_by(F.struct(*rest), "__ord").alias("__first")
    return rows.groupBy(*signature).agg(first).select(*signature, "__first.*")


def aggregate(f: FieldConfig) -> Column:
    """The aggregate of a field over the rows of a key; text and dates know first, last and count only."""
    v = F.col(f.name)
    seen = F.when(v.isNotNull(), F.col("__ord"))
    if f.is_number:
        return {
            "sum": lambda: F.sum(v).cast("decimal(38,6)"),
            "mean": lambda: (F.sum(v).cast("decimal(32,6)") / F.count(v)).cast("decimal(38,6)"),
            "min": lambda: F.min(v).cast("decimal(38,6)"),
            "max": lambda: F.max(v).cast("decimal(38,6)"),
            "first": lambda: F.min_by(v, seen).cast("decimal(38,6)"),
            "last": lambda: F.max_by(v, seen).cast("decimal(38,6)"),
            "count": lambda: F.count(v).cast("decimal(38,6)"),
        }[f.agg]()
    if f.agg == "count":
        return F.nullif(F.count(v), F.lit(0)).cast("string")
    return F.max_by(v, seen) if f.agg == "last" else F.min_by(v, seen)


def canonicalize(df: DataFrame, cfg: EngineConfig, side: str, ord_cols: Sequence[str] = (), file_col: str | None = None, ontology=None) -> DataFrame:
    """``key, ord, <fields>, source_files, row_count``: one row a composite key."""
    rows = mapped(df, cfg, side, ord_cols, file_col, ontology)
    if cfg.norm.drop_exact_duplicates:
        rows = without_duplicates(rows, cfg)
    lone = cfg.keys[0].name if len(cfg.keys) == 1 and cfg.keys[0].dtype == "text" else None  # a lone text key is the key itself
    out = rows.groupBy("key").agg(
        F.min("__ord").alias("ord"),
        *[F.min_by(k.name, "__ord").alias(k.name) for k in cfg.keys if k.name != lone],
        *[aggregate(f).alias(f.name) for f in cfg.values],
        F.array_join(F.array_sort(F.collect_set("__file")), ", ").alias("source_files"),
        F.count("*").alias("row_count"),
    )
    if lone is not None:
        out = out.withColumn(lone, F.col("key"))
    return out.select("key", "ord", *[k.name for k in cfg.keys], *[f.name for f in cfg.values], "source_files", "row_count")
