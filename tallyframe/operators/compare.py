"""Field-level comparison of linked records, their status, variances and the summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig, FieldConfig
from ..functions.similarity import similarity
from ..functions.text import casefold, or_empty

COMPARISON = "struct<left:string,right:string,difference:decimal(38,6),pct:double,ok:boolean>"


def compare_numeric(f: FieldConfig, left: Column, right: Column) -> dict[str, Column]:
    """Difference left - right (a missing side is 0), its share of the right side, and whether it is within tolerance."""
    none = left.isNull() & right.isNull()
    zero = F.lit(0).cast("decimal(38,6)")
    b = F.coalesce(right, zero)
    diff = (F.coalesce(left, zero) - b).cast("decimal(38,6)")
    pct = F.when(b != 0, F.try_divide(diff.cast("double"), b.cast("double"))).when(diff == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    ok = F.abs(diff) <= F.lit(f.abs_tol).cast("decimal(38,6)")
    if f.rel_tol > 0:
        ok = ok | ((b != 0) & (F.abs(pct) <= f.rel_tol))
    return {"difference": F.when(~none, diff), "pct": F.when(~none, pct), "ok": none | ok}


def compare_date(f: FieldConfig, left: Column, right: Column) -> dict[str, Column]:
    days = F.date_diff(left, right).cast("decimal(38,6)")
    return {"difference": days, "pct": F.lit(None).cast("double"), "ok": (left.isNull() & right.isNull()) | F.coalesce(F.abs(days) <= F.lit(f.abs_tol).cast("decimal(38,6)"), F.lit(False))}


def compare_text(f: FieldConfig, left: Column, right: Column) -> dict[str, Column]:
    """Equal but for case (a null is an empty text), or near enough where a threshold is set and both have text."""
    a, b = casefold(or_empty(left)), casefold(or_empty(right))
    ok = a == b
    if f.text_fuzzy_threshold is not None:
        ok = F.when((a != "") & (b != "") & (a != b), similarity(a, b) >= f.text_fuzzy_threshold).otherwise(ok)
    return {"difference": F.lit(None).cast("decimal(38,6)"), "pct": F.lit(None).cast("double"), "ok": ok}


def compare_field(f: FieldConfig, left: Column, right: Column) -> dict[str, Column]:
    if f.is_number:
        return compare_numeric(f, left, right)
    return compare_date(f, left, right) if f.dtype == "date" else compare_text(f, left, right)


def compared(outcomes: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The rows of a match with keys, for each value field ``f__left, f__right, f__diff, f__pct, f__ok``, break fields and status.

    The status of a record without a partner is ``unmatched_left`` or ``unmatched_right``.
    """
    keys = [F.coalesce(f"l_{k.name}", f"r_{k.name}").alias(k.name) for k in cfg.keys]
    rows = outcomes.select(
        F.col("l_key").alias("left_key"),
        F.col("r_key").alias("right_key"),
        "match_type",
        "confidence",
        "strategy_scores",
        "explanation",
        *keys,
        *[F.col(f"l_{f.name}").alias(f"{f.name}__left") for f in cfg.values],
        F.col("l_source_files").alias("left_source_files"),
        *[F.col(f"r_{f.name}").alias(f"{f.name}__right") for f in cfg.values],
        F.col("r_source_files").alias("right_source_files"),
        *[c for c in outcomes.columns if c in ("l_ord", "l_row_count", "r_ord", "r_row_count")],
    )
    for f in cfg.values:
        parts = compare_field(f, F.col(f"{f.name}__left"), F.col(f"{f.name}__right"))
        rows = rows.withColumns({f"{f.name}__diff": parts["difference"], f"{f.name}__pct": parts["pct"], f"{f.name}__ok": parts["ok"]})
    broken = F.filter(F.array(*[F.when(~F.col(f"{f.name}__ok"), F.lit(f.name)) for f in cfg.values]) if cfg.values else F.array().cast("array<string>"), lambda x: x.isNotNull())
    alone = F.when(F.col("right_key").isNull(), "unmatched_left").when(F.col("left_key").isNull(), "unmatched_right")
    return rows.withColumn("break_fields", broken).withColumn("status", alone.when(F.size("break_fields") == 0, "reconciled").otherwise("break"))


def linked(rows: DataFrame) -> DataFrame:
    """The rows of :func:`compared` that have both records."""
    return rows.where(F.col("left_key").isNotNull() & F.col("right_key").isNotNull()).drop("l_ord", "l_row_count", "r_ord", "r_row_count")


def unmatched(rows: DataFrame, cfg: EngineConfig, side: str) -> DataFrame:
    """The records of a side that have no partner, in canonical form."""
    own, other, tag = ("left", "right", "l") if side == "left" else ("right", "left", "r")
    fields = [F.col(k.name) for k in cfg.keys] + [F.col(f"{f.name}__{own}").alias(f.name) for f in cfg.values]
    lone = rows.where(F.col(f"{own}_key").isNotNull() & F.col(f"{other}_key").isNull())
    return lone.select(F.col(f"{own}_key").alias("key"), F.col(f"{tag}_ord").alias("ord"), *fields, F.col(f"{own}_source_files").alias("source_files"), F.col(f"{tag}_row_count").alias("row_count"))


def variance(matches: DataFrame, cfg: EngineConfig) -> DataFrame:
    """``field, dtype, sum_left_minus_right, sum_abs_difference, n_breaks``: one pass over the matches, then one row a field."""
    places = cfg.norm.decimal_places
    aggregates = []
    for f in cfg.values:
        diff = F.col(f"{f.name}__diff")
        aggregates += [F.sum(diff).alias(f"s_{f.name}"), F.sum(F.abs(diff)).alias(f"a_{f.name}"), F.count_if(~F.col(f"{f.name}__ok")).alias(f"n_{f.name}")]
    if not aggregates:
        return matches.sparkSession.createDataFrame([], "field string, dtype string, sum_left_minus_right decimal(38,6), sum_abs_difference decimal(38,6), n_breaks long")
    total = matches.agg(*aggregates)
    number = lambda f, c: F.round(F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,6)"), places).cast("decimal(38,6)") if f.is_number else F.lit(None).cast("decimal(38,6)")
    rows = [F.struct(F.lit(f.name).alias("field"), F.lit(f.dtype).alias("dtype"), number(f, f"s_{f.name}").alias("sum_left_minus_right"), number(f, f"a_{f.name}").alias("sum_abs_difference"), F.col(f"n_{f.name}").alias("n_breaks")) for f in cfg.values]
    return total.select(F.inline(F.array(*rows)))


def summary(rows: DataFrame) -> DataFrame:
    """One row of counts and rates, from one pass over the rows of :func:`compared`."""
    rate = lambda a, b: F.round(100.0 * F.col(a) / F.when(F.col(b) == 0, 1).otherwise(F.col(b)), 2)
    both = F.col("left_key").isNotNull() & F.col("right_key").isNotNull()
    counts = rows.agg(
        F.count("left_key").alias("left_records"),
        F.count("right_key").alias("right_records"),
        F.count_if(both).alias("matched_pairs"),
        F.count_if(both & (F.col("match_type") == "exact")).alias("matched_exact"),
        F.count_if(both & (F.col("match_type") != "exact")).alias("matched_fuzzy_or_semantic"),
        *[F.count_if(F.col("status") == status).alias(name) for name, status in (("reconciled", "reconciled"), ("breaks", "break"), ("unmatched_left", "unmatched_left"), ("unmatched_right", "unmatched_right"))],
    )
    return counts.select(
        F.lit("token_sort_lcs").alias("fuzzy_backend"),
        "left_records",
        "right_records",
        "matched_pairs",
        "matched_exact",
        "matched_fuzzy_or_semantic",
        "reconciled",
        "breaks",
        "unmatched_left",
        "unmatched_right",
        rate("reconciled", "matched_pairs").alias("reconciliation_rate"),
        rate("matched_pairs", "left_records").alias("match_rate_left"),
        rate("matched_pairs", "right_records").alias("match_rate_right"),
    )
