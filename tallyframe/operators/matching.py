"""Matching of two canonical sides: exact keys first, then scored candidates of the rest, one to one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import similarity, text
from ..plans.scratch import cut, written
from . import bands, blocks
from .assign import assign
from .near import near_pairs
from .tfidf import best_matches

#: Strategies in the order in which ties of weight are broken (fixed values).
STRATEGIES = ("fuzzy", "semantic", "numeric")
SCORES = "array<struct<strategy:string,score:double,weight:double>>"
LINK = ("left_key", "right_key", "match_type", "confidence", "strategy_scores", "explanation")


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both sides by one full outer join on the key (unique on each side): ``l_<column>``, ``r_<column>``, null where a side has no record."""
    tagged = lambda df, tag: df.select(*[F.col(c).alias(f"{tag}_{c}") for c in df.columns])
    return tagged(left, "l").join(tagged(right, "r"), F.col("l_key") == F.col("r_key"), "full_outer")


def _exact(cfg: EngineConfig) -> dict[str, Column]:
    both = F.col("l_key").isNotNull() & F.col("r_key").isNotNull()
    scores = F.array(F.struct(F.lit("exact").alias("strategy"), F.lit(1.0).alias("score"), F.lit(cfg.matching.weight_exact).alias("weight")))
    values = {"match_type": F.lit("exact"), "confidence": F.lit(1.0), "strategy_scores": scores.cast(SCORES), "explanation": F.lit("Exact composite-key match.")}
    return {n: F.when(both, v) for n, v in values.items()}


def _only(pairs: DataFrame, tag: str, other: str) -> DataFrame:
    """The records of one side that have no partner, under their own names."""
    columns = [c for c in pairs.columns if c.startswith(f"{tag}_")]
    return pairs.where(F.col(f"{other}_key").isNull()).select(*[F.col(c).alias(c[2:]) for c in columns])


def block_of(df: DataFrame, cfg: EngineConfig) -> Column:
    """What two records must share to be compared: a field's text, a prefix of the key, or nothing."""
    m = cfg.matching
    if m.blocking_field:
        return text.or_empty(F.col(m.blocking_field)) if m.blocking_field in df.columns else F.lit("")
    if m.blocking_prefix_len > 0:
        return F.substring("key", 1, m.blocking_prefix_len)
    return F.lit("")


def _side(df: DataFrame, cfg: EngineConfig, tag: str) -> DataFrame:
    numeric = [f.name for f in cfg.values if f.is_number] if cfg.matching.numeric_enabled else []
    return df.select(
        block_of(df, cfg).alias("block"),
        F.col("key").alias(f"{tag}_key"),
        F.col("ord").alias(f"{tag}_ord"),
        *([text.token_sorted(F.col("key")).alias(f"{tag}_sorted")] if cfg.matching.fuzzy_enabled else []),
        *[F.col(n).alias(f"{tag}_v_{n}") for n in numeric],
    )


def numeric_proximity(pairs: list[tuple[Column, Column]]) -> Column:
    """Mean over the fields that both have of 1 - |a - b| / max(|a|, |b|, 1), not below 0; null if there is none."""
    return bands.mean_proximity(pairs)


def scored(fuzzy: Column, semantic: Column, numeric: Column, cfg: EngineConfig) -> dict[str, Column]:
    """Confidence, dominant strategy, scores and explanation from scores of 0 to 1 (null: none)."""
    m = cfg.matching
    weight = {"fuzzy": m.weight_fuzzy, "semantic": m.weight_semantic, "numeric": m.weight_numeric}
    score = dict(zip(STRATEGIES, (fuzzy, semantic, numeric), strict=True))
    present = {s: c.isNotNull() for s, c in score.items()}
    total = reduce(lambda x, y: x + y, [F.coalesce(score[s] * weight[s], F.lit(0.0)) for s in STRATEGIES])
    norm = reduce(lambda x, y: x + y, [F.when(present[s], weight[s]).otherwise(0.0) for s in STRATEGIES])
    confidence = F.when(norm > 0, total / norm)
    best = F.greatest(*[F.coalesce(score[s] * weight[s], F.lit(-1.0)) for s in STRATEGIES])
    dominant = F.coalesce(*[F.when(present[s] & (score[s] * weight[s] == best), F.lit(s)) for s in STRATEGIES])
    said = {"fuzzy": "fuzzy key", "semantic": "semantic", "numeric": "numeric proximity"}
    percent = lambda c: F.bround(c * 100, 0).cast("int").cast("string")
    reasons = F.concat_ws(", ", *[F.when(present[s], F.concat(F.lit(f"{said[s]} "), percent(score[s]), F.lit("%"))) for s in STRATEGIES])
    scores = F.filter(F.array(*[F.when(present[s], F.struct(F.lit(s).alias("strategy"), score[s].cast("double").alias("score"), F.lit(weight[s]).alias("weight"))) for s in STRATEGIES]), lambda x: x.isNotNull())
    return {
        "match_type": dominant,
        "confidence": F.round(confidence, 4),
        "strategy_scores": scores.cast(SCORES),
        "explanation": F.concat(F.lit("Matched on "), reasons, F.lit(" (confidence "), percent(confidence), F.lit("%).")),
    }


def _met(left: DataFrame, right: DataFrame, numeric: list[str], hits: DataFrame | None, cfg: EngineConfig) -> DataFrame:
    """``left_key, right_key`` of every pair that one of the strategies may accept, once.

    A pair that only numbers speak for has their proximity as its confidence, so numbers need only meet from the accepted
    confidence (before it is rounded) up.
    """
    m, parts = cfg.matching, []
    if m.fuzzy_enabled:
        parts.append(near_pairs(left, right, m.fuzzy_threshold))
    if hits is not None:
        parts.append(hits.select("left_key", "right_key"))
    if numeric:
        least = m.accept_threshold - 0.00006
        fields = [(f"left_v_{n}", f"right_v_{n}") for n in numeric]
        every = lambda: left.join(right, "block").select("left_key", "right_key")  # noqa: E731  all of a block have a score that is accepted
        parts.append(bands.band_pairs(left, right, fields, least) if least > 0 else every())
    return parts[0] if len(parts) == 1 else reduce(DataFrame.union, parts).distinct()


def candidates(left: DataFrame, right: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Scored pairs of each block, those below the accepted confidence left out."""
    m = cfg.matching
    lhs, rhs = _side(left, cfg, "left"), _side(right, cfg, "right")
    numeric = [f.name for f in cfg.values if f.is_number] if m.numeric_enabled else []
    none, hits = F.lit(None).cast("double"), None
    if m.semantic_enabled:
        corpus = rhs.select("block", F.struct("right_ord", "right_key").alias("id"), F.col("right_key").alias("text"))
        queries = lhs.select("block", F.struct("left_ord", "left_key").alias("id"), F.col("left_key").alias("text"))
        best = best_matches(queries, corpus, least=m.semantic_threshold).where(F.col("similarity") >= m.semantic_threshold - 1e-9)
        hits = written(best.select("left_id.left_key", "right_id.right_key", (F.col("similarity") / 100).alias("semantic")))
    alone = bool(numeric) and hits is None and not m.fuzzy_enabled
    if alone:  # near numbers come with both their rows; rows of equal numbers as one, until their pairs are scored
        fields, least = [(f"left_v_{n}", f"right_v_{n}") for n in numeric], m.accept_threshold - 0.00006
        pairs = bands.mean_groups(lhs, rhs, fields, least) if least > 0 else blocks.met_groups(lhs, rhs, ["block"], *map(list, zip(*fields)), "left_key", "right_key")
    else:
        pairs = _met(lhs, rhs, numeric, hits, cfg).join(lhs, "left_key").join(rhs.withColumnRenamed("block", "__block"), "right_key").where("block = __block").drop("__block")
    score = {"fuzzy": none, "semantic": none, "numeric": none}
    if m.fuzzy_enabled:
        pairs = pairs.where(similarity.may_reach(F.col("left_sorted"), F.col("right_sorted"), m.fuzzy_threshold)) if hits is None and not numeric else pairs
        pairs = pairs.withColumn("__raw", similarity.similarity(F.col("left_sorted"), F.col("right_sorted")))
        score["fuzzy"] = F.when(F.col("__raw") >= m.fuzzy_threshold, F.col("__raw") / 100)
    if numeric and "proximity" in pairs.columns:
        score["numeric"] = F.col("proximity")
    elif numeric:
        score["numeric"] = numeric_proximity([(F.col(f"left_v_{n}"), F.col(f"right_v_{n}")) for n in numeric])
    if hits is not None:
        pairs = pairs.join(hits, ["left_key", "right_key"], "left")
        score["semantic"] = F.col("semantic")
    rows = [blocks.LEFT, blocks.RIGHT] if alone else ["left_key", "right_key", "left_ord", "right_ord"]
    shown = pairs.select("block", *rows, *[c.alias(n) for n, c in score.items()])
    parts = scored(*[F.col(n) for n in STRATEGIES], cfg)
    found = shown.select("block", *rows, *[c.alias(n) for n, c in parts.items()]).where(F.col("confidence") >= m.accept_threshold)
    return (blocks.apart(found) if alone else found).select("left_key", "right_key", "block", "left_ord", "right_ord", *parts)


def match(left: DataFrame, right: DataFrame, cfg: EngineConfig) -> DataFrame:
    """One row for each link and each record without one: both records (:func:`paired`), and how they were matched."""
    m = cfg.matching
    pairs = paired(left, right)
    numeric = m.numeric_enabled and any(f.is_number for f in cfg.values)
    if not (m.fuzzy_enabled or m.semantic_enabled or numeric):
        return pairs.select("*", *[c.alias(n) for n, c in _exact(cfg).items()])
    pairs = written(pairs)
    rest_left, rest_right = _only(pairs, "l", "r"), _only(pairs, "r", "l")
    found = cut(candidates(rest_left, rest_right, cfg))
    blocks = found.groupBy("block").agg(F.min("left_ord").alias("block_ord")).alias("b")
    ordered = found.join(blocks, "block").withColumn("__c", -F.col("confidence"))
    chosen = assign(ordered, [F.col("__c"), F.col("block_ord"), F.col("left_ord"), F.col("right_ord")])
    links = cut(found.join(chosen, ["left_key", "right_key"]).select(*LINK))
    l_columns, r_columns = ([c for c in pairs.columns if c.startswith(t)] for t in ("l_", "r_"))
    of_left = pairs.where("r_key is null").select(*l_columns).join(links, F.col("l_key") == F.col("left_key"), "left")
    rest = of_left.join(pairs.where("l_key is null").select(*r_columns), F.col("right_key") == F.col("r_key"), "full_outer").drop("left_key", "right_key")
    exact = pairs.where("l_key is not null and r_key is not null").select("*", *[c.alias(n) for n, c in _exact(cfg).items()])
    return exact.unionByName(rest)
