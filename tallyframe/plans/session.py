"""A session: sides that grow by extractions, scope, long form, edits, preview and reconciliation. Immutable."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import ontology, profile, qc, reshape
from ..operators.edits import apply_ops
from ..operators.grids import column_union, wide
from .reconcile import Reconciliation, reconcile

PROVENANCE = ["extraction", "source_file", "table_name", "row_index"]


def table_id(source_file: str, table_name: str) -> str:
    return f"{source_file}||{table_name}"


@dataclass(frozen=True)
class Extraction:
    """Records of one upload; a processed one is in its final form already."""

    records: DataFrame
    processed: bool = False


@dataclass(frozen=True)
class Session:
    left: tuple[Extraction, ...] = ()
    right: tuple[Extraction, ...] = ()
    synonyms: DataFrame | None = None

    def add(self, side: str, records: DataFrame, processed: bool = False) -> Session:
        return replace(self, **{side: (*getattr(self, side), Extraction(records, processed))})

    def cleared(self, side: str) -> Session:
        return replace(self, **{side: ()})

    def with_synonyms(self, table: DataFrame) -> Session:
        """With a further alias table, whose entries win."""
        return replace(self, synonyms=table if self.synonyms is None else ontology.merged(self.synonyms, table))

    def replace_table(self, side: str, index: int, records: DataFrame) -> Session:
        own = list(getattr(self, side))
        own[index] = Extraction(records, own[index].processed)
        return replace(self, **{side: tuple(own)})

    def frame(self, side: str, included: Sequence[str] | None = None, melt: bool = False, fall_back: bool = False) -> DataFrame:
        """All records of a side with the ordered union of their columns, provenance and order.

        ``included`` names tables by :func:`table_id`; with ``fall_back`` a choice that leaves nothing means all.
        """
        parts = []
        for i, e in enumerate(getattr(self, side)):
            columns = column_union(e.records)
            rows = wide(e.records, columns).withColumn("extraction", F.lit(i))
            if included is not None:
                chosen = rows.where(F.concat_ws("||", "source_file", "table_name").isin(*included))
                rows = rows if fall_back and chosen.isEmpty() else chosen
            if melt and not e.processed and not reshape.has_value_column(rows):
                rows = reshape.melt(rows, carry=PROVENANCE)
            parts.append(rows)
        if not parts:
            raise ValueError(f"no tables on the {side} side")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def profiles(self, side: str, included: Sequence[str] | None = None) -> DataFrame:
        rows = self.frame(side, included, fall_back=True)
        return profile.described(rows, PROVENANCE, [c for c in rows.columns if c not in PROVENANCE])

    def suggest_mapping(self, left: Sequence[str] | None = None, right: Sequence[str] | None = None) -> list[dict]:
        return profile.field_dicts(profile.suggested_fields(self.profiles("left", left), self.profiles("right", right)))

    def reconcile(self, cfg: EngineConfig | dict, left: Sequence[str] | None = None, right: Sequence[str] | None = None, melt: bool = False) -> Reconciliation:
        return reconcile(self.frame("left", left, melt), self.frame("right", right, melt), cfg, PROVENANCE, PROVENANCE, "source_file", "source_file", self.synonyms)


def preview(df: DataFrame, ops: Sequence[dict] = (), limit: int = 500) -> dict:
    """A table (with ``ord``) after edits: its columns, first rows, whether there are more, and its subtotal check."""
    edited = apply_ops(df, ops)
    columns = [c for c in edited.columns if c != "ord"]
    rows = edited.orderBy("ord").limit(limit + 1).select(*columns).collect()
    return {"columns": columns, "rows": [list(r) for r in rows[:limit]], "truncated": len(rows) > limit, "complex": reshape.is_complex(columns), "qc": qc.subtotals(edited, ["ord"]).first().asDict()}
