"""The whole reconciliation: canonicalise both sides, match, compare, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators.canonical import canonicalize
from ..operators.compare import compared, linked, summary, unmatched, variance
from ..operators.matching import match
from .scratch import written


@dataclass(frozen=True)
class Reconciliation:
    """Lazy results. ``rows`` has one row for each link and each record without one; all else is read from it."""

    rows: DataFrame
    cfg: EngineConfig

    @property
    def matches(self) -> DataFrame:
        """Reconciled pairs and breaks alike."""
        return linked(self.rows)

    @property
    def reconciled(self) -> DataFrame:
        return self.matches.where(F.col("status") == "reconciled")

    @property
    def breaks(self) -> DataFrame:
        return self.matches.where(F.col("status") == "break")

    @property
    def unmatched_left(self) -> DataFrame:
        return unmatched(self.rows, self.cfg, "left")

    @property
    def unmatched_right(self) -> DataFrame:
        return unmatched(self.rows, self.cfg, "right")

    @property
    def field_variance(self) -> DataFrame:
        return variance(self.matches, self.cfg)

    @property
    def summary(self) -> DataFrame:
        return summary(self.rows)

    def written(self) -> Reconciliation:
        """The same with its rows written to the shared folder, for callers that read several results."""
        return replace(self, rows=written(self.rows))


def reconcile_canonical(left: DataFrame, right: DataFrame, cfg: EngineConfig) -> Reconciliation:
    """From two canonical sides."""
    return Reconciliation(compared(match(left, right, cfg), cfg), cfg)


def reconcile(
    left: DataFrame,
    right: DataFrame,
    cfg: EngineConfig | dict,
    left_ord: Sequence[str] = (),
    right_ord: Sequence[str] = (),
    left_file: str | None = None,
    right_file: str | None = None,
    ontology=None,
) -> Reconciliation:
    """From two raw sides; see :func:`tallyframe.operators.canonical.canonicalize` for their form."""
    cfg = EngineConfig.from_dict(cfg) if isinstance(cfg, dict) else cfg.validated()
    lhs = canonicalize(left, cfg, "left", left_ord, left_file, ontology)
    rhs = canonicalize(right, cfg, "right", right_ord, right_file, ontology)
    return reconcile_canonical(lhs, rhs, cfg)


def key_values(df: DataFrame, cfg: EngineConfig | dict, side: str, ord_cols: Sequence[str] = (), file_col: str | None = None, ontology=None) -> DataFrame:
    """One side by itself under a validated configuration: a row a composite key with its aggregated values."""
    if side not in ("left", "right"):
        raise ValueError(f"no side {side}")
    cfg = EngineConfig.from_dict(cfg) if isinstance(cfg, dict) else cfg.validated()
    return canonicalize(df, cfg, side, ord_cols, file_col, ontology)
