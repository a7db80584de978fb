"""Contracts of observations: which columns an agent may see, in which order. Driver-side checks over names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from barloom.operators.features import forbidden_names, regime_columns

#: Observation modes and the simulator's own state columns.
MODES = ("market_only", "regime_only", "market_plus_regime")
STATE = ("position", "equity_norm", "drawdown", "bench_position")
RAW = ("timestamp", "bar_s", "open", "high", "low", "close", "volume")
FORWARD = "log_ret_1_fwd"


@dataclass(frozen=True)
class ObservationContract:
    mode: str
    market: tuple[str, ...]
    regime: tuple[str, ...]
    state: tuple[str, ...] = STATE

    def columns(self) -> list[str]:
        """Market, regime and state columns in order; raises on an unknown mode, a repeated or a forbidden name."""
        if self.mode not in MODES:
            raise ValueError(f"unknown observation mode {self.mode!r}")
        out = [*(self.market if self.mode != "regime_only" else ()), *(self.regime if self.mode != "market_only" else ())]
        if bad := forbidden_names(out):
            raise ValueError(f"columns that tell of the future: {bad}")
        out += self.state
        if len(out) != len(set(out)):
            raise ValueError("repeated observation columns")
        return out


def observation_features(df: DataFrame, mode: str, market: Sequence[str]) -> list[str]:
    """The feature columns of a mode; raw prices and forward columns are never features."""
    known = [c for c in market if c in df.columns and c not in RAW and not c.endswith("_fwd")]
    regime = tuple(regime_columns(df.columns)) if mode != "market_only" else ()
    return ObservationContract(mode, tuple(known), regime, ()).columns()


def forward_column(names: Sequence[str], wanted: str | None = None) -> str | None:
    """The forward return's column: the wanted one, the usual name, or the first by name that ends in _fwd."""
    if wanted in names:
        return wanted
    return FORWARD if FORWARD in names else next((n for n in sorted(names) if n.endswith("_fwd")), None)


def contract_columns(contract: Mapping[str, Sequence[str]], kind: str, with_hat: bool = False) -> list[str]:
    """A list of a pack's contract: `agent_observable`, `provenance_only`, `audit_only` or `forbidden`."""
    key = f"{kind}_columns_v1"
    if key not in contract:
        raise KeyError(key)
    return [c for c in contract[key] if with_hat or c != "z_hat_filter"]


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df with the named columns in order; raises on missing or repeated ones."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if len(set(names)) != len(names):
        raise ValueError("repeated columns")
    return df.select(*names)


def first_existing(names: Sequence[str], wanted: Sequence[str]) -> str | None:
    return next((w for w in wanted if w in names), None)
