"""Data contracts.

A :class:`FlowSpec` describes one kind of labelled flow table: its feature
profiles, identity columns, label map and classes. Operators take a spec, never
hard-coded column names, so the same jobs run over any table with such a spec.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

TARGET = "threat_class"
CAPTURE_TS = "capture_timestamp"

RELIABLE, DEGRADED, UNRELIABLE, UNKNOWN = "RELIABLE", "DEGRADED", "UNRELIABLE", "UNKNOWN"
RELIABILITY_TIERS = (RELIABLE, DEGRADED, UNRELIABLE, UNKNOWN)
OOD_CLASS = "UNKNOWN_OOD"
UNKNOWN_CLASS = "UNKNOWN"


class ContractError(ValueError):
    """A table lacks (or, when asked, has too many) columns for a profile."""

    def __init__(self, missing: Sequence[str], extra: Sequence[str] = ()):
        self.missing, self.extra = list(missing), list(extra)
        super().__init__(f"feature contract violated: missing={self.missing} extra={self.extra}")


@dataclass(frozen=True)
class Rule:
    """One evidence rule: a feature, how it must stand out, and what that means."""

    feature: str
    direction: str  # high | low | near | nonstandard
    why: str


@dataclass(frozen=True)
class FlowSpec:
    name: str
    profiles: Mapping[str, tuple[str, ...]]
    default_profile: str
    label_column: str
    label_map: Mapping[str, str | None]
    classes: tuple[str, ...]
    identity: tuple[str, ...] = ()
    evidence_extras: tuple[str, ...] = ()
    timestamp_column: str | None = None
    benign: str = "BENIGN"

    @property
    def profile_features(self) -> tuple[str, ...]:
        """Union of all profiles' features, first occurrence first."""
        return tuple(dict.fromkeys(f for p in self.profiles.values() for f in p))

    @property
    def numeric_columns(self) -> tuple[str, ...]:
        return tuple(sorted({*self.profile_features, *self.evidence_extras}))

    @property
    def retained(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.identity, *self.numeric_columns, self.label_column)))

    def features(self, profile: str | None = None) -> list[str]:
        name = (profile or self.default_profile).strip().upper()
        if name not in self.profiles:
            raise ValueError(f"unknown profile {profile!r}; choose from {sorted(self.profiles)}")
        return list(self.profiles[name])


@dataclass(frozen=True)
class SeverityPolicy:
    bands: tuple[tuple[float, str], ...] = (
        (0.0, "LOW"), (0.5, "MEDIUM"), (0.75, "HIGH"), (0.9, "CRITICAL"))
    ladder: tuple[str, ...] = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
    escalate: tuple[str, ...] = ("DDoS", "Botnet")
    benign: str = "BENIGN"
    benign_severity: str = "INFO"
    ood_severity: str = "HIGH"
    alertable: tuple[str, ...] = ("MEDIUM", "HIGH", "CRITICAL")


@dataclass(frozen=True)
class TrainingPolicy:
    test_share: float = 0.25
    trees: int = 60
    max_depth: int | None = 20
    min_leaf: int = 1
    class_cap: int | None = 50_000
    seed: int = 42


@dataclass(frozen=True)
class NoveltyPolicy:
    trees: int = 100
    sample_rows: int = 256
    contamination: float = 0.01
    min_rows: int = 1_000
    drives_verdict: bool = False


@dataclass(frozen=True)
class Bound:
    lower: float
    upper: float
    median: float


@dataclass(frozen=True)
class DistributionReference:
    """Per-feature range of the training split. One small entry per feature, so
    its size is fixed by the spec and it is folded into plans as literals."""

    features: tuple[str, ...]
    bounds: Mapping[str, Bound]
    quantile: float = 0.001
    n_training_rows: int = 0
    min_violations: int = 2
    novelty: Mapping[str, float] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({**asdict(self), "bounds": {k: asdict(v) for k, v in self.bounds.items()}})

    @staticmethod
    def from_json(text: str) -> "DistributionReference":
        raw = json.loads(text)
        raw["features"] = tuple(raw["features"])
        raw["bounds"] = {k: Bound(**v) for k, v in raw["bounds"].items()}
        return DistributionReference(**raw)


@dataclass(frozen=True)
class EvidencePolicy:
    """What evidence quotes: rules per class, medians per (feature, class), units."""

    rules: Mapping[str, tuple[Rule, ...]]
    medians: Mapping[str, Mapping[str, float]]
    units: Mapping[str, str] = field(default_factory=dict)
    aggregate_notes: Mapping[str, str] = field(default_factory=dict)
    port_features: tuple[str, ...] = ()
    duration_features: tuple[str, ...] = ()
    well_known_ports: Mapping[int, str] = field(default_factory=dict)
    high_ratio: float = 3.0
    low_ratio: float = 0.34
    near_tolerance: float = 0.35
    max_items: int = 4
    min_items: int = 2
    benign: str = "BENIGN"
