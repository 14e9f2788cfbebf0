"""Behavioural constants. Every plan takes them from here; ``as_of`` replaces the wall clock."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    # Weights, thresholds and windows of the scoring rules.
    component_weights: dict[str, float] = field(default_factory=lambda: {"ssn": 0.25, "graph": 0.30, "velocity": 0.20, "credit": 0.15, "device": 0.10})
    velocity_weights: dict[str, float] = field(default_factory=lambda: {"address": 0.25, "phone": 0.35, "email": 0.20, "device": 0.20})
    ensemble_weights: dict[str, float] = field(default_factory=lambda: {"synthetic": 0.40, "velocity": 0.20, "credit": 0.15, "au": 0.15, "bust_out": 0.10})
    match_weights: dict[str, float] = field(default_factory=lambda: {"ssn": 1.0, "name": 0.3, "address": 0.4, "phone": 0.3, "email": 0.2})
    link_weights: dict[str, float] = field(default_factory=lambda: {"ssn": 1.0, "device": 0.7, "phone": 0.6, "email": 0.5, "address": 0.4})
    velocity_caps: dict[str, int] = field(default_factory=lambda: {"address": 5, "phone": 3, "email": 2, "device": 3})
    other_velocity_cap: int = 5
    other_link_weight: float = 0.3
    match_threshold: float = 0.85
    bust_out_threshold: float = 0.75
    min_cluster_size: int = 3
    retention_days: int = 180
    application_retention_days: int = 90
    max_fanout: int = 1000


CONFIG = EngineConfig()
