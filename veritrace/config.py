"""Frozen settings of the audit. Values that published results depend on are fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field
from types import MappingProxyType


@dataclass(frozen=True)
class GateLimits:
    """What passes a gate, and the bounds of its verdict (go, abandon) in the metric's better direction."""

    direction: str
    passes: float
    go: float | None
    abandon: float
    least_n: int = 30


@dataclass(frozen=True)
class Settings:
    # Fixed values
    seed: int = 20260903
    bootstrap_b: int = 10_000
    ci: tuple[float, float] = (0.025, 0.975)
    effect_deltas: tuple[float, ...] = (0.02, 0.03)
    power: float = 0.80
    alpha: float = 0.05
    flip_threshold: float = 0.80
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    recall_k: int = 5
    token_block: int = 256
    budgets: tuple[int, ...] = (1024, 4096)
    granularities: tuple[str, ...] = ("sentence", "paragraph", "token256")
    era_width: int = 20
    signature_words: int = 6
    signature_min_len: int = 4
    signature_df_share: float = 0.08
    signature_overlap: int = 2
    kappa_min: float = 0.8
    #: residual limits of gate 2 for one hop, several hops, and large models
    residual: tuple[float, float, float] = (0.05, 0.08, 0.15)
    sequential: tuple[int, float, float] = (50, 0.05, 0.15)
    gates: MappingProxyType = field(
        default_factory=lambda: MappingProxyType(
            {
                1: GateLimits("lower", 0.02, 0.02, 0.35),
                2: GateLimits("lower", 0.05, None, 0.15),
                3: GateLimits("lower", 0.03, 0.03, 0.10),
                4: GateLimits("higher", 0.90, None, 0.55),
            }
        )
    )
    retain_min: float = 0.90
    large_model_compliance: float = 0.85
    # Switches, off by default
    strict_numeric: bool = False
    strict_era: bool = False
    strict_entity: bool = False
    strict_entity_type: bool = False


SETTINGS = Settings()
