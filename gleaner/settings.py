"""Settings with their checks; each can be overridden from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

PREFIX = "GLEANER_"


@dataclass(frozen=True)
class RetrievalSettings:
    top_k: int = 8
    candidates: int = 40
    rrf_k: int = 60
    dense_weight: float = 0.6
    rerank: bool = True
    floor: float = 0.35
    mmr_lambda: float = 0.7
    k1: float = 1.5
    b: float = 0.75
    budget_chars: int = 12_000
    max_query_chars: int = 2_000

    def __post_init__(self) -> None:
        for name in ("top_k", "candidates", "rrf_k", "budget_chars", "max_query_chars"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        for name in ("dense_weight", "floor", "mmr_lambda", "b"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie between 0 and 1")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, **overrides: object) -> RetrievalSettings:
        """The defaults, then the environment (what doesn't parse is ignored), then the overrides; all of it checked."""
        env = os.environ if env is None else env
        found: dict[str, object] = {}
        for f in fields(cls):
            raw = env.get(PREFIX + f.name.upper())
            if raw is None:
                continue
            try:
                kind = type(f.default)
                found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
            except ValueError:
                continue
        return cls(**{**found, **overrides})
