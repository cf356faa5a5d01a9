"""Settings from the environment, checked once."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

TRUE = {"1", "true", "yes", "y", "on"}


@dataclass(frozen=True)
class Settings:
    vector_top_k: int = 100
    bm25_top_k: int = 100
    rrf_top_k: int = 64
    final_top_k: int = 5
    score_threshold: float = 0.0
    chunk_target_tokens: int = 800
    chunk_max_tokens: int = 1000
    overlap_target_tokens: int = 100
    overlap_max_tokens: int = 200
    history_recent_turns: int = 3
    history_max_messages: int = 40
    search_query_max_chars: int = 3000
    rerank_batch: int = 64
    retain_versions: int = 2
    failure_threshold: int = 2
    recovery_threshold: int = 2
    router_enabled: bool = True

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if not isinstance(v, bool) and v < (0 if f.name in ("score_threshold", "overlap_target_tokens", "overlap_max_tokens", "history_recent_turns", "history_max_messages") else 1):
                raise ValueError(f"{f.name} is too small: {v}")
        if self.chunk_target_tokens > self.chunk_max_tokens or self.overlap_target_tokens > self.overlap_max_tokens:
            raise ValueError("targets must not exceed limits")
        if not 1 <= self.final_top_k <= 20 or max(self.vector_top_k, self.bm25_top_k) > 1000:
            raise ValueError("top-k limits: final 1 to 20, recall to 1000")

    @property
    def fused_k(self) -> int:
        return max(self.rrf_top_k, self.final_top_k)


def from_environment(prefix: str = "QUILL_", env: dict[str, str] | None = None) -> Settings:
    env = dict(os.environ) if env is None else env
    values = {}
    for f in fields(Settings):
        raw = env.get(prefix + f.name.upper(), "").strip()
        if raw:
            kind = type(f.default)
            values[f.name] = raw.lower() in TRUE if kind is bool else kind(raw)
    return Settings(**values)
