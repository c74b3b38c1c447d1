"""Settings that operators take as arguments."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Cache, quota and price settings of one gateway deployment."""

    ttl_s: int = 86400
    threshold: float = 0.75
    k: int = 3
    max_chars: int = 300
    quota: int = 100_000
    price_in_1k: float = 0.0005
    price_out_1k: float = 0.0015
    default_model: str = "qwen2.5:14b"
    default_user: str = "anonymous"
    truncate_factor: float = 1.5
    scale_up: float = 20.0
    scale_down: float = 5.0
    step_s: int = 5

    def __post_init__(self):
        if self.ttl_s <= 0 or self.k <= 0 or self.quota <= 0 or self.step_s <= 0:
            raise ValueError("ttl_s, k, quota and step_s must be positive")
        if not -1.0 <= self.threshold <= 1.0:
            raise ValueError("threshold is a cosine similarity")
