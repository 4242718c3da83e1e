"""All constants of scoring, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    pool_share: dict = field(default_factory=lambda: {"ai_search:fast": 0.54, "ai_search:balanced": 0.18, "ai_search:deep": 0.18, "x_search": 0.10})
    threshold: dict = field(default_factory=lambda: {"ai_search": 0.50, "x_search": 0.60})
    ramp_width: float = 0.05
    quality_power: float = 3.0
    volume_power: float = 2.0
    least_samples: int = 3
    synthetic_weight: float = 5.0
    organic_weight: float = 15.0
    burn_share: float = 0.5
    ema: float = 0.5
    capacity_cap: int = 100
    capacity_step: float = 0.1
    decay: float = 0.9
    tick_seconds: int = 300
    budget: dict = field(default_factory=lambda: {"fast": 5.0, "balanced": 15.0, "deep": 30.0})
    perf_floor: dict = field(default_factory=lambda: {"fast": 0.40, "balanced": 0.50, "deep": 0.85})
    perf_floor_ai: float = 0.50
    perf_floor_x: float = 0.70
    component_floor: float = 0.30
    content_weight: float = 0.60
    summary_weight: float = 0.40
    numeric_slack: float = 0.60
    least_slack: int = 10
    rate_limit: int = 500
    rate_seconds: int = 60
    log_groups: int = 20
    log_rows: int = 500
    article_chars: int = 16000
    usable_chars: int = 200
    sampled_links: int = 3
    chunk_tokens: int = 2
    token_penalty: float = 0.01
    least_alpha: float = 20.0
    least_stake: float = 20000.0
    cache_seconds: int = 600
    cache_entries: int = 2000
    mode_tools: dict = field(default_factory=lambda: {"fast": {"web": 1.0}, "balanced": {"web": 0.5, "posts": 0.5}, "deep": {"web": 0.5, "posts": 0.5}})
    result_types: dict = field(default_factory=lambda: {"LINKS_WITH_FINAL_SUMMARY": 0.8, "ONLY_LINKS": 0.2})


CONFIG = Config()
