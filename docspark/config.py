"""Settings from the environment, checked; wrong values fall back to their defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

MODES = ("product", "any", "off")


@dataclass(frozen=True)
class Config:
    workers: int = 5
    request_delay: float = 1.5
    max_crawl_depth: int = 5
    max_pages: int = 1500
    max_runtime_minutes: int = 120
    max_retries: int = 3
    max_consecutive_failures: int = 20
    domain_restriction: str = "product"
    create_redirects: bool = False
    include_resources: bool = True
    remove_h1: bool = False
    max_tags: int = 10
    top_terms: int = 5
    min_term_frequency: int = 3


#: Least and most of the bounded settings.
BOUNDS = {"workers": (1, 50), "request_delay": (0.1, 60.0), "max_crawl_depth": (0, 10), "max_retries": (0, 10), "max_consecutive_failures": (5, None), "max_pages": (1, None), "max_runtime_minutes": (1, None)}
#: Older names of modes.
ALIASES = {"strict": "product", "same-product": "any"}


def from_environment(env=None, prefix: str = "DOCSPARK_") -> tuple[Config, list[str]]:
    """The settings, and what was wrong with the values that were not taken."""
    env = os.environ if env is None else env
    values, wrong = {}, []
    for f in fields(Config):
        raw = env.get(prefix + f.name.upper())
        if raw is None:
            continue
        try:
            value = raw.strip().lower() in ("1", "true", "yes", "on") if f.type == "bool" else {"int": int, "float": float, "str": str}[f.type](raw)
            low, high = BOUNDS.get(f.name, (None, None))
            if (low is not None and value < low) or (high is not None and value > high):
                raise ValueError(f"not in {low}..{high}")
            if f.name == "domain_restriction":
                value = ALIASES.get(value, value)
                if value not in MODES:
                    raise ValueError(f"none of {MODES}")
            values[f.name] = value
        except ValueError as error:
            wrong.append(f"{f.name}: {error}")
    return Config(**values), wrong


def healthy(disk_free_gb: float, disk_used_percent: float, memory_free_gb: float, memory_used_percent: float, cpu_percent: float) -> dict[str, bool]:
    """Thresholds of the driver's health report."""
    return {"disk": disk_free_gb > 1 and disk_used_percent < 90, "memory": memory_free_gb > 0.5 and memory_used_percent < 85, "cpu": cpu_percent < 90}
