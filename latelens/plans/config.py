"""Configurations with exact keys and strict types."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

from latelens.errors import ConfigError


def parsed(kind: type, value: Any):
    """value as a dataclass of that kind: no key missing without a default, none unknown, bools no numbers."""
    if not isinstance(value, dict):
        raise ConfigError("NOT_AN_OBJECT", f"{kind.__name__} wants an object")
    fields = {f.name: f for f in dataclasses.fields(kind)}
    if extra := sorted(set(value) - set(fields)):
        raise ConfigError("UNKNOWN_KEYS", ", ".join(extra))
    required = {n for n, f in fields.items() if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING}
    if missing := sorted(required - set(value)):
        raise ConfigError("MISSING_KEYS", ", ".join(missing))
    names = {"int": int, "float": (int, float), "str": str, "bool": bool}
    for k, v in value.items():
        want = names.get(str(fields[k].type))
        if want and (not isinstance(v, want) or isinstance(v, bool) and want is not bool):
            raise ConfigError("WRONG_TYPE", f"{k} wants {fields[k].type}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in value.items()})


def read(kind: type, path: str):
    with open(path, encoding="utf-8") as f:
        return parsed(kind, json.load(f))


def digest(config) -> str:
    return hashlib.sha256(json.dumps(dataclasses.asdict(config), sort_keys=True).encode()).hexdigest()


@dataclass(frozen=True)
class DataConfig:
    path: str
    separator: str = "\t"
    header: bool = False
    min_span_days: float = 89
    max_span_days: float = 91
    max_delay_days: float = 30


@dataclass(frozen=True)
class FeaturePolicy:
    seed: int = 20_260_813
    large_buckets: int = 1 << 18
    small_buckets: int = 1 << 12
    burn_in_last_day: int = 14
    low_quantile: float = 0.01
    high_quantile: float = 0.99
    large_fields: tuple = ("product_id", "user_id", "product_title", "audience_id")


@dataclass(frozen=True)
class RunConfig:
    strategy: str = "fixed_wait"
    wait_seconds: int = 86_400
    maturity_seconds: int = 30 * 86_400
    steps_per_credit: int = 4
    learning_rate: float = 0.1
    decision_times: tuple = field(default_factory=tuple)
