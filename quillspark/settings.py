"""The configuration of a run: seed, generation, splits and paths, checked when it is read."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class Generation:
    backend: str = "echo"
    target_pairs: int = 1000
    encounter_filter: str = "vitals"
    batch_size: int = 512


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    generation: Generation = field(default_factory=Generation)
    splits: Mapping[str, int] = field(default_factory=dict)
    paths: Mapping[str, str] = field(default_factory=dict)


def _made(kind, values: Mapping, where: str):
    known = {f.name for f in fields(kind)}
    if odd := sorted(set(values) - known):
        raise ValueError(f"unknown setting(s) {odd} in {where}; there are {sorted(known)}")
    return kind(**values)


def settings(values: Mapping) -> Settings:
    """Settings from nested mappings; what is missing has its default, what isn't known raises."""
    values = dict(values)
    if "generation" in values:
        values["generation"] = _made(Generation, values["generation"], "generation")
    out = _made(Settings, values, "the configuration")
    if bad := {k: v for k, v in out.splits.items() if not isinstance(v, int) or v < 0}:
        raise ValueError(f"split targets must be whole numbers from 0: {bad}")
    return out


def load(path: str) -> Settings:
    """Settings from a JSON file, or a YAML file where a YAML reader is installed."""
    body = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return settings(json.loads(body))
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError(f"no YAML reader is installed; write {path} as JSON") from e
    return settings(yaml.safe_load(body) or {})
