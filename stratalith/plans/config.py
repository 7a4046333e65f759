"""Settings: defaults, file, environment, overrides, in rising precedence."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from pathlib import Path
from typing import Any

import yaml

from stratalith.errors import ConfigError

FILES = ("stratalith.yaml", "stratalith.yml", "stratalith.json", ".config/stratalith.yaml", ".config/stratalith.json")
PREFIX = "STRATALITH_"


@dataclass(frozen=True)
class Settings:
    """All settings with their defaults."""

    dialect: str = "spark"
    schema_path: str = "schema"
    output_dir: str = "schema"
    mode: str = "schema_only"
    log_level: str = "info"
    embedder: str = "hashed"
    dimensions: int = 64
    index_path: str = "index"
    retrieval_k: int = 8
    retrieval_threshold: int = 30
    chunk_chars: int = 1000
    row_cap: int = 500


def _typed(name: str, value: Any) -> Any:
    kind = type(getattr(Settings(), name))
    if kind is int:
        try:
            number = int(value)
        except (TypeError, ValueError):
            number = 0
        if number < 1:
            raise ConfigError(f"{name} is a positive whole number", "INVALID_SETTING")
        return number
    return str(value)


def load_settings(folder: str = ".", environment: Mapping[str, str] | None = None, **overrides: Any) -> Settings:
    """Settings of a project folder. Blank values count as unset; unknown names in the file are errors."""
    known = {f.name for f in fields(Settings)}
    found = next((p for p in (Path(folder) / f for f in FILES) if p.exists()), None)
    layers: list[dict[str, Any]] = []
    if found:
        raw = json.loads(found.read_text()) if found.suffix == ".json" else yaml.safe_load(found.read_text())
        if not isinstance(raw, dict) or set(raw) - known:
            raise ConfigError("the settings file has unknown names", "INVALID_SETTING")
        layers.append(raw)
    env = os.environ if environment is None else environment
    layers += [{n: env.get(PREFIX + n.upper(), "") for n in known}, overrides]
    out = Settings()
    for layer in layers:
        out = replace(out, **{n: _typed(n, v) for n, v in layer.items() if n in known and v is not None and str(v).strip()})
    return out


def required(name: str, environment: Mapping[str, str] | None = None) -> str:
    """An environment value that must be there and not blank."""
    value = (os.environ if environment is None else environment).get(name, "").strip()
    if not value:
        raise ConfigError(f"{name} isn't set", "MISSING_SETTING")
    return value
