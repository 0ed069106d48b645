"""Settings of the application: JSON with keys in any case, then the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields


# Which variable sets which field.
VARIABLES = {
    "DETECTOR_MATRIX_URL": "matrix_url",
    "LLAMA_SERVER_URL": "llm_url",
    "DETECTOR_SAVE_DIR": "save_dir",
    "DETECTOR_ENABLE_DEBOUNCE": "enable_debounce",
    "DETECTOR_CLASSIFIER_PROFILE": "classifier_profile",
}


# Names of settings and their defaults.
@dataclass
class Config:
    matrix_url: str = "http://localhost:5000"
    llm_url: str = "http://localhost:3002"
    save_dir: str = "frames"
    enable_debounce: bool = False
    auto_switch: bool = True
    enable_llm_audio: bool = False
    llm_model_name: str = "local"
    output_settings: dict = field(default_factory=lambda: {"ad": {}, "content": {}})
    classifier_profile: str = "nascar_on_fox"
    phash_threshold: int = 10


def _as(kind: str, value: object) -> object:
    if kind == "bool" and isinstance(value, str):
        return value.strip().lower() in ("true", "1", "yes")
    return value


def parsed(text: str | None, env: Mapping[str, str]) -> Config:
    """Settings from a JSON text: unknown keys are ignored; the environment wins, and its true and false are read as such."""
    kinds = {f.name: str(f.type) for f in fields(Config)}
    found = {k.lower(): v for k, v in json.loads(text or "{}").items() if k.lower() in kinds}
    found |= {name: env[variable] for variable, name in VARIABLES.items() if variable in env}
    return Config(**{k: _as(kinds[k], v) for k, v in found.items()})


def load(path: str | None = None, env: Mapping[str, str] = os.environ) -> Config:
    """Settings from a file, if it is there, and the environment."""
    if path and os.path.exists(path):
        with open(path) as f:
            return parsed(f.read(), env)
    return parsed(None, env)
