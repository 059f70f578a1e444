"""Settings in layers: environment, file, a vendor's usual variable, default."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

PREFIX = "LECTERN_"
# Settings with default and, for keys, the vendor's usual variable.
FIELDS: dict[str, tuple[str, str | None]] = {
    "storage_root": ("", None), "llm_provider": ("fake", None), "llm_model": ("", None), "llm_effort": ("", None), "embedding_provider": ("fake", None), "embedding_model": ("", None),
    "anthropic_api_key": ("", "ANTHROPIC_API_KEY"), "openai_api_key": ("", "OPENAI_API_KEY"), "gemini_api_key": ("", "GEMINI_API_KEY"), "jdbc_url": ("", None), "vectors_path": ("", None), "tokenizers": ("/opt/tokenizers", None),
}
PROVIDERS = ("fake", "anthropic", "openai", "gemini")


class ConfigError(ValueError):
    """A setting that does not exist or cannot have this value."""


@dataclass(frozen=True)
class Value:
    value: str
    source: str


def resolve(home: Path, env: Mapping[str, str] = os.environ) -> dict[str, Value]:
    """Every setting with where it comes from; a variable that is set but empty still wins."""
    path = home / "config.toml"
    stored = tomllib.loads(path.read_text()) if path.exists() else {}
    unknown = sorted(set(stored) - set(FIELDS))
    if unknown:
        raise ConfigError(f"unknown settings in {path}: {', '.join(unknown)}")
    out = {}
    for name, (default, usual) in FIELDS.items():
        variable = PREFIX + name.upper()
        if variable in env:
            out[name] = Value(env[variable], "environment")
        elif name in stored:
            out[name] = Value(str(stored[name]), "file")
        elif usual and usual in env:
            out[name] = Value(env[usual], usual)
        else:
            out[name] = Value(default or (str(home / "data") if name == "storage_root" else default), "default")
    return out


def write(home: Path, name: str, value: str | None) -> None:
    """Set or, with None, unset a setting in the file; its other lines and comments stay; only the owner may read it."""
    if name not in FIELDS:
        raise ConfigError(f"unknown setting {name}")
    if value is not None and name.endswith("_provider") and value not in PROVIDERS:
        raise ConfigError(f"{name} must be one of {', '.join(PROVIDERS)}")
    path = home / "config.toml"
    home.mkdir(parents=True, exist_ok=True)
    lines = path.read_text().splitlines() if path.exists() else []
    kept = [x for x in lines if x.split("=", 1)[0].strip() != name]
    if value is not None:
        escaped = value.replace("\\", "\\\\").replace('"', '\\"')
        new = f'{name} = "{escaped}"'
        at = next((i for i, x in enumerate(lines) if x.split("=", 1)[0].strip() == name), len(kept))
        kept.insert(at, new)
    path.touch(mode=0o600)
    path.write_text("\n".join(kept) + "\n" if kept else "")
    path.chmod(0o600)


def redact(value: str) -> str:
    return "****" if len(value) <= 8 else f"{value[:4]}…{value[-4:]}"


def shown(values: dict[str, Value]) -> list[tuple[str, str, str]]:
    return [(n, redact(v.value) if n.endswith("_key") and v.value else v.value, v.source) for n, v in values.items()]
