"""Settings from the environment, then ./.env, then a user's file; the first that names a setting decides."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

PREFIX = "QUILLGRAPH_"


@dataclass(frozen=True)
class Settings:
    max_file_bytes: int = 1_048_576
    chunk_lines: int = 200
    chunk_overlap: int = 5
    embedding: str = "hash"
    embedding_dim: int = 384
    embedding_batch: int = 64
    embedding_max_chars: int = 120_000
    tool_timeout: float = 20.0
    query_timeout: float = 30.0


def parse_env(text: str) -> dict[str, str]:
    """Lines of NAME=value; comments, `export` and quotes are allowed."""
    out = {}
    for line in text.splitlines():
        line = line.strip().removeprefix("export ").strip()
        if line and not line.startswith("#") and "=" in line:
            name, _, value = line.partition("=")
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def load(environment: Mapping[str, str] | None = None, files: tuple[str, ...] = (".env", "~/.config/quillgraph/env")) -> Settings:
    layers: list[Mapping[str, str]] = [os.environ if environment is None else environment]
    for f in files:
        path = os.path.expanduser(f)
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as handle:
                layers.append(parse_env(handle.read()))
    given = {}
    for name, default in ((f, getattr(Settings, f)) for f in Settings.__dataclass_fields__):
        raw = next((layer[PREFIX + name.upper()] for layer in layers if layer.get(PREFIX + name.upper(), "") != ""), None)
        if raw is None:
            continue
        try:
            given[name] = type(default)(raw)
        except ValueError:
            raise ValueError(f"{PREFIX}{name.upper()} must be {type(default).__name__}, not {raw!r}") from None
    return Settings(**given)
