"""Configuration: YAML with `${NAME}` and `${NAME:-default}`, checked against a schema, errors named by place."""

from __future__ import annotations

import os
from collections.abc import Mapping
from pathlib import Path
from typing import Any

_PLUGIN = {"id": (str, True), "plugin": (str, True), "enabled": (bool, False), "config": (dict, False)}
#: Field: (type, required); nested dicts are closed objects, lists hold one kind of item.
SCHEMA: dict[str, Any] = {
    "version": (int, False),
    "core": (
        {
            "chunker": ({"strategy": (("recursive", "paragraph"), False), "chunk_size_tokens": (int, False), "overlap_tokens": (int, False)}, False),
            "router": ({"max_event_depth": (int, False), "idempotency_ttl": (str, False)}, False),
            "embeddings": ({"text": ({"provider": (str, False), "model": (str, False), "dimensions": (int, False)}, False), "image": ({"enabled": (bool, False), "provider": (str, False), "model": (str, False)}, False)}, False),
            "storage": ({"path": (str, False), "collection_prefix": (str, False)}, False),
        },
        False,
    ),
    "sources": ([_PLUGIN], False),
    "extractors": ([_PLUGIN], False),
}
CHUNKER = {"strategy": "recursive", "chunk_size_tokens": 512, "overlap_tokens": 50}


class ConfigError(ValueError):
    pass


def place(path: tuple) -> str:
    out = ""
    for p in path:
        out += f"[{p}]" if isinstance(p, int) else f".{p}" if out else str(p)
    return out or "<root>"


def filled(text: str, env: Mapping[str, str]) -> str:
    """text with each `${NAME}` and `${NAME:-default}` replaced; KeyError for a name that is not set and has no default.

    Whatever does not close, or holds something else than a name, stays as it is."""
    head, *rest = text.split("${")
    out = [head]
    for part in rest:
        inner, closed, tail = part.partition("}")
        name, default, value = inner.partition(":-")
        if not closed or not (name.isascii() and name.isidentifier()):
            out.append("${" + part)
        elif name in env or default:
            out.append(env.get(name, value) + tail)
        else:
            raise KeyError(name)
    return "".join(out)


def interpolate(value: Any, env: Mapping[str, str]) -> tuple[Any, list[str]]:
    """value with all its texts filled, and what could not be, each with its place."""
    missing = []

    def walk(at: tuple, v: Any) -> Any:
        if isinstance(v, str):
            try:
                return filled(v, env)
            except KeyError as e:
                missing.append(f"{place(at)}: the environment has no {e.args[0]}")
                return v
        if isinstance(v, Mapping):
            return {k: walk((*at, k), x) for k, x in v.items()}
        return [walk((*at, k), x) for k, x in enumerate(v)] if isinstance(v, list) else v

    return walk((), value), missing


def check(value: Any, kind: Any, path: tuple = ()) -> list[str]:
    """What is wrong, each with its place."""
    at = place(path)
    if isinstance(kind, dict):
        if not isinstance(value, dict):
            return [f"{at}: must be a mapping"]
        found = [f"{place((*path, k))}: unknown" for k in value if k not in kind]
        for k, (inner, required) in kind.items():
            if k in value:
                found += check(value[k], inner, (*path, k))
            elif required:
                found.append(f"{at}: {k} is missing")
        return found
    if isinstance(kind, list):
        if not isinstance(value, list):
            return [f"{at}: must be a list"]
        return [e for i, v in enumerate(value) for e in check(v, kind[0], (*path, i))]
    if isinstance(kind, tuple):
        return [] if value in kind else [f"{at}: must be one of {', '.join(kind)}"]
    good = isinstance(value, kind) and not (kind is int and isinstance(value, bool))
    return [] if good else [f"{at}: must be of type {kind.__name__}"]


def parse(raw: Any, env: Mapping[str, str] | None = None) -> dict:
    if not isinstance(raw, dict):
        raise ConfigError("the configuration must be a mapping")
    value, missing = interpolate(raw, os.environ if env is None else env)
    errors = missing or check(value, SCHEMA)
    if errors:
        raise ConfigError("; ".join(errors[:5]))
    return value


def load(path: str | Path, env: Mapping[str, str] | None = None) -> dict:
    import yaml

    try:
        raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        raise ConfigError(f"{path}: not found") from None
    except yaml.YAMLError as e:
        raise ConfigError(f"{path}: {e}") from None
    return parse(raw, env)


def chunker(config: Mapping | None = None, env: Mapping[str, str] | None = None) -> dict:
    """Chunker settings: the environment over the configuration over the defaults."""
    env = os.environ if env is None else env
    out = CHUNKER | dict(((config or {}).get("core") or {}).get("chunker") or {})
    for key, name in (("strategy", "CHUNK_STRATEGY"), ("chunk_size_tokens", "CHUNK_SIZE_TOKENS"), ("overlap_tokens", "CHUNK_OVERLAP_TOKENS")):
        if env.get(name):
            out[key] = env[name] if key == "strategy" else int(env[name])
    return out
