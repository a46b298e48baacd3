"""Adapters by stage and name, their configuration, and the precedence of settings."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

STAGES = ("walker", "chunker", "language-chunker", "enricher", "embedder", "storage", "retrieval", "retrieval-stream", "reranker")
_KNOWN: dict[tuple[str, str], tuple[Callable, dict]] = {}


def register(stage: str, name: str, **defaults):
    """Decorator: the function makes the adapter from its settings, whose names and defaults are given here."""
    if stage not in STAGES:
        raise ValueError(f"no stage {stage}; stages are {', '.join(STAGES)}")

    def add(make: Callable) -> Callable:
        if (stage, name) in _KNOWN:
            raise ValueError(f"{stage} {name} is registered already")
        _KNOWN[stage, name] = (make, defaults)
        return make

    return add


def available(stage: str | None = None) -> list[tuple[str, str]]:
    return sorted(k for k in _KNOWN if stage in (None, k[0]))


def settings(stage: str, name: str, given: Mapping | None = None) -> dict:
    """The adapter's defaults with the given values; unknown names are errors."""
    if (stage, name) not in _KNOWN:
        raise ValueError(f"no {stage} named {name}; there are {[n for _, n in available(stage)]}")
    defaults = _KNOWN[stage, name][1]
    unknown = sorted(set(given or {}) - set(defaults))
    if unknown:
        raise ValueError(f"{stage} {name} has no settings {unknown}")
    return defaults | dict(given or {})


def build(stage: str, name: str, given: Mapping | None = None):
    return _KNOWN[stage, name][0](**settings(stage, name, given))


def adapter_id(stage: str, name: str, given: Mapping | None = None) -> str:
    """Name and settings as one string, so that a stored row tells when either has changed."""
    own = settings(stage, name, given)
    return name if not own else f"{name}:{hashlib.sha256(json.dumps(own, sort_keys=True, default=str).encode()).hexdigest()[:12]}"


def merged(*layers: Mapping) -> dict:
    """Nested settings; later layers win, mapping by mapping."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def from_environment(env: Mapping[str, str], prefix: str = "QUILLMESH_") -> dict:
    """``QUILLMESH_STAGE__KEY=value`` as nested settings; values are read as JSON where they are."""
    out: dict = {}
    for name, value in sorted(env.items()):
        if not name.startswith(prefix) or "__" not in name:
            continue
        *path, last = name.removeprefix(prefix).lower().split("__")
        at = out
        for p in path:
            at = at.setdefault(p, {})
        try:
            at[last] = json.loads(value)
        except ValueError:
            at[last] = value
    return out


def resolve(defaults: Mapping, user: Mapping, project: Mapping, env: Mapping[str, str], command: Mapping) -> dict:
    """Defaults, then the user's, the project's, the environment's and the command's settings."""
    return merged(defaults, user, project, from_environment(env), command)


def problems(config: Mapping) -> list[str]:
    """What is wrong with a configuration of ``stage: {adapter, config}``; empty if nothing is."""
    out = []
    for stage, own in config.items():
        try:
            if stage not in STAGES:
                raise ValueError(f"no stage {stage}")
            settings(stage, own.get("adapter", ""), own.get("config"))
        except ValueError as e:
            out.append(str(e))
    return out
