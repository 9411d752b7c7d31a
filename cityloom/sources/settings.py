"""Layered settings: defaults, presets (each on its base), includes, then the city's own, as plain dicts."""

from __future__ import annotations

import copy
import tomllib
from collections.abc import Callable
from pathlib import Path

REQUIRED = ("name", "utm_epsg", "districts")


def merged(base: dict, over: dict, append: bool = False) -> dict:
    """Tables merge by key, all else is replaced; append: arrays of tables are joined."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        old = out.get(key)
        tables = isinstance(value, list) and isinstance(old, list) and all(isinstance(x, dict) for x in [*value, *old])
        if isinstance(value, dict) and isinstance(old, dict):
            out[key] = merged(old, value, append)
        elif append and tables:
            out[key] = old + copy.deepcopy(value)
        else:
            out[key] = copy.deepcopy(value)
    return out


def preset(name: str, load: Callable[[str], dict], path: tuple[str, ...] = ()) -> dict:
    """A preset on top of its `base`; names in its `replace` are taken whole, not merged."""
    if name in path:
        raise ValueError(f"presets build on each other: {' -> '.join([*path, name])}")
    own = load(name)
    below = preset(own["base"], load, (*path, name)) if "base" in own else {}
    for key in own.get("replace", []):
        below.pop(key, None)
    return merged(below, {k: v for k, v in own.items() if k not in ("base", "replace")})


def filled(value, names: dict):
    """{name} in strings, at any depth, replaced."""
    if isinstance(value, str):
        for k, v in names.items():
            value = value.replace("{" + k + "}", str(v))
        return value
    if isinstance(value, dict):
        return {k: filled(v, names) for k, v in value.items()}
    return [filled(v, names) for v in value] if isinstance(value, list) else value


def resolve(defaults: dict, city: dict, load: Callable[[str], dict], includes: tuple[dict, ...] = ()) -> dict:
    out = merged(defaults, preset(city["preset"], load)) if "preset" in city else copy.deepcopy(defaults)
    for part in includes:
        out = merged(out, part, append=True)
    out = merged(out, city)
    if missing := [k for k in REQUIRED if k not in out]:
        raise ValueError(f"settings lack {', '.join(missing)}")
    return filled(out, {"name": out["name"]})


def read_toml(path: str | Path) -> dict:
    return tomllib.loads(Path(path).read_text())
