"""Configuration trees: inheritance, environment, deep merge, validation."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path


def deep_merge(base: dict, over: dict) -> dict:
    """Mappings merge key by key, anything else is replaced; neither argument changes."""
    return base | {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def expand(value: object, env: dict[str, str] | None = None) -> object:
    """${NAME} and ${NAME:-default} in all strings; a name without value or default is an error."""
    env = os.environ if env is None else env
    if isinstance(value, dict):
        return {k: expand(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        if m[1] in env:
            return env[m[1]]
        if m[2] is None:
            raise KeyError(m[1])
        return m[2]

    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", one, value)


def load(path: str | Path, env: dict[str, str] | None = None, seen: tuple[Path, ...] = ()) -> dict:
    """A JSON or YAML tree whose `extends` names its parent; cycles are an error, an empty file is an empty tree.

    A parent is looked up beside the file, then beside each folder above it.
    """
    path = Path(path).resolve()
    if path in seen:
        raise ValueError("the configuration extends itself")
    tree = expand(_parse(path), env)
    parent = tree.pop("extends", None)
    if parent:
        places = [folder / parent for folder in path.parents]
        tree = deep_merge(load(next((p for p in places if p.exists()), places[0]), env, (*seen, path)), tree)
    return tree


def _parse(path: Path) -> dict:
    if path.suffix not in (".yaml", ".yml"):
        return json.loads(path.read_text())
    try:
        import yaml
    except ImportError:
        raise ValueError(f"{path.name}: PyYAML is not installed") from None
    return yaml.safe_load(path.read_text()) or {}


#: Rules by dotted path: (type, least, most).
Rules = dict[str, tuple[type, float | None, float | None]]


def problems(tree: dict, rules: Rules) -> list[str]:
    """What is wrong with a tree; booleans are no numbers."""
    out = []
    for path, (kind, low, high) in rules.items():
        value: object = tree
        for part in path.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        if value is None:
            out.append(f"{path}: missing")
        elif isinstance(value, bool) and kind is not bool or not isinstance(value, (kind, int) if kind is float else kind):
            out.append(f"{path}: not {kind.__name__}")
        elif low is not None and value < low or high is not None and value > high:
            out.append(f"{path}: out of range")
    return out
