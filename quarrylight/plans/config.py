"""Configuration in layers (core, project, experiment) with required values and overrides."""

from __future__ import annotations

import re
from pathlib import Path
from typing import Any

import yaml

from quarrylight.sources.records import read_yaml_mapping

REQUIRED = "???"


def merge(*layers: dict) -> dict:
    """Mappings merged deeply; the later wins."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def override(config: dict, assignments: list[str]) -> dict:
    """``a.b=value`` assignments applied, values read as YAML."""
    for text in assignments:
        path, equals, value = text.partition("=")
        if not equals:
            raise ValueError(f"{text!r} isn't name=value")
        node: dict = {}
        leaf = node
        *parents, last = path.split(".")
        for p in parents:
            leaf[p] = {}
            leaf = leaf[p]
        leaf[last] = yaml.safe_load(value)
        config = merge(config, node)
    return config


def resolve(config: dict) -> dict:
    """References ``${a.b}`` replaced; a value that is required but missing, or a circle, raises."""

    def look(path: str, seen: tuple[str, ...]) -> Any:
        if path in seen:
            raise ValueError(f"{path} refers to itself")
        node: Any = config
        for part in path.split("."):
            if not isinstance(node, dict) or part not in node:
                raise KeyError(path)
            node = node[part]
        return walk(node, (*seen, path))

    def walk(node: Any, seen: tuple[str, ...]) -> Any:
        if isinstance(node, dict):
            return {k: walk(v, seen) for k, v in node.items()}
        if isinstance(node, list):
            return [walk(v, seen) for v in node]
        if not isinstance(node, str):
            return node
        if node == REQUIRED:
            raise ValueError("a required value is missing")
        if whole := re.fullmatch(r"\$\{([\w.]+)\}", node):
            return look(whole[1], seen)
        return re.sub(r"\$\{([\w.]+)\}", lambda m: str(look(m[1], seen)), node)

    return walk(config, ())


def load(*paths: str | Path, overrides: list[str] | None = None) -> dict:
    """The files' mappings in order of rising precedence, with overrides, resolved."""
    return resolve(override(merge(*(read_yaml_mapping(p) for p in paths)), overrides or []))
