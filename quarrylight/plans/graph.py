"""Pipelines as graphs of named operators; running one only composes lazy plans."""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Registry:
    """Operators by name; later layers (a project, an experiment) override earlier ones."""

    def __init__(self, *layers: dict[str, Callable]):
        self.layers = list(layers) or [{}]

    def add(self, name: str, operator: Callable) -> None:
        self.layers[-1][name] = operator

    def layer(self) -> Registry:
        return Registry(*self.layers, {})

    def find(self, name: str) -> Callable:
        """The operator of a name, or of an import path ``module:function``."""
        for layer in reversed(self.layers):
            if name in layer:
                return layer[name]
        if ":" in name:
            module, _, attribute = name.partition(":")
            return getattr(importlib.import_module(module), attribute)
        raise KeyError(f"unknown operator {name!r}")


def boundary(spark: SparkSession, rows: DataFrame | None, schema: StructType) -> DataFrame:
    """The input or output of a graph as it is; None is an empty table of the schema."""
    return spark.createDataFrame([], schema) if rows is None else rows


@dataclass
class Pipeline:
    """``components``: name -> (operator, options). ``connections``: ``a.output -> b.input``.

    An operator is called with its inputs and options by name. It returns one value, its
    output ``out``, or a dict of outputs. What no connection provides comes from the call.
    """

    components: dict[str, tuple[Callable, dict[str, Any]]] = field(default_factory=dict)
    connections: list[tuple[str, str]] = field(default_factory=list)

    @classmethod
    def from_config(cls, config: dict, registry: Registry) -> Pipeline:
        """Components ``{name: {operator, options}}``, connections as ``{from, to}``; unknown parts raise."""
        made = cls({n: (registry.find(c["operator"]), dict(c.get("options") or {})) for n, c in (config.get("components") or {}).items()})
        for c in config.get("connections") or []:
            made.connect(c["from"], c["to"])
        return made

    def add(self, name: str, operator: Callable, **options: Any) -> Pipeline:
        if name in self.components:
            raise ValueError(f"component {name!r} exists")
        self.components[name] = (operator, options)
        return self

    def connect(self, source: str, target: str) -> Pipeline:
        for end in (source, target):
            if end.partition(".")[0] not in self.components:
                raise ValueError(f"connection of an unknown component: {end}")
        name, _, socket = target.partition(".")
        accepted = inspect.signature(self.components[name][0]).parameters
        if socket not in accepted and not any(p.kind is p.VAR_KEYWORD for p in accepted.values()):
            raise ValueError(f"{name!r} has no input {socket!r}")
        if any(t == target for _, t in self.connections):
            raise ValueError(f"{target} is connected already")
        self.connections.append((source, target))
        return self

    def order(self) -> list[str]:
        """Components such that each comes after those it needs; a cycle raises."""
        needs = {n: {s.partition(".")[0] for s, t in self.connections if t.partition(".")[0] == n} for n in self.components}
        out: list[str] = []
        while len(out) < len(needs):
            ready = [n for n in needs if n not in out and needs[n] <= set(out)]
            if not ready:
                raise ValueError("the pipeline has a cycle")
            out += ready
        return out

    def run(self, inputs: dict[str, dict[str, Any]] | None = None) -> dict[str, dict[str, Any]]:
        """All outputs by component; ``inputs``: component -> input -> value."""
        results: dict[str, dict[str, Any]] = {}
        for name in self.order():
            operator, options = self.components[name]
            given = dict((inputs or {}).get(name, {}))
            for source, target in self.connections:
                at, _, socket = target.partition(".")
                if at == name:
                    maker, _, output = source.partition(".")
                    given[socket] = results[maker][output or "out"]
            found = operator(**options, **given)
            results[name] = found if isinstance(found, dict) else {"out": found}
        return results

    def diagram(self) -> str:
        """The graph as text for a diagram renderer."""
        lines = ["flowchart LR", *(f"  {n}[{n}]" for n in self.components)]
        return "\n".join([*lines, *(f"  {s.partition('.')[0]} -->|{t.partition('.')[2]}| {t.partition('.')[0]}" for s, t in self.connections)])
