"""Runs and their artifacts: folders of any Hadoop file system, each with one description.

A run is a folder below a root. ``resolved.json`` holds the configuration it was begun with;
``run.json``, written last, says that it is complete, what it made and from what. So a run
that died is never found, and everything of a run lies in one place, on a cluster too.
"""

from __future__ import annotations

import importlib.metadata
import json
import re
import subprocess
import sys
import time
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

from quarrylight import __version__
from quarrylight.session import _path, list_names, read_text
from quarrylight.sources.records import path_sha256, sha256_text, write_json

#: The characters that a name of a run, index or mapping can't have.
FORBIDDEN = r'/\:*?"<>|'
COMPLETE, CONFIG = "run.json", "resolved.json"


def valid_name(name: Any, what: str = "run id") -> str:
    """A name that is one safe folder name, without surrounding white space; raises otherwise."""
    text = "" if name is None else str(name).strip()
    if text in (".", "..") or not re.fullmatch(f"[^{re.escape(FORBIDDEN)}]+", text):
        raise ValueError(f"{what} must be one folder name, not {name!r}")
    return text


def slugify(text: str, fallback: str = "run") -> str:
    """A text as part of a name: other signs than letters, digits, point, dash and underscore become dashes."""
    return re.sub(r"[^A-Za-z0-9._-]+", "-", text).strip("-._") or fallback


@dataclass(frozen=True)
class Run:
    """One run below a root folder."""

    spark: SparkSession
    root: str
    name: str

    def __post_init__(self) -> None:
        object.__setattr__(self, "name", valid_name(self.name))

    def at(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), self.name, *parts])

    def begin(self, config: dict) -> Run:
        """Claims the folder, which must not exist, and writes the resolved configuration."""
        folder, fs = _path(self.spark, self.at())
        if fs.exists(folder):
            raise FileExistsError(self.at())
        fs.mkdirs(folder)
        write_json(self.spark, self.at(CONFIG), config)
        return self

    def put(self, name: str, value: Any) -> str:
        """Writes a value as JSON into the folder and returns its path."""
        return write_json(self.spark, self.at(name), value)

    def complete(self, stage: str, artifacts: dict[str, str], inputs: dict[str, str] | None = None, experiment: str | None = None) -> dict:
        """Describes and thereby completes the run; inputs that are files are named with their digest."""
        config = read_text(self.spark, self.at(CONFIG)) or ""
        about = {
            "stage": stage, "made": artifacts, "from": {k: _origin(self.spark, str(v)) for k, v in (inputs or {}).items()},
            "config_sha256": sha256_text(config), "at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "code": _code_version(),
        }
        if experiment:
            about["experiment"] = experiment
        self.put(COMPLETE, about)
        return about

    def about(self) -> dict:
        """The description of a completed run; raises where there is none."""
        text = read_text(self.spark, self.at(COMPLETE))
        if text is None:
            raise FileNotFoundError(f"no completed run {self.name!r} below {self.root}")
        return json.loads(text)

    def artifact(self, name: str) -> str:
        """The path of an artifact of exactly this run."""
        made = self.about().get("made") or {}
        if name not in made:
            raise KeyError(f"run {self.name!r} made no {name!r}")
        return made[name]


def _origin(spark: SparkSession, path: str) -> dict:
    found, fs = _path(spark, path)
    return {"path": path, "sha256": path_sha256(spark, path) if fs.exists(found) and fs.getFileStatus(found).isFile() else None}


def _code_version() -> dict:
    versions = {p: importlib.metadata.version(p) for p in ("pyspark", "numpy", "pyarrow")}
    head = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=False)
    return {"quarrylight": __version__, "python": sys.version.split()[0], **versions, "commit": head.stdout.strip() or None}


def discover(spark: SparkSession, root: str, **matches: Any) -> list[str]:
    """Sorted names of the completed runs below ``root`` whose description has the given values; damaged ones are passed over."""
    out = []
    for name in list_names(spark, root):
        try:
            about = Run(spark, root, name).about()
        except (OSError, ValueError):
            continue
        if isinstance(about, dict) and all(about.get(k) == v for k, v in matches.items()):
            out.append(name)
    return out
