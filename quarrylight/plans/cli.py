"""``python -m quarrylight.plans.cli stage NAME --config FILE [--config FILE...] [name=value...]``.

The configuration has ``tables`` (documents, queries, qrels, predictions, mapping: Parquet
paths) and the options of the stage. Models are named by import path, ``module:attribute``,
of something that makes one when called; there is no default. ``encoder`` is that of an
indexing, each of the ``sources`` of an inference has its own; ``steps`` are import paths of
functions from DataFrame to DataFrame. Exit 0: done, 1: an error, 130: interrupted.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import DataFrame, SparkSession

from quarrylight.operators import models, sparse
from quarrylight.plans import config as configs, graph, stages

log = logging.getLogger("quarrylight")


def _encoder(name: str | None, role: str, kind: str) -> list[stages.Step]:
    """The step that adds vectors by the encoder of an import path; none without a name."""
    if not name:
        return []
    made = graph.Registry().find(name)
    embed = lambda df: models.embed(df, made, role)
    if kind != "sparse":
        return [embed]
    return [embed, lambda df: df.withColumn("sparse", sparse.dense_to_sparse(df["embedding"])).drop("embedding")]


def _source(spec: dict) -> stages.Source:
    given = dict(spec)
    steps = _encoder(given.pop("encoder", None), "query", given.get("kind", ""))
    return stages.Source(**given, steps=tuple(steps))


def run(stage: str, config: dict) -> object:
    """Runs one stage by its configuration and returns what it reports."""
    from quarrylight.session import build_session, clear_workspaces

    spark = build_session("quarrylight", **{k.replace(".", "__"): str(v) for k, v in (config.get("spark") or {}).items()})
    tables = {name: spark.read.parquet(path) for name, path in (config.get("tables") or {}).items()}
    options = dict(config.get("options") or {})
    log.info("stage %s over %s", stage, ", ".join(sorted(tables)) or "no tables")
    try:
        return _run(spark, stage, tables, options)
    finally:  # what a stage reports is written, so nothing reads its workspaces any more
        clear_workspaces(spark)


def _run(spark: SparkSession, stage: str, tables: dict[str, DataFrame], options: dict) -> object:
    if stage == "prepare_mapping":
        return stages.prepare_mapping(spark, documents=tables["documents"], queries=tables["queries"], qrels=tables["qrels"], **options)
    steps = [graph.Registry().find(name) for name in options.pop("steps", None) or []]
    if stage == "indexing":
        kind = options.get("kind", "dense")
        return stages.build_index(spark, tables["documents"], steps=[*steps, *_encoder(options.pop("encoder", None), "document", kind)], **options)
    if stage == "inference":
        out, sources = options.pop("output"), [_source(s) for s in options.pop("sources")]
        stages.infer(spark, tables["queries"], sources, mapping=tables.get("mapping"), steps=steps, **options).write.parquet(out)
        return out
    if stage == "evaluation":
        return stages.evaluate(spark, predictions=tables["predictions"], queries=tables["queries"], qrels=tables["qrels"], **options)
    raise ValueError(f"unknown stage {stage!r}")


#: Loggers of libraries that say too much at the level of ours.
QUIET = ("py4j", "pyspark", "urllib3")


def set_up_logging(level: str = "INFO", file: str | None = None) -> None:
    """Messages of this package at ``level`` to standard error, and to a file where one is named; libraries warn only."""
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if file:
        handlers.append(logging.FileHandler(file, encoding="utf-8"))
    logging.basicConfig(level=logging.WARNING, format="%(asctime)s %(levelname)s %(name)s: %(message)s", handlers=handlers, force=True)
    log.setLevel(level.upper())
    for name in QUIET:
        logging.getLogger(name).setLevel(logging.WARNING)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarrylight")
    commands = parser.add_subparsers(dest="command", required=True)
    stage = commands.add_parser("stage")
    stage.add_argument("name", choices=("prepare_mapping", "indexing", "inference", "evaluation"))
    stage.add_argument("--config", action="append", required=True, help="a YAML file; later ones win")
    args, overrides = parser.parse_known_args(argv)
    if wrong := [x for x in overrides if x.startswith("-") or "=" not in x]:
        parser.error(f"not understood: {' '.join(wrong)}")
    try:
        config = configs.load(*args.config, overrides=overrides)
        set_up_logging(**(config.get("logging") or {}))
        print(json.dumps(run(args.name, config)))
    except KeyboardInterrupt:
        return 130
    except Exception as error:  # noqa: BLE001
        log.error("%s", error)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
