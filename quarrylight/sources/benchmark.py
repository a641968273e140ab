"""Retrieval benchmarks: corpus and query files in JSONL, judgments as tab-separated text."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylight.functions.text import strip
from quarrylight.operators.mapping import limit_dataset
from quarrylight.operators.sparse import with_ordinal
from quarrylight.sources.records import read_jsonl, read_lines, write_jsonl


def benchmark_documents(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """(id, content, meta): title and text joined by a line break, blank ones left out; meta as JSON text."""
    raw = read_jsonl(spark, path, _schema("_id STRING, title STRING, text STRING, metadata STRING"))
    part = lambda c: F.nullif(strip(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    title = F.coalesce("title", F.lit(""))
    meta = F.concat(F.lit("{"), _pair("dataset", F.lit(dataset)), F.lit(","), _pair("title", title), F.lit(',"beir_metadata":'), F.coalesce("metadata", F.lit("{}")), F.lit("}"))
    return raw.select(F.col("_id").alias("id"), F.concat_ws("\n", part("title"), part("text")).alias("content"), meta.alias("meta"))


def _pair(name: str, value):
    text = F.to_json(F.struct(value.alias(name)))
    return text.substr(F.lit(2), F.length(text) - 2)


def _schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def benchmark_queries(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """(id, content, IN, meta): each query is its own need."""
    raw = read_jsonl(spark, path, _schema("_id STRING, text STRING"))
    return raw.select(F.col("_id").alias("id"), F.col("text").alias("content"), F.col("_id").alias("IN"), F.concat(F.lit("{"), _pair("dataset", F.lit(dataset)), F.lit("}")).alias("meta"))


def benchmark_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(IN, document_id, label, pos) of a judgment file.

    A first line with the names ``query-id`` and ``corpus-id`` is a header that says where the
    columns are; without one, four and more columns are need, ignored, document, label, and
    three are need, document, label. Blank lines are skipped.
    """
    order = ("_file", "_start", "_line")  # the splits of a file by their place, the lines of a split as read
    lines = read_lines(spark, path).select(F.split("value", "\t").alias("c"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line"))
    first = next(iter(spark.read.text(path).where(F.trim("value") != "").limit(1).collect()), None)
    names = [n.strip() for n in first["value"].split("\t")] if first else []
    if "query-id" in names and "corpus-id" in names:
        at = [names.index(n) for n in ("query-id", "corpus-id", "score")]
        rows = lines.where(~(F.col("c") == F.array(*map(F.lit, first["value"].split("\t")))))
        cell = [F.element_at("c", i + 1) for i in at]
    else:
        rows, wide = lines, F.size("c") >= 4
        cell = [F.element_at("c", 1), F.when(wide, F.element_at("c", 3)).otherwise(F.element_at("c", 2)), F.when(wide, F.element_at("c", 4)).otherwise(F.element_at("c", 3))]
    found = rows.select(*[F.trim(c).alias(n) for c, n in zip(cell, ("IN", "document_id", "label"), strict=True)], *order)
    return with_ordinal(found.withColumn("label", F.col("label").cast("int")), *order, name="pos").drop(*order)


def prepare_benchmark(spark: SparkSession, source: str, target: str, dataset: str, split: str = "test", max_documents: int | None = None, max_queries: int | None = None) -> dict[str, int]:
    """Reads ``corpus.jsonl``, ``queries.jsonl`` and ``qrels/{split}.tsv`` and writes documents, queries and qrels as JSONL.

    Queries keep to needs that have judgments. Returns the three counts.
    """
    documents = with_ordinal(benchmark_documents(spark, f"{source}/corpus.jsonl", dataset), "id", name="pos")
    qrels = benchmark_qrels(spark, f"{source}/qrels/{split}.tsv")
    queries = with_ordinal(benchmark_queries(spark, f"{source}/queries.jsonl", dataset), "id", name="pos").join(qrels.select("IN").distinct(), "IN", "left_semi")
    documents, queries, qrels = limit_dataset(documents, queries, qrels, max_documents, max_queries)
    out = {"documents": documents.select("id", "content", "meta"), "queries": queries.select("id", "content", "IN", "meta"), "qrels": qrels.select("IN", "document_id", "label")}
    for name, df in out.items():
        write_jsonl(df, f"{target}/{name}.jsonl", "overwrite")
    return {name: df.count() for name, df in out.items()}


def fetch(url: str, target: str | Path, force: bool = False) -> Path:
    """Downloads a file to a folder of the driver under its own name, unless it is there already; returns its path.

    A download that breaks off leaves nothing under that name. ``force`` fetches it anew.
    """
    import shutil
    import urllib.request

    folder = Path(target)
    name = url.split("?")[0].rstrip("/").rpartition("/")[2]
    if not name:
        raise ValueError(f"{url} names no file")
    if (folder / name).exists() and not force:
        return folder / name
    folder.mkdir(parents=True, exist_ok=True)
    part = folder / f".{name}.part"
    try:
        with urllib.request.urlopen(url) as source, part.open("wb") as out:  # noqa: S310
            shutil.copyfileobj(source, out)
        part.replace(folder / name)
    finally:
        part.unlink(missing_ok=True)
    return folder / name


def extract(archive: str | Path, target: str | Path) -> Path:
    """Unpacks a zip archive and finds the folder with the corpus; paths that lead outside raise."""
    import zipfile

    target = Path(target)
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if not (target / name).resolve().is_relative_to(target.resolve()):
                raise ValueError(f"{name} leads outside")
        z.extractall(target)
    found = sorted(target.rglob("corpus.jsonl"))
    if not found:
        raise FileNotFoundError("the archive has no corpus.jsonl")
    return found[0].parent
