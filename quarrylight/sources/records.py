"""JSON and JSONL, read and written: large files by Spark, small artifacts by the driver, both on any Hadoop file system."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from quarrylight.schemas import DOCUMENT, QREL, QUERY, record_problem, require
from quarrylight.session import _path, read_text, write_text_atomic

BLANK = r"^[\s\x{85}\x{a0}\x{2028}\x{2029}\x{3000}]*$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of a text file that aren't blank; a wrong or missing path raises."""
    return spark.read.text(path).where(~F.col("value").rlike(BLANK))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of a JSONL file by a given schema; blank lines are skipped, a bad line raises on reading."""
    lines = read_lines(spark, path)
    found = lines.select("value", F.from_json("value", T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    checked = require(found, F.col("r").isNotNull() & F.col("r._corrupt").isNull(), F.concat(F.lit("no JSON record: "), F.substring("value", 1, 80)))
    return checked.select(*[F.col(f"r.`{f.name}`").alias(f.name) for f in schema])


def read_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Strict records of a JSONL file: ``query``, ``document`` or ``qrel``; meta stays JSON text.

    Every problem of :func:`quarrylight.schemas.record_problem` raises on reading and shows the line.
    """
    schema = {"query": QUERY, "document": DOCUMENT, "qrel": QREL}[kind]
    lines = read_lines(spark, path).withColumn("_problem", record_problem(F.col("value"), kind))
    checked = require(lines, F.col("_problem").isNull(), F.concat("_problem", F.lit(": "), F.substring("value", 1, 80)))
    loose = T.StructType([T.StructField(f.name, T.StringType() if f.name != "label" else T.IntegerType()) for f in schema])
    return checked.select(F.from_json("value", loose).alias("r")).select("r.*")


def count_lines(spark: SparkSession, path: str) -> int:
    """The number of lines that aren't blank."""
    return read_lines(spark, path).count()


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One compact JSON object a line, non-ASCII kept, nulls written; a folder of files."""
    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))
    rows.write.mode(mode).text(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): all lines of one text file with their numbers from 1, blank ones too.

    The parts of a file follow each other as it is read, so the sizes of the parts (one row
    each) give the offsets.
    """
    lines = spark.read.text(path).select(F.col("value"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id"))
    sizes = {r["_part"]: r["count"] for r in lines.groupBy("_part").count().collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    pairs = [F.lit(x) for p in before.items() for x in p] or [F.lit(0), F.lit(0)]
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return lines.select((F.element_at(F.create_map(*pairs), F.col("_part")) + within + 1).alias("line_no"), "value")


def record_problems(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(line_no, problem, value): the lines of a file that are no strict records of a kind; blank lines are none."""
    found = numbered_lines(spark, path).where(~F.col("value").rlike(BLANK)).withColumn("problem", record_problem(F.col("value"), kind))
    return found.where("problem IS NOT NULL").select("line_no", "problem", "value")


def batch_plan(spark: SparkSession, path: str, batch_size: int) -> dict[str, Any]:
    """What an indexing run reports of its input: documents, batches, and the SHA-256 of the whole file.

    The first line that is no document raises with its number, a repeated document id too.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    if bad := record_problems(spark, path, "document").orderBy("line_no").first():
        raise ValueError(f"line {bad['line_no']} of {path}: {bad['problem']}")
    ids = read_records(spark, path, "document").select("id")
    twice = ids.groupBy("id").count().where("count > 1").first()
    if twice:
        raise ValueError(f"document id {twice['id']!r} occurs more than once")
    n = ids.count()
    return {"document_count": n, "batch_count": -(-n // batch_size), "sha256": path_sha256(spark, path)}


def path_sha256(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file of any Hadoop file system, or of a folder's files one after the other by name; streamed by the JVM whatever the size."""
    found, fs = _path(spark, path)
    tools = spark.sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils
    digest = tools.getSha256Digest()
    parts = [found] if fs.getFileStatus(found).isFile() else sorted((s.getPath() for s in fs.listStatus(found) if s.isFile() and s.getPath().getName()[0] not in "._"), key=str)
    for part in parts:
        stream = fs.open(part)
        try:
            tools.updateDigest(digest, stream)
        finally:
            stream.close()
    return bytes(digest.digest()).hex()


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def to_jsonable(value: Any) -> Any:
    """A value as JSON can hold it: sets and tuples as lists, keys and paths as text, objects by ``to_dict``."""
    if hasattr(value, "to_dict"):
        value = value.to_dict()
    if isinstance(value, dict):
        return {str(k): to_jsonable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [to_jsonable(v) for v in value]
    if isinstance(value, (set, frozenset)):
        return [to_jsonable(v) for v in sorted(value, key=str)]
    return str(value) if isinstance(value, Path) else value


def read_json(spark: SparkSession, path: str) -> Any:
    """The value of a small JSON file of any Hadoop file system; raises where there is none."""
    text = read_text(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    return json.loads(text)


def write_json(spark: SparkSession, path: str, value: Any) -> str:
    """Indented JSON with a final line break; readers see the former value or the new one, and a failure leaves nothing behind."""
    write_text_atomic(spark, path, json.dumps(to_jsonable(value), indent=2, ensure_ascii=False) + "\n")
    return path


def read_yaml_mapping(path: str | Path) -> dict:
    """A YAML file's mapping; anything else in it counts as empty."""
    import yaml

    found = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    return found if isinstance(found, dict) else {}


def _mapping_problem(line: Column) -> Column:
    """Why a line is no ``{id, meta}`` with a non-empty text and an object; null if it is."""
    keys, ident = F.json_object_keys(line), F.get_json_object(line, "$.id")
    problem = F.when(keys.isNull(), F.lit("no JSON object")).when(F.array_sort(keys) != F.array(F.lit("id"), F.lit("meta")), F.lit("fields are not id and meta"))
    problem = problem.when(F.coalesce(ident, F.lit("")) == "", F.lit("empty id")).when(F.json_object_keys(F.get_json_object(line, "$.meta")).isNull(), F.lit("meta is no object"))
    return problem.when(~line.rlike(r'"id"\s*:\s*"'), F.lit("id is no string"))


def mapping_problems(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, problem): the lines of a metadata mapping that are none, and those that repeat an id."""
    lines = numbered_lines(spark, path).where(~F.col("value").rlike(BLANK)).withColumn("problem", _mapping_problem(F.col("value")))
    first = F.min("line_no").over(Window.partitionBy(F.get_json_object("value", "$.id")))
    again = lines.where("problem IS NULL").withColumn("_first", first).where("line_no > _first").select("line_no", F.lit("repeated id").alias("problem"))
    return lines.where("problem IS NOT NULL").select("line_no", "problem").unionByName(again)


def read_metadata_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(id, meta) of a JSONL file of ``{id, meta}``; meta stays JSON text.

    Raises on reading for a bad line, a missing, empty or repeated id, a meta that is no
    object, or another field. :func:`mapping_problems` gives the numbers of all such lines.
    """
    checked = require(read_lines(spark, path).withColumn("_p", _mapping_problem(F.col("value"))), F.col("_p").isNull(), F.concat("_p", F.lit(": "), F.substring("value", 1, 80)))
    rows = checked.select(F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.meta").alias("meta"))
    each = rows.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.min("meta").alias("meta"))
    return require(each, F.col("_n") == 1, F.concat(F.lit("repeated id "), F.col("id"))).select("id", "meta")
