"""Enrichment of open JSON metadata by a mapping, with must-match and conflict checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrylight.schemas import duplicate_ids, require


def merge_objects(left: Column, right: Column) -> Column:
    """Two JSON objects as one; nested values keep their text. Null counts as the empty object."""
    inner = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("{}")), r"^\s*\{\s*", ""), r"\s*\}\s*$", "")
    a, b = inner(left), inner(right)
    return F.concat(F.lit("{"), a, F.when((a != "") & (b != ""), F.lit(",")).otherwise(F.lit("")), b, F.lit("}"))


def shared_keys(left: Column, right: Column) -> Column:
    """The top-level keys that two JSON objects have in common, sorted."""
    keys = lambda c: F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    return F.array_sort(F.array_intersect(keys(left), keys(right)))


def document_key(source_document_id: str = "source_document_id", key: str = "id") -> Column:
    """The source document's id where a row is a chunk, else its own; an empty one raises."""
    source = F.col(source_document_id)
    return F.when(source == "", F.raise_error(F.lit("empty source_document_id"))).otherwise(F.coalesce(source, F.col(key)))


def enrich(df: DataFrame, mapping: DataFrame, key: Column | str = "id", meta: str = "meta", on_missing: str = "error") -> DataFrame:
    """``df`` with each row's metadata joined by those of ``mapping`` (id, meta).

    The key has to be in the mapping and must not bring a top-level key that the row has:
    both raise on reading. ``on_missing='keep'`` leaves rows without an entry as they are. A
    mapping with repeated ids raises at once. The mapping is joined by Spark's choice: it is
    broadcast only if its measured size allows it.
    """
    if on_missing not in ("error", "keep"):
        raise ValueError("on_missing must be 'error' or 'keep'")
    if duplicate_ids(mapping, "id").limit(1).count():
        raise ValueError("the metadata mapping has a repeated id")
    column = F.col(key) if isinstance(key, str) else key
    right = mapping.select(F.col("id").alias("_map_id"), F.col("meta").alias("_map_meta"), F.lit(True).alias("_found"))
    joined = df.withColumn("_map_key", column).join(right, F.col("_map_key") == F.col("_map_id"), "left")
    if on_missing == "error":
        joined = require(joined, F.col("_found"), F.concat(F.lit("no metadata for "), F.coalesce(F.col("_map_key"), F.lit("null"))))
    clash = shared_keys(F.col(meta), F.col("_map_meta"))
    joined = require(joined, F.size(clash) == 0, F.concat(F.lit("metadata keys exist already: "), F.array_join(clash, ", ")))
    merged = F.when(F.col("_found"), merge_objects(F.col(meta), F.col("_map_meta"))).otherwise(F.col(meta))
    return joined.withColumn(meta, merged).drop("_map_key", "_map_id", "_map_meta", "_found")


def enrichment_conflicts(df: DataFrame, mapping: DataFrame, key: str = "id", meta: str = "meta") -> DataFrame:
    """(id, keys): the rows whose metadata and mapping entry share top-level keys."""
    right = mapping.select(F.col("id").alias("_map_id"), F.col("meta").alias("_map_meta"))
    joined = df.join(right, F.col(key) == F.col("_map_id")).select(F.col(key).alias("id"), F.array_join(shared_keys(F.col(meta), F.col("_map_meta")), ",").alias("keys"))
    return joined.where("keys <> ''")
