"""Predictions: long tables inside, nested records by query at the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quarrylight.schemas import require

RESULT = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("document_id", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("data", T.StringType())]))


def project_results(ranked: DataFrame) -> DataFrame:
    """(query_id, rank, id, document_id, score, data) of ranked units.

    The document is the source document where there is one, else the unit; an empty source
    raises on reading. ``data`` is the unit's extra data (``_extra_data`` of meta), else null.
    """
    checked = require(ranked, F.coalesce(F.col("source_document_id") != "", F.lit(True)), "empty source_document_id")
    data = F.get_json_object("meta", "$._extra_data") if "meta" in ranked.columns else F.lit(None).cast("string")
    return checked.select("query_id", "rank", "id", F.coalesce("source_document_id", "id").alias("document_id"), "score", data.alias("data"))


def query_data(queries: DataFrame) -> DataFrame:
    """(query_id, data): the extra data of queries' meta, null where there is none."""
    return queries.select(F.col("id").alias("query_id"), F.get_json_object("meta", "$._extra_data").alias("data"))


def nest(predictions: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, results JSON): one row per query with its results in rank order.

    ``queries`` (id): those without results get an empty list. The lists are as long as the
    retrieval depth. Empty or null query ids raise on reading.
    """
    checked = require(predictions, F.coalesce(F.col("query_id"), F.lit("")) != "", "a prediction has no query id")
    entry = F.struct("id", "document_id", "score", "data")
    lists = checked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", entry.alias("e")))).alias("l"))
    out = lists.select("query_id", F.to_json(F.col("l.e")).alias("results"))
    if queries is None:
        return out
    return queries.select(F.col("id").alias("query_id")).distinct().join(out, "query_id", "left").select("query_id", F.coalesce("results", F.lit("[]")).alias("results"))


def flatten(nested: DataFrame) -> DataFrame:
    """(query_id, rank, id, document_id, score, data) of nested predictions; rank is the place in the list."""
    rows = nested.select("query_id", F.posexplode(F.from_json("results", RESULT)).alias("_at", "_r"))
    return rows.select("query_id", (F.col("_at") + 1).alias("rank"), "_r.id", "_r.document_id", "_r.score", "_r.data")


def write_predictions(predictions: DataFrame, path: str, queries: DataFrame | None = None, mode: str = "errorifexists") -> None:
    """One JSON object ``{query_id, results}`` a line; repeated query ids can't occur."""
    rows = nest(predictions, queries)
    text = F.concat(F.lit('{"query_id":'), F.to_json(F.array("query_id")).substr(F.lit(2), F.length(F.to_json(F.array("query_id"))) - 2), F.lit(',"results":'), F.col("results"), F.lit("}"))
    rows.select(text.alias("value")).write.mode(mode).text(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, results JSON) of what ``write_predictions`` wrote; a repeated or empty query id raises."""
    rows = spark.read.text(path).select(F.get_json_object("value", "$.query_id").alias("query_id"), F.get_json_object("value", "$.results").alias("results"))
    each = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("results").alias("results"))
    return require(each, (F.col("_n") == 1) & (F.coalesce("query_id", F.lit("")) != ""), "empty or repeated query id").select("query_id", "results")
