"""Cuts of ranked lists: the best documents, and the best chunks of each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quarrylight.schemas import require


def _ordered() -> list:
    return [F.col("score").desc(), F.col("id").cast("string").desc()]


def top_k_documents(ranked: DataFrame, top_k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The ``top_k`` rows of each list by (score, id) descending, with their new rank.

    A null score raises on reading. ``top_k`` 0 gives nothing; a negative one leaves out so
    many from the end, as a slice would. Equal rows are ranked one after the other.
    """
    checked = require(ranked, F.col("score").isNotNull(), "a document has no score")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*_ordered()))
    if top_k >= 0:
        return checked.withColumn("rank", place).where(F.col("rank") <= top_k)
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return checked.withColumns({"_size": size, "rank": place}).where(F.col("rank") <= F.col("_size") + F.lit(top_k)).drop("_size")


def chunk_cascade(ranked: DataFrame, top_k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """At most ``top_k`` chunks of each source document; the list stays sorted by (score, id) descending.

    A row without source document, or with an empty one, is its own. ``top_k`` has to be
    positive; a null score raises on reading.
    """
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    checked = require(ranked, F.col("score").isNotNull(), "a chunk has no score")
    owner = F.coalesce(F.nullif(F.col("source_document_id"), F.lit("")), F.col("id"))
    within = Window.partitionBy(*by, "_owner").orderBy(*_ordered())
    kept = checked.withColumn("_owner", owner).withColumn("_place", F.row_number().over(within)).where(F.col("_place") <= top_k).drop("_place", "_owner")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*_ordered())))
