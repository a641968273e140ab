"""Fusion of ranked lists: one aggregation over their union, whatever the number of sources.

A ranked list is a long table (query_id, source, rank, id, score, ...); rank is 1-based.
Rows of sources without a weight are left out. A row with a null id adds nothing, but
holds its rank and counts in its source's statistics. A document that a source lists twice
is added twice; one that a source doesn't list gets nothing from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PLACES = ["query_id", "source", "rank", "id", "score"]


def _weighted(ranked: DataFrame, weights: dict[str, float]) -> DataFrame:
    if not weights:
        return ranked.where(F.lit(False)).withColumns({"_weight": F.lit(0.0), "_order": F.lit(0)})
    weight, order = F.lit(None).cast("double"), F.lit(None).cast("int")
    for i, (name, w) in enumerate(weights.items()):
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
        order = F.when(F.col("source") == name, F.lit(i)).otherwise(order)
    return ranked.where(F.col("source").isin(list(weights))).withColumns({"_weight": weight, "_order": order})


def _fuse(rows: DataFrame, amount: Column, payload: list[str]) -> DataFrame:
    """Sums amounts per (query, document); the payload comes from the first source that has it."""
    first = F.struct("_order", "rank")
    kept = [F.min_by(F.col(p), first).alias(p) for p in payload]
    fused = rows.where(F.col("id").isNotNull()).groupBy("query_id", "id").agg(F.sum(amount).alias("score"), *kept)
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").desc())
    return fused.withColumn("rank", F.row_number().over(place)).select("query_id", "rank", "id", "score", *payload)


def reciprocal_rank_fusion(ranked: DataFrame, weights: dict[str, float], rrf_k: float = 60.0, payload: list[str] | None = None) -> DataFrame:
    """Sums weight / (rrf_k + rank); scores are ignored. Sorted by score, then id, both descending."""
    rows = _weighted(ranked, weights)
    return _fuse(rows, F.col("_weight") / (F.lit(float(rrf_k)) + F.col("rank")), payload or [])


def score_fusion(ranked: DataFrame, weights: dict[str, float], missing_score: float = 0.0, normalize: str = "none", payload: list[str] | None = None) -> DataFrame:
    """Sums weight * score, a null score being ``missing_score`` before any normalisation.

    ``normalize`` per query and source: ``none``; ``minmax``, where a constant source gives
    1; ``zscore`` by population deviation, where a constant source gives 0. The statistics
    are aggregated first and joined back by (query, source).
    """
    if normalize not in ("none", "minmax", "zscore"):
        raise ValueError(f"unknown normalisation {normalize!r}")
    rows = _weighted(ranked, weights).withColumn("_score", F.coalesce(F.col("score").cast("double"), F.lit(float(missing_score))))
    amount = F.col("_score")
    if normalize != "none":
        stats = rows.groupBy(F.col("query_id").alias("_q"), F.col("source").alias("_s")).agg(
            F.min("_score").alias("_low"), F.max("_score").alias("_high"), F.avg("_score").alias("_mean"), F.stddev_pop("_score").alias("_dev")
        )
        rows = rows.join(stats, F.col("query_id").eqNullSafe(F.col("_q")) & (F.col("source") == F.col("_s")))
        constant = F.col("_low") == F.col("_high")
        if normalize == "minmax":
            amount = F.when(constant, F.lit(1.0)).otherwise((amount - F.col("_low")) / (F.col("_high") - F.col("_low")))
        else:
            amount = F.when(constant | (F.col("_dev") == 0), F.lit(0.0)).otherwise((amount - F.col("_mean")) / F.col("_dev"))
    return _fuse(rows, F.col("_weight") * amount, payload or [])


def linear_score_fusion(ranked: DataFrame, weights: dict[str, float], missing_score: float = 0.0, payload: list[str] | None = None) -> DataFrame:
    """Score fusion after min-max normalisation of each source."""
    return score_fusion(ranked, weights, missing_score, "minmax", payload)


def zscore_fusion(ranked: DataFrame, weights: dict[str, float], missing_score: float = 0.0, payload: list[str] | None = None) -> DataFrame:
    """Score fusion after z-normalisation of each source."""
    return score_fusion(ranked, weights, missing_score, "zscore", payload)
