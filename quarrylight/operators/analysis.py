"""Analysis of runs: judged results, summaries per query, comparisons of two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarrylight.schemas import resolve_qrels


def judged_results(predictions: DataFrame, queries: DataFrame, qrels: DataFrame, policy: str = "max") -> DataFrame:
    """Predictions (run_id, query_id, rank, id, document_id, score) with IN, relevance and is_relevant; unjudged ones have 0.

    A query id that occurs with several needs counts with the smallest.
    """
    needs = queries.groupBy(F.col("id").alias("query_id")).agg(F.min("IN").alias("IN"))
    labels = resolve_qrels(qrels, policy)
    rows = predictions.select("run_id", "query_id", "rank", "id", "document_id", "score").join(needs, "query_id", "left")
    joined = rows.join(labels, ["IN", "document_id"], "left").withColumn("relevance", F.coalesce("label", F.lit(0))).drop("label")
    return joined.withColumn("is_relevant", F.col("relevance") > 0)


def query_summary(predictions: DataFrame, queries: DataFrame, qrels: DataFrame, policy: str = "max") -> DataFrame:
    """One row per run and query among the predictions.

    retrieved_document_count and retrieved_relevant_count are of distinct documents,
    relevant_document_count is of the need's positives; first_relevant_rank is null and
    reciprocal_rank 0 without a relevant result; recall_at_run_depth is 0 without positives. A
    query that found nothing is one row of predictions with a null document_id.
    """
    judged = judged_results(predictions, queries, qrels, policy)
    relevant = F.when(F.col("is_relevant"), F.col("document_id"))
    agg = judged.groupBy("run_id", "query_id", "IN").agg(
        F.count_distinct("document_id").alias("retrieved_document_count"),
        F.count_distinct(relevant).alias("retrieved_relevant_count"),
        F.min(F.when(F.col("is_relevant"), F.col("rank"))).alias("first_relevant_rank"),
    )
    positives = resolve_qrels(qrels, policy).where("label > 0").groupBy("IN").agg(F.count(F.lit(1)).alias("relevant_document_count"))
    joined = agg.join(positives, "IN", "left").withColumn("relevant_document_count", F.coalesce("relevant_document_count", F.lit(0)))
    return joined.select(
        "run_id", "query_id", "IN", "retrieved_document_count", "retrieved_relevant_count", "relevant_document_count", "first_relevant_rank",
        F.coalesce(1.0 / F.col("first_relevant_rank"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(F.col("relevant_document_count") > 0, F.col("retrieved_relevant_count") / F.col("relevant_document_count")).otherwise(0.0).alias("recall_at_run_depth"),
    )


def run_means(summary: DataFrame) -> DataFrame:
    """Mean reciprocal rank and recall of each run."""
    return summary.groupBy("run_id").agg(F.avg("reciprocal_rank").alias("mean_reciprocal_rank"), F.avg("recall_at_run_depth").alias("mean_recall"), F.count(F.lit(1)).alias("n_queries"))


def compare_metrics(baseline: DataFrame, treatment: DataFrame) -> DataFrame:
    """(metric, baseline, treatment, delta) of two metric tables; a metric of one only has nulls."""
    a, b = baseline.select("metric", F.col("value").alias("baseline")), treatment.select("metric", F.col("value").alias("treatment"))
    return a.join(b, "metric", "full_outer").withColumn("delta", F.col("treatment") - F.col("baseline"))


def paired_outcomes(summary: DataFrame, baseline: str, treatment: str, value: str = "reciprocal_rank") -> DataFrame:
    """One row: how many queries that both runs have improved, degraded or stayed, and the mean delta."""
    pivot = summary.where(F.col("run_id").isin(baseline, treatment)).groupBy("query_id").agg(F.max(F.when(F.col("run_id") == baseline, F.col(value))).alias("a"), F.max(F.when(F.col("run_id") == treatment, F.col(value))).alias("b"))
    delta = F.col("b") - F.col("a")
    both = pivot.where("a IS NOT NULL AND b IS NOT NULL")
    return both.agg(F.count_if(delta > 0).alias("improved"), F.count_if(delta < 0).alias("degraded"), F.count_if(delta == 0).alias("unchanged"), F.avg(delta).alias("mean_delta"))
