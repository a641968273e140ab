"""Ranking metrics: Recall, Precision, HitRate, MRR, NDCG and MAP at k.

Results are collapsed to documents before they are ranked: a document's score is the best
of its chunks'. Only queries that are among the predictions and whose need has a judgment
count; of those, only ones with a positive judgment. Position k always exists, so
Precision@k divides by k; judged documents that were not retrieved, or don't exist, count
in denominators. NDCG has linear gain and the discount 1 / log2(position + 1).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from quarrylight.schemas import duplicate_ids, resolve_qrels

METRICS = ("HitRate", "MAP", "MRR", "NDCG", "Precision", "Recall")
#: Other names of metrics, lower-cased and without separators; fixed values.
ALIASES = {"hr": "HitRate", "meanaverageprecision": "MAP", "normalizeddcg": "NDCG", "p": "Precision", "r": "Recall"} | {m.lower(): m for m in METRICS}


@dataclass(frozen=True)
class Metric:
    name: str
    k: int

    @property
    def label(self) -> str:
        return f"{self.name}@{self.k}"

    @classmethod
    def parse(cls, text: str) -> Metric:
        """``Name@k`` with any spelling of the name; raises on anything else."""
        if not isinstance(text, str):
            raise TypeError(f"a metric is a string such as 'Recall@10', not {text!r}")
        name, at, k = text.strip().rpartition("@")
        plain = re.sub(r"[\s_-]", "", name).lower()
        if not at or not re.fullmatch(r"[1-9][0-9]*", k) or not re.fullmatch(r"[A-Za-z][A-Za-z0-9 _-]*", name):
            raise ValueError(f"{text!r} isn't of the form 'Recall@10'")
        if plain not in ALIASES:
            raise ValueError(f"unknown metric {text!r}; known are {', '.join(METRICS)}")
        return cls(ALIASES[plain], int(k))


def ranking_score(score: Column, rank: Column) -> Column:
    """A result's score, lessened a little by its rank; minus the rank where there is no finite score."""
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) != F.lit(float("inf")))
    return F.when(finite, score - rank * F.lit(1e-12)).otherwise(-rank.cast("double"))


def collapse_chunks(predictions: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(by..., document_id, score, rank): each list's documents with their best chunk's ranking score.

    ``rank`` is the first place at which the document occurs. Results without a document are
    left out but have held their rank.
    """
    rows = predictions.where("document_id IS NOT NULL").withColumn("_s", ranking_score(F.col("score"), F.col("rank")))
    return rows.groupBy(*by, "document_id").agg(F.max("_s").alias("score"), F.min("rank").alias("rank"))


def rank_documents(predictions: DataFrame, depth: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Collapsed lists cut at ``depth``, with the place of each document: score, then first rank, then id."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("rank"), F.col("document_id"))
    return collapse_chunks(predictions, by).withColumn("place", F.row_number().over(order)).where(F.col("place") <= depth)


def query_metrics(predictions: DataFrame, queries: DataFrame, qrels: DataFrame, metrics: list[str], policy: str = "error", map_divisor: str = "hits", by: tuple[str, ...] = (), check: bool = True) -> DataFrame:
    """(by..., query_id, metric, value): one row per scored query and metric.

    ``predictions`` (by..., query_id, rank, document_id, score), ``queries`` (id, IN) with
    unique ids, ``qrels`` (IN, document_id, label). A query with an empty list can be given as
    one row with a null document_id. ``policy``: see ``resolve_qrels``. ``map_divisor``: average
    precision is over the hits within k (``hits``) or over min(k, positives) (``ideal``).
    With ``check``, repeated and unknown query ids raise at once; else a
    repeated id takes its smallest need and unknown ones don't count.

    Plan: lists are collapsed and cut by partial aggregation and a group limit; judgments join
    on (need, document); a need's ideal gain comes from counts per label, so a need that holds
    a large share of all judgments is never gathered.
    """
    specs = [Metric.parse(m) for m in metrics]
    if map_divisor not in ("hits", "ideal"):
        raise ValueError("map_divisor must be 'hits' or 'ideal'")
    if not specs:
        return predictions.select(*by, "query_id", F.lit("").alias("metric"), F.lit(0.0).alias("value")).where(F.lit(False))
    depth = max(s.k for s in specs)
    if check and duplicate_ids(queries, "id").limit(1).count():
        raise ValueError("the queries have a repeated id")
    needs = queries.groupBy(F.col("id").alias("query_id")).agg(F.min("IN").alias("IN"))
    asked = predictions.select(*by, "query_id").distinct()
    if check:  # at once: later joins could leave out the rows that a lazy check would see
        unknown = asked.join(needs, "query_id", "left_anti").select("query_id").first()
        if unknown is not None:
            raise ValueError(f"unknown query {unknown['query_id']!r}")
    asked = asked.join(needs, "query_id")
    labels = resolve_qrels(qrels, policy)
    counts = labels.where("label > 0").groupBy("IN", "label").agg(F.count(F.lit(1)).alias("n"))
    below = Window.partitionBy("IN").orderBy(F.col("label").desc())  # as many rows as a need has labels
    start = F.sum("n").over(below) - F.col("n")
    gains = counts.withColumn("_start", start)
    ideal = [F.sum(F.col("label") * _discounts(F.col("_start"), F.col("n"), k)).alias(f"_ideal_{k}") for k in sorted({s.k for s in specs if s.name == "NDCG"})]
    totals = gains.groupBy("IN").agg(F.sum("n").alias("_positives"), *ideal)
    scored = asked.join(totals, "IN").select(*by, "query_id", "IN", "_positives", *[f"_ideal_{k}" for k in sorted({s.k for s in specs if s.name == "NDCG"})])
    ranked = rank_documents(predictions, depth, (*by, "query_id")).join(needs.select("query_id", "IN"), "query_id")
    hits = ranked.join(labels.where("label > 0"), ["IN", "document_id"]).select(*by, "query_id", "place", "label")
    so_far = F.row_number().over(Window.partitionBy(*by, "query_id").orderBy("place"))
    hits = hits.withColumn("_nth", so_far)
    place = F.col("place")
    parts = []
    for k in sorted({s.k for s in specs}):
        inside = place <= k
        parts += [
            F.count_if(inside).alias(f"_hits_{k}"), F.min(F.when(inside, place)).alias(f"_first_{k}"),
            F.sum(F.when(inside, F.col("label") / F.log2(place + 1))).alias(f"_gain_{k}"), F.sum(F.when(inside, F.col("_nth") / place)).alias(f"_prec_{k}"),
        ]
    summed = scored.join(hits.groupBy(*by, "query_id").agg(*parts), [*by, "query_id"], "left")

    def value(s: Metric) -> Column:
        h, positives = F.coalesce(f"_hits_{s.k}", F.lit(0)).cast("double"), F.col("_positives")
        if s.name == "Recall":
            return h / positives
        if s.name == "Precision":
            return h / F.lit(float(s.k))
        if s.name == "HitRate":
            return F.when(h > 0, 1.0).otherwise(0.0)
        if s.name == "MRR":
            return F.coalesce(F.lit(1.0) / F.col(f"_first_{s.k}"), F.lit(0.0))
        if s.name == "NDCG":
            return F.coalesce(F.col(f"_gain_{s.k}") / F.col(f"_ideal_{s.k}"), F.lit(0.0))
        return F.coalesce(F.col(f"_prec_{s.k}") / (h if map_divisor == "hits" else F.least(positives, F.lit(s.k))), F.lit(0.0))

    pairs = F.array(*[F.struct(F.lit(s.label).alias("metric"), value(s).cast("double").alias("value")) for s in specs])
    return summed.select(*by, "query_id", F.explode(pairs).alias("_m")).select(*by, "query_id", "_m.metric", "_m.value")


def _discounts(start: Column, n: Column, k: int) -> Column:
    """The discounts of the positions start + 1 to start + n that are within k, summed up."""
    last = F.least(start + n, F.lit(k))
    steps = F.sequence(start + 1, last)
    summed = F.aggregate(steps, F.lit(0.0), lambda acc, p: acc + F.lit(1.0) / F.log2((p + 1).cast("double")))
    return F.when(last > start, summed).otherwise(F.lit(0.0))


def evaluate(spark: SparkSession, predictions: DataFrame, queries: DataFrame, qrels: DataFrame, metrics: list[str], by: tuple[str, ...] = (), **options) -> DataFrame:
    """(by..., metric, value): means over the scored queries; 0 for every metric where none was scored.

    With ``by``, each group among the predictions has its metrics. No metrics, no rows.
    """
    labels = list(dict.fromkeys(Metric.parse(m).label for m in metrics))
    if not labels:
        schema = T.StructType([*(predictions.schema[c] for c in by), T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())])
        return spark.createDataFrame([], schema)
    means = query_metrics(predictions, queries, qrels, labels, by=by, **options).groupBy(*by, "metric").agg(F.avg("value").alias("value"))
    wanted = spark.createDataFrame([(m,) for m in labels], "metric STRING")
    if by:
        groups = predictions.select(*by).distinct()
        each = reduce(DataFrame.unionByName, [groups.withColumn("metric", F.lit(m)) for m in labels])
    else:
        each = wanted
    return each.join(means, [*by, "metric"], "left").select(*by, "metric", F.coalesce("value", F.lit(0.0)).alias("value"))
