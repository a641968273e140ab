"""Candidate mappings per information need: annotated, random, easy and gold negatives.

Sampling without random generators that no other engine has: the documents of a pool lie
on a ring in the order of their hash; a need starts at the place its own hash names and
takes the next documents that it may take. So a draw reads as many places as it needs,
by an equi-join, instead of ordering the whole pool for every need. For small mappings,
``exact_sample`` replays a seeded generator on the driver.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quarrylight.operators.sparse import with_ordinal
from quarrylight.schemas import resolve_qrels
from quarrylight.session import Workspace

RECIPE = ("seed", "query_subset_size", "document_subset_size", "include_annotated_docs", "use_all_selected_documents_for_every_query", "random_docs_per_query", "easy_negative_docs_per_query", "gold_passage_docs_per_query")


#: Hexadecimal digits that one histogram of hashes resolves, and keys that are few enough to sort.
PREFIX = 3
FEW_KEYS = 10_000


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The ``n`` first rows of an order, however many they are: by numbered ranges, not by one task."""
    return with_ordinal(df, *order, name="_nth").where(F.col("_nth") < n).drop("_nth")


def hash_order(seed: int | str, *columns: Column) -> Column:
    """The order of a row under a seed: MD5 in hexadecimal, the same in every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns).cast("binary"))


def parse_recipe(recipe: dict) -> dict:
    """The checked generation parameters of a recipe; every key has to be there, a null count is 0."""
    missing = [k for k in RECIPE if k not in recipe]
    if missing:
        raise ValueError(f"the recipe lacks {missing}")
    counts = {k: int(recipe[k] or 0) for k in RECIPE if k.endswith("_per_query")}
    if any(n < 0 for n in counts.values()):
        raise ValueError("counts must not be negative")
    everything = bool(recipe["use_all_selected_documents_for_every_query"])
    if everything and any(counts.values()):
        raise ValueError("all documents for every query can't be combined with samples")
    sizes = {k: None if recipe[k] is None else int(recipe[k]) for k in ("query_subset_size", "document_subset_size")}
    if any(n is not None and n < 0 for n in sizes.values()):
        raise ValueError("subset sizes must not be negative")
    return {"seed": int(recipe["seed"]), **sizes, "include_annotated_docs": bool(recipe["include_annotated_docs"]), "use_all_selected_documents_for_every_query": everything, **counts}


def distinct_in_order(df: DataFrame, column: str, pos: str) -> DataFrame:
    """(column, pos): the distinct non-null values with their first position."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(column)).agg(F.min(pos).alias(pos))


def sample_keys(df: DataFrame, column: str, size: int | None, seed: int | str, label: str) -> DataFrame:
    """``df`` with ``size`` of its distinct keys by hash order; all of them for None; too few raise.

    The last key that is taken is found by histograms of hash prefixes, refined where the size
    falls, so nothing is sorted; then one comparison filters.
    """
    if size is None:
        return df
    order = hash_order(seed, F.col(column))
    keys = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_key"), order.alias("_h")).distinct()
    if size == 0:
        return df.where(F.lit(False))
    prefix, left = "", size
    while True:
        inside = keys.where(F.col("_h").startswith(prefix)) if prefix else keys
        counts = sorted((r["b"], r["n"]) for r in inside.groupBy(F.substring("_h", len(prefix) + 1, PREFIX).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())  # 16 ** PREFIX rows at most
        there = sum(n for _, n in counts)
        if there < left:
            raise ValueError(f"{size} {label} were asked for, {size - left + there} exist")
        for bucket, n in counts:
            if n >= left:
                break
            left -= n
        prefix += bucket
        if n <= FEW_KEYS or len(prefix) + PREFIX > 32:
            break
    last = keys.where(F.col("_h").startswith(prefix)).orderBy("_h", "_key").limit(left).collect()[-1]
    taken = (order < F.lit(last["_h"])) | (order == F.lit(last["_h"])) & (F.col(column) <= F.lit(last["_key"]))
    return df.where(F.col(column).isNotNull() & taken)


def exact_sample(keys: list[str], size: int, seed: int) -> list[str]:
    """The seeded generator's sample on the driver, in the order of ``keys``; for small sets."""
    if size > len(keys):
        raise ValueError(f"{size} were asked for, {len(keys)} exist")
    chosen = set(random.Random(seed).sample(keys, size))
    return [k for k in keys if k in chosen]


def ring_sample(needs: DataFrame, pool: DataFrame, excluded: DataFrame, n: int, seed: int | str, label: str, check: bool = True) -> DataFrame:
    """(IN, document_id, draw): ``n`` documents of ``pool`` per need that aren't excluded for it.

    ``needs`` (IN), ``pool`` (document_id) distinct, ``excluded`` (IN, document_id). Nothing is
    drawn for n = 0. With ``check``, a need that can't be given n raises, naming label,
    wanted and available.
    """
    spark = needs.sparkSession
    empty = spark.createDataFrame([], "IN STRING, document_id STRING, draw INT")
    if n == 0:
        return empty
    space = Workspace(spark, "ring")
    ring = space.write(with_ordinal(pool.select("document_id", hash_order(seed, F.col("document_id")).alias("_h")), "_h", "document_id", name="_place").select("document_id", "_place"), "ring")
    size = ring.count()
    barred = space.write(excluded.select("IN", "document_id").distinct().join(ring, "document_id", "left_semi"), "barred")
    counts = needs.select("IN").join(barred.groupBy("IN").agg(F.count(F.lit(1)).alias("_barred")), "IN", "left").select("IN", F.coalesce("_barred", F.lit(0)).alias("_barred"))
    if check:
        short = counts.where(F.lit(size) - F.col("_barred") < n).orderBy("IN").first()
        if short is not None:
            raise ValueError(f"not enough {label} for {short['IN']}: {n} wanted, {size - short['_barred']} available")
    if not size:
        return empty
    start = F.conv(F.substring(hash_order(seed, F.col("IN")), 1, 8), 16, 10).cast("long") % size
    reach = F.least(F.lit(size).cast("long"), F.lit(n) + F.col("_barred"))
    steps = counts.select("IN", start.alias("_start"), F.explode(F.sequence(F.lit(0).cast("long"), reach - 1)).alias("_step"))
    met = steps.withColumn("_place", (F.col("_start") + F.col("_step")) % size).join(ring, "_place").join(barred, ["IN", "document_id"], "left_anti")
    order = F.row_number().over(Window.partitionBy("IN").orderBy("_step"))
    return met.withColumn("draw", order).where(F.col("draw") <= n).select("IN", "document_id", (F.col("draw") - 1).cast("int").alias("draw"))


def annotated_pairs(qrels: DataFrame) -> DataFrame:
    """(IN, document_id, positive): the judged pairs; positive if any of their labels is above 0."""
    return resolve_qrels(qrels, "max").select("IN", "document_id", (F.col("label") > 0).alias("positive"))


def generate_mapping(spark: SparkSession, documents: DataFrame, queries: DataFrame, qrels: DataFrame, recipe: dict, check: bool = True) -> DataFrame:
    """(IN, pos, document_id): the candidates of every selected need, in the order they were added.

    ``documents`` (id, pos), ``queries`` (IN, pos), ``qrels`` (IN, document_id, label). Order:
    annotated documents in corpus order (label 0 included), then random ones, easy negatives
    (annotated for no need at all), gold negatives (positive for a need, not annotated for
    this one). Repeated document ids count once, at their first position. Needs, positives and
    annotations outside the selection still count as such.
    """
    r = parse_recipe(recipe)
    space = Workspace(spark, "mapping")
    docs = distinct_in_order(documents.withColumnRenamed("id", "document_id"), "document_id", "pos")
    active = space.write(sample_keys(docs, "document_id", r["document_subset_size"], f"{r['seed']}d", "documents"), "active")
    needs = space.write(sample_keys(distinct_in_order(queries, "IN", "pos"), "IN", r["query_subset_size"], f"{r['seed']}q", "queries").select("IN"), "needs")
    if r["use_all_selected_documents_for_every_query"]:
        # The feature itself: every need gets every active document, by the size of the two subsets.
        every = needs.crossJoin(active)
        return every.withColumn("pos", (F.row_number().over(Window.partitionBy("IN").orderBy("pos", "document_id")) - 1).cast("int")).select("IN", "pos", "document_id")
    pairs = space.write(annotated_pairs(qrels), "pairs")
    mine = pairs.join(needs, "IN", "left_semi").join(active, "document_id")
    parts = []
    included = mine.select("IN", "document_id").where(F.lit(r["include_annotated_docs"]))
    if r["include_annotated_docs"]:
        parts.append(mine.select("IN", "document_id", F.lit(0).alias("_part"), F.col("pos").cast("long").alias("_at")))
    nowhere = active.join(pairs.select("document_id").distinct(), "document_id", "left_anti").select("document_id")
    gold = active.join(pairs.where("positive").select("document_id").distinct(), "document_id", "left_semi").select("document_id")
    if check and r["easy_negative_docs_per_query"] and nowhere.limit(1).count() == 0:
        raise ValueError("there are no easy negatives among the active documents")
    steps = [
        ("random_docs_per_query", active.select("document_id"), "random documents", None),
        ("easy_negative_docs_per_query", nowhere, "easy negatives", None),
        ("gold_passage_docs_per_query", gold, "gold negatives", pairs.select("IN", "document_id")),
    ]
    for number, (name, pool, label, barred) in enumerate(steps, 1):
        if not r[name]:
            continue
        out = included if barred is None else included.union(barred.join(needs, "IN", "left_semi"))
        drawn = space.write(ring_sample(needs, pool, out, r[name], f"{r['seed']}{number}", label, check), f"drawn-{number}")
        parts.append(drawn.select("IN", "document_id", F.lit(number).alias("_part"), F.col("draw").cast("long").alias("_at")))
        included = included.union(drawn.select("IN", "document_id"))
    if not parts:
        return spark.createDataFrame([], "IN STRING, pos INT, document_id STRING")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    place = F.row_number().over(Window.partitionBy("IN").orderBy("_part", "_at", "document_id"))
    return rows.withColumn("pos", (place - 1).cast("int")).select("IN", "pos", "document_id")


def mapping_statistics(mapping: DataFrame, needs: DataFrame, active: DataFrame) -> DataFrame:
    """One row: query_count, active_document_count, candidate_count_min, _max, _mean; zeros where empty."""
    counts = needs.select("IN").distinct().join(mapping.groupBy("IN").agg(F.count(F.lit(1)).alias("n")), "IN", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    summed = counts.agg(F.count(F.lit(1)).alias("query_count"), zero(F.min("n")).alias("candidate_count_min"), zero(F.max("n")).alias("candidate_count_max"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("candidate_count_mean"))
    size = active.select("document_id").distinct().agg(F.count(F.lit(1)).alias("active_document_count"))
    return summed.crossJoin(size)  # one row each


def resolve_mapping(mapping: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """A stored mapping without repetitions, each document at its first place; unknown needs or documents raise at once."""
    for column, known, name in (("IN", queries.select("IN"), "need"), ("document_id", documents.select(F.col("id").alias("document_id")), "document")):
        lost = mapping.join(known.distinct(), column, "left_anti").select(column).distinct().limit(5).collect()
        if lost:
            raise ValueError(f"the mapping has an unknown {name}: {', '.join(str(r[0]) for r in lost)}")
    firsts = mapping.groupBy("IN", "document_id").agg(F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy("IN").orderBy("pos"))
    return firsts.select("IN", (place - 1).cast("int").alias("pos"), "document_id")


def query_candidates(queries: DataFrame, mapping: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(query_id, IN, pos, document_id): each wording with its need's candidates.

    A need without an entry raises on reading, unless ``documents`` (id) is given: then it
    gets all of them in their order, as far as that is asked for.
    """
    asked = queries.select(F.col("id").alias("query_id"), "IN")
    listed = asked.join(mapping, "IN")
    if documents is None:
        missing = asked.join(mapping.select("IN").distinct(), "IN", "left_anti").limit(1).collect()
        if missing:
            raise KeyError(f"no candidates for {missing[0]['IN']!r}")
        return listed.select("query_id", "IN", "pos", "document_id")
    rest = asked.join(mapping.select("IN").distinct(), "IN", "left_anti")
    every = rest.crossJoin(documents.select(F.col("id").alias("document_id"), F.col("pos").cast("int").alias("pos")))
    return listed.select("query_id", "IN", "pos", "document_id").unionByName(every.select("query_id", "IN", "pos", "document_id"))


def limit_dataset(documents: DataFrame, queries: DataFrame, qrels: DataFrame, max_documents: int | None, max_queries: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, queries, qrels) of the first needs and as many documents as allowed.

    Needs come in the order of qrels (``pos``); if there are no qrels, of queries. Documents
    that the chosen needs' qrels name come first, even if they are more than
    ``max_documents``; then others fill up in corpus order (``pos``). Qrels keep to what is there.
    """
    if max_documents is None and max_queries is None:
        return documents, queries, qrels
    if max_queries is None:
        needs = queries.select("IN").where("`IN` IS NOT NULL").distinct()
    else:
        judged = distinct_in_order(qrels, "IN", "pos")
        source = judged if judged.limit(1).count() else distinct_in_order(queries, "IN", "pos")
        needs = first_rows(source, max_queries, "pos", "IN").select("IN")
    chosen = qrels.join(needs, "IN", "left_semi")
    kept = documents
    if max_documents is not None:
        required = chosen.select(F.col("document_id").alias("id")).where("id IS NOT NULL").distinct()
        must = documents.join(required, "id", "left_semi")
        n = must.count()
        rest = first_rows(documents.join(required, "id", "left_anti").groupBy("id").agg(F.min("pos").alias("_first")), max(max_documents - n, 0), "_first", "id")
        fill = documents.join(rest, "id").where(F.col("pos") == F.col("_first")).drop("_first")
        kept = must.unionByName(fill.select(*must.columns))
    there = kept.select(F.col("id").alias("document_id")).distinct()
    return kept, queries.join(needs, "IN", "left_semi"), chosen.join(there, "document_id", "left_semi").select(*qrels.columns)
