"""Learned-sparse vectors: validation, postings, statistics and retrieval.

An index is long: postings (dim, ordinal, weight) and documents (ordinal, id, ...). Scores
are sums over shared dimensions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quarrylight.operators.blocks import best_of_partition, query_index
from quarrylight.schemas import require
from quarrylight.session import Workspace

#: Queries that one pass over the documents carries; their vectors pass through the driver.
BLOCK_QUERIES = 50_000


def valid_sparse(vector: Column) -> Column:
    """Whether a struct (indices, values) is a sparse vector: equal lengths, distinct indices from 0, finite values other than 0."""
    i, v = vector["indices"], vector["values"]
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))) | (x == 0))
    return i.isNotNull() & v.isNotNull() & (F.size(i) == F.size(v)) & (F.size(F.array_distinct(i)) == F.size(i)) & ~F.exists(i, lambda x: x.isNull() | (x < 0)) & ~bad


def dense_to_sparse(vector: Column) -> Column:
    """The non-zero positions of an array with their values."""
    marked = F.filter(F.transform(vector, lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("v"))), lambda e: e["v"] != 0)
    return F.struct(F.transform(marked, lambda e: e["i"]).alias("indices"), F.transform(marked, lambda e: e["v"]).alias("values"))


def with_ordinal(df: DataFrame, *order: str, start: int = 0, name: str = "ordinal") -> DataFrame:
    """``df`` with consecutive numbers in the given order, without one task that holds all rows.

    Rows are range-partitioned by the order and written; the partitions' sizes (one row
    each) give the offsets. Rows that are equal in the order get some order among them.
    """
    space = Workspace(df.sparkSession, "ordinal")
    spread = space.write(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "rows")
    sizes = {r["_part"]: r["count"] for r in spread.groupBy("_part").count().collect()}
    offsets, total = {}, start
    for p in sorted(sizes):
        offsets[p] = total
        total += sizes[p]
    if not offsets:
        return spread.withColumn(name, F.lit(0).cast("long")).drop("_part")
    offset = F.element_at(F.map_from_arrays(F.array(*[F.lit(p) for p in offsets]), F.array(*[F.lit(o).cast("long") for o in offsets.values()])), F.col("_part"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return spread.withColumn(name, offset + within - 1).drop("_part")


def postings(documents: DataFrame, dimension: int | None = None) -> DataFrame:
    """(dim, ordinal, weight) of documents (ordinal, sparse). An invalid vector, or an index beyond ``dimension``, raises on reading."""
    checked = require(documents, valid_sparse(F.col("sparse")), "invalid sparse vector")
    rows = checked.select("ordinal", F.explode(F.arrays_zip("sparse.indices", "sparse.values")).alias("e"))
    found = rows.select(F.col("e.indices").cast("int").alias("dim"), "ordinal", F.col("e.values").cast("double").alias("weight"))
    return found if dimension is None else require(found, F.col("dim") < dimension, "index beyond the sparse dimension")


def index_statistics(entries: DataFrame, n_documents: DataFrame, dimension: int | None = None) -> DataFrame:
    """One row: document_count, sparse_dimension, active_dimension_count, posting_count; zeros for an empty index."""
    by_dim = entries.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    stats = by_dim.agg(F.coalesce(F.max("dim") + 1, F.lit(0)).alias("_top"), F.count(F.lit(1)).alias("active_dimension_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("posting_count"))
    count = n_documents.agg(F.count(F.lit(1)).alias("document_count"))
    top = F.lit(dimension) if dimension is not None else F.col("_top")
    return count.crossJoin(stats).select("document_count", top.cast("int").alias("sparse_dimension"), "active_dimension_count", "posting_count")  # one row each


def sparse_from_postings(entries: DataFrame) -> DataFrame:
    """(ordinal, sparse): each document's vector, indices ascending."""
    both = entries.groupBy("ordinal").agg(F.array_sort(F.collect_list(F.struct("dim", "weight"))).alias("e"))
    return both.select("ordinal", F.struct(F.col("e.dim").alias("indices"), F.col("e.weight").alias("values")).alias("sparse"))


def sparse_retrieve(
    queries: DataFrame, entries: DataFrame, documents: DataFrame, k: int = 10, min_score: float = 0.0, candidates: DataFrame | None = None,
    digits: int | None = 9, block: int = BLOCK_QUERIES, with_vectors: bool = False,
) -> DataFrame:
    """(query_id, rank, ordinal, id, score[, sparse]): documents by the sum of shared weights.

    With ``with_vectors`` each result carries its document's sparse vector.

    ``queries`` (query_id, sparse). Kept are scores above ``min_score`` (strictly), the k best
    of each query by score descending, then ordinal. ``candidates`` (query_id, document_id)
    restricts a query to documents whose source document, or id where there is none, is
    listed; a query that has no candidates at all is unrestricted. Negative weights count as
    they are. Invalid query vectors raise on reading.

    Unrestricted queries are the stated set: they travel in blocks over the documents'
    vectors, and a partition keeps k rows a query. Vectors are the column ``sparse`` of
    ``documents`` where there is one (then nothing is shuffled but results), else they are put
    together from the postings once and written. Restricted queries are joined with their
    candidates' postings only.
    """
    if k <= 0:
        raise ValueError("top_k must be positive")
    if min_score != min_score or abs(min_score) == float("inf"):
        raise ValueError("min_score must be finite")
    spark = queries.sparkSession
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("ordinal", T.LongType()), T.StructField("score", T.DoubleType())])
    asked = require(queries, valid_sparse(F.col("sparse")), "invalid sparse query").select("query_id", "sparse")
    owner = F.coalesce(F.nullif(F.col("source_document_id"), F.lit("")), F.col("id"))
    free, parts = asked, []
    if candidates is not None:
        listed = candidates.where("document_id IS NOT NULL").select("query_id", F.col("document_id").alias("_owner")).distinct()
        free = asked.join(listed.select("query_id").distinct(), "query_id", "left_anti")
        terms = asked.select("query_id", F.explode(F.arrays_zip("sparse.indices", "sparse.values")).alias("e")).select("query_id", F.col("e.indices").alias("dim"), F.col("e.values").alias("_q"))
        pairs = listed.join(documents.select("ordinal", owner.alias("_owner")), "_owner").select("query_id", "ordinal")
        total = F.sum(F.col("_q") * F.col("weight"))
        summed = pairs.join(entries, "ordinal").join(terms, ["query_id", "dim"]).groupBy("query_id", "ordinal").agg((F.round(total, digits) if digits is not None else total).alias("score"))
        parts.append(summed.where(F.col("score") > min_score))
    space = Workspace(spark, "sparse")
    n_free = free.count()
    blocks = max(1, -(-n_free // block)) if n_free else 0
    if blocks:
        sparse = F.col("sparse")
        if "sparse" in documents.columns:
            vectors = documents.select(F.col("ordinal").cast("long").alias("ordinal"), sparse["indices"].alias("d"), sparse["values"].alias("w"))
        else:
            vectors = space.write(sparse_from_postings(entries).select(F.col("ordinal").cast("long").alias("ordinal"), sparse["indices"].alias("d"), sparse["values"].alias("w")), "vectors")
    for i in range(blocks):
        mine = free.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        ids, index = query_index((r["query_id"], r["sparse"]["indices"], r["sparse"]["values"]) for r in mine.toLocalIterator())  # this block's queries
        found = vectors.mapInArrow(best_of_partition(ids, index, k, digits, schema, min_score, lambda ordinal: ordinal), schema)
        parts.append(space.write(_best(found, k), f"block-{i}") if blocks > 1 else found)
    if not parts:
        parts.append(spark.createDataFrame([], schema))
    best = _best(reduce(DataFrame.unionByName, parts), k)
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("ordinal"))
    carried = ["sparse"] if with_vectors else []
    named = best.withColumn("rank", F.row_number().over(place)).join(documents.select("ordinal", "id", *([c for c in carried if c in documents.columns])), "ordinal")
    if with_vectors and "sparse" not in documents.columns:
        named = named.join(sparse_from_postings(entries.join(best.select("ordinal").distinct(), "ordinal", "left_semi")), "ordinal")
    return named.select("query_id", "rank", "ordinal", "id", "score", *carried)


def _best(scored: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("ordinal"))
    return scored.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k).drop("_n")
