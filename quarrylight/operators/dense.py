"""Dense retrieval and reranking by dot product or cosine."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quarrylight.operators.blocks import arrow_types, keep_best
from quarrylight.schemas import require
from quarrylight.session import Workspace

SIMILARITIES = ("cosine", "dot_product")
#: Bytes of query vectors that one pass over the documents carries; more queries take more passes.
BLOCK_BYTES = 32 << 20
#: Documents that are multiplied with a block of queries at a time.
ROWS = 1024


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, kind: str = "cosine") -> Column:
    """Similarity of two vectors; a zero vector has cosine 0 with everything."""
    if kind not in SIMILARITIES:
        raise ValueError(f"unknown similarity {kind!r}")
    product = dot(a, b)
    if kind == "dot_product":
        return product
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(product / norms)


def rank_candidates(pairs: DataFrame, kind: str = "cosine", query: str = "query_id", order: str = "pos") -> DataFrame:
    """All candidates of each query by similarity descending; ties keep their input order.

    ``pairs``: (query, order, id, embedding, query_embedding, ...). A missing embedding or a
    wrong dimension raises on reading and names the document. No candidates, no rows.
    """
    checked = require(pairs, F.col("embedding").isNotNull() & F.col("query_embedding").isNotNull(), F.concat(F.lit("no embedding for "), F.col("id").cast("string")))
    checked = require(checked, F.size("embedding") == F.size("query_embedding"), F.concat(F.lit("wrong dimension of "), F.col("id").cast("string")))
    scored = checked.withColumn("score", similarity(F.col("query_embedding"), F.col("embedding"), kind)).drop("embedding", "query_embedding")
    place = Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(order))
    return scored.withColumn("rank", F.row_number().over(place))


def top_k(scored: DataFrame, k: int, query: str = "query_id", tie: Column | None = None) -> DataFrame:
    """The k best rows of each query by score descending, then id as text descending, with their rank."""
    if k <= 0:
        raise ValueError("top_k must be positive")
    place = Window.partitionBy(query).orderBy(F.col("score").desc(), tie if tie is not None else F.col("id").cast("string").desc())
    return scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def _best_of_each(queries: list, matrix: np.ndarray, kind: str, k: int, digits: int | None, schema: T.StructType):
    """A function over batches of (id, embedding) that keeps each query's best of a partition."""
    unit = matrix
    if kind == "cosine":
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        unit = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries]  # at most 2k entries each

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                vectors = part.column(1)
                if vectors.null_count or not pc.all(pc.equal(pc.list_value_length(vectors), matrix.shape[1])).as_py() or vectors.flatten().null_count:
                    raise ValueError("a document has no embedding or one of another dimension")
                docs = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, matrix.shape[1])
                if kind == "cosine":
                    norms = np.linalg.norm(docs, axis=1, keepdims=True)
                    docs = np.divide(docs, norms, out=np.zeros_like(docs), where=norms > 0)
                scores = unit @ docs.T
                if digits is not None:
                    scores = np.round(scores, digits) + 0.0
                ids = part.column(0).to_pylist()
                if len(ids) > k:  # all that tie with the k-th stay until ids decide
                    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
                else:
                    least = np.full(len(queries), -np.inf)
                for i in range(len(queries)):
                    hits = np.flatnonzero(scores[i] >= least[i])
                    best[i].extend((float(scores[i, j]), ids[j]) for j in hits)
                    keep_best(best[i], k, None)
        rows = [(queries[i], d, s) for i in range(len(queries)) for s, d in best[i]]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        arrow = [pa.array(c, type=t) for c, t in zip(columns, arrow_types(schema), strict=True)]
        yield pa.RecordBatch.from_arrays(arrow, names=names)

    return run


def dense_retrieve(queries: DataFrame, documents: DataFrame, k: int = 10, kind: str = "cosine", digits: int | None = 9, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, id, score): the k most similar documents of every query, exactly.

    ``queries`` (query_id, embedding) is the stated set of queries; it travels to the
    executors in blocks of at most ``block_bytes``, each block in one pass over ``documents``
    (id, embedding). A partition keeps k documents of each query, so what is shuffled is
    queries times k times partitions, never pairs. Scores are rounded to ``digits`` before
    ties are broken by the id as text, descending. Missing or ragged embeddings raise. No
    queries or no documents, no rows. Every block scans the documents again: a million
    queries of 768 dimensions are 184 blocks of 32 MB, so for very many queries give larger
    blocks, as far as the driver and a Python worker can hold them.
    """
    if k <= 0:
        raise ValueError("top_k must be positive")
    if kind not in SIMILARITIES:
        raise ValueError(f"unknown similarity {kind!r}")
    spark = queries.sparkSession
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", documents.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    space = Workspace(spark, "dense")
    done: list[DataFrame] = []
    block: list = []
    width = 0

    def scored(rows: list) -> DataFrame:
        matrix = np.array([r["embedding"] for r in rows], np.float64)
        run = _best_of_each([r["query_id"] for r in rows], matrix, kind, k, digits, schema)
        return documents.select("id", "embedding").mapInArrow(run, schema)

    for row in queries.select("query_id", "embedding").toLocalIterator(prefetchPartitions=True):
        if row["embedding"] is None or block and len(row["embedding"]) != width:
            raise ValueError(f"query {row['query_id']!r} has no embedding or one of another dimension")
        width = len(row["embedding"])
        block.append(row)
        if len(block) * width * 8 >= block_bytes:  # one block at a time: the driver holds a single matrix
            done.append(space.write(top_k(scored(block), k).select("query_id", "id", "score"), f"block-{len(done)}"))
            block = []
    if block:
        done.append(scored(block))
    best = reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], schema)
    return top_k(best, k).select("query_id", "rank", "id", "score")


def candidate_pairs(queries: DataFrame, documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, query_embedding, id, embedding): documents whose id or source document is a candidate.

    ``candidates`` (query_id, document_id). Both ways are equi-joins, united without
    repetition; a query without candidates has no rows.
    """
    asked = candidates.where("document_id IS NOT NULL").select("query_id", "document_id").distinct()
    docs = documents.select("id", "embedding", "source_document_id")
    own = asked.join(docs, F.col("document_id") == F.col("id"))
    chunks = asked.join(docs, (F.col("document_id") == F.col("source_document_id")))
    found = own.select("query_id", "id", "embedding").union(chunks.select("query_id", "id", "embedding")).dropDuplicates(["query_id", "id"])
    return found.join(queries.select("query_id", F.col("embedding").alias("query_embedding")), "query_id")


def dense_retrieve_candidates(queries: DataFrame, documents: DataFrame, candidates: DataFrame, k: int = 10, kind: str = "cosine", digits: int | None = 9) -> DataFrame:
    """(query_id, rank, id, score): as ``dense_retrieve``, among each query's candidates only."""
    pairs = candidate_pairs(queries, documents, candidates)
    score = similarity(F.col("query_embedding"), F.col("embedding"), kind)
    scored = pairs.select("query_id", "id", (F.round(score, digits) if digits is not None else score).alias("score"))
    return top_k(scored, k).select("query_id", "rank", "id", "score")
