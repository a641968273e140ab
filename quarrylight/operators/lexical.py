"""Lexical retrieval by BM25 over the words of documents.

A stated set of queries is matched against all documents in blocks. The corpus is cut into
words once a block; what is written holds, of each document, its length and the counts of
the block's words, as numbers. Statistics and scores are made from that: every partition
scores its documents against the block and keeps the k best of each query, so frequent
words never make pairs that travel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from quarrylight.functions.text import words
from quarrylight.operators.blocks import best_of_partition, looked_up, query_index
from quarrylight.operators.dense import top_k
from quarrylight.session import Workspace

#: Queries that one pass over the documents carries; their words and lists pass through the driver.
BLOCK_QUERIES = 50_000


def term_postings(documents: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """(term, key, tf): the words of each document; null and empty contents have none."""
    exploded = documents.select(F.col(key).alias("key"), F.explode(words(F.col(content))).alias("term"))
    return exploded.groupBy("term", "key").agg(F.count(F.lit(1)).cast("int").alias("tf")).select("term", F.col("key").alias(key), "tf")


def bm25_retrieve(queries: DataFrame, documents: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, digits: int = 6, block: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, id, score): the k best documents of every query that share a word with it.

    ``queries`` (query_id, content), ``documents`` (id, content), ids unique. Each distinct word
    of a query counts once: idf * tf (k1 + 1) / (tf + k1 (1 - b + b length / mean length)),
    idf = ln(1 + (N - n + 0.5) / (n + 0.5)), N being the documents that have words. Scores are
    rounded to ``digits`` before ties are broken by the id as text, descending. Queries
    without words have no rows.
    """
    if k <= 0:
        raise ValueError("top_k must be positive")
    spark = queries.sparkSession
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", documents.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    space = Workspace(spark, "bm25")
    asked = space.write(queries.select("query_id", F.explode(F.array_distinct(words(F.col("content")))).alias("term")), "asked")
    blocks = max(1, -(-asked.select("query_id").distinct().count() // block))
    size, best = None, None
    for i in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        vocabulary = [r["term"] for r in mine.select("term").distinct().collect()]  # this block's words
        counted = space.write(word_counts(documents, vocabulary), f"counts-{i}")
        if size is None:
            size = counted.agg(F.count_if(F.col("length") > 0), F.sum("length")).first()
        n_docs, mean = size[0], (size[1] / size[0] if size[0] else 1.0)
        frequency = {r["term"]: r["n"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
        number = {t: j for j, t in enumerate(vocabulary)}
        idf = lambda n: math.log(1 + (n_docs - n + 0.5) / (n + 0.5))  # noqa: B023, E731
        lists = [(r["query_id"], [number[t] for t in r["t"]]) for r in mine.groupBy("query_id").agg(F.collect_list("term").alias("t")).collect()]  # this block's queries
        ids, index = query_index((q, known := [t for t in ts if t in frequency], [idf(frequency[t]) for t in known]) for q, ts in lists)

        def weigh(tf, rows, batch, mean=mean):
            norm = k1 * (1 - b + b * batch.column(3).to_numpy()[rows] / mean)
            return tf * (k1 + 1) / (tf + norm)

        matched = counted.where(F.size("terms") > 0).select("id", "terms", "tfs", "length")
        found = matched.mapInArrow(best_of_partition(ids, index, k, digits, schema, weigh=weigh), schema)
        if blocks > 1:  # one block at a time: the driver holds a single index
            found = space.write(top_k(found, k).select("query_id", "id", "score"), f"block-{i}")
            space.drop(f"counts-{i}")
        best = found if best is None else best.unionByName(found)
    return top_k(best, k).select("query_id", "rank", "id", "score")


def word_counts(documents: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(id, length, terms ARRAY<INT>, tfs ARRAY<INT>): a document's number of words, and how often it has those of a vocabulary.

    Terms are numbered as in ``vocabulary``. The words are cut by the JVM and looked up in
    Arrow; what comes out holds no text. Documents without words are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = pa.array(vocabulary, pa.string())
        for batch in batches:
            lists = batch.column(1)
            rows, _, numbers = looked_up(lists, keys)
            cells, tfs = np.unique(rows * max(len(vocabulary), 1) + numbers, return_counts=True)
            ends = np.r_[0, np.cumsum(np.bincount(cells // max(len(vocabulary), 1), minlength=batch.num_rows))].astype(np.int32)
            as_lists = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32)))  # noqa: B023, E731
            lengths = pc.list_value_length(lists).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), lengths, as_lists(cells % max(len(vocabulary), 1)), as_lists(tfs)], names=["id", "length", "terms", "tfs"])

    schema = T.StructType([
        T.StructField("id", documents.schema["id"].dataType), T.StructField("length", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType())),
    ])
    return documents.select("id", words(F.col("content")).alias("_words")).where(F.size("_words") > 0).mapInArrow(run, schema)


def bm25_candidates(queries: DataFrame, documents: DataFrame, candidates: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, digits: int = 6) -> DataFrame:
    """As ``bm25_retrieve``, among each query's candidates (query_id, document_id) only, by joins.

    A query without candidates has no rows. Statistics are those of the whole corpus.
    """
    tokenised = documents.select("id", words(F.col("content")).alias("_words")).where(F.size("_words") > 0)
    n_docs, mean = tokenised.agg(F.count(F.lit(1)), F.avg(F.size("_words"))).first()
    asked = queries.select("query_id", F.array_distinct(words(F.col("content"))).alias("_terms"))
    vocabulary = asked.select(F.explode("_terms").alias("term")).distinct()
    seen = tokenised.select(F.explode(F.array_distinct("_words")).alias("term")).join(vocabulary, "term", "left_semi")
    frequency = seen.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    pairs = candidates.where("document_id IS NOT NULL").select("query_id", F.col("document_id").alias("id")).distinct().join(tokenised, "id").join(asked, "query_id")
    shared = pairs.select("query_id", "id", F.size("_words").alias("_len"), F.explode(F.filter("_words", lambda t: F.array_contains("_terms", t))).alias("term"))
    tf = shared.groupBy("query_id", "id", "_len", "term").agg(F.count(F.lit(1)).alias("tf")).join(frequency, "term")
    idf = F.log(1 + (F.lit(float(n_docs)) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("_len") / F.lit(mean or 1.0)))
    scored = tf.groupBy("query_id", "id").agg(F.round(F.sum(weight), digits).alias("score"))
    return top_k(scored, k).select("query_id", "rank", "id", "score")
