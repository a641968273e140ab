"""The queries of the core operators, over whole tables. Their SQL is in ``quarrylight.sql``.

Searches take as queries the rows whose number is divisible by 20, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylight import schemas
from quarrylight.functions.text import transform_text
from quarrylight.operators import analysis, cascade, ccsa, chunking, dense, enrich, fusion, lexical, mapping, metrics, reformulate, references, sparse, text
from quarrylight.sources import predictions as results
from quarrylight.sql import SQL as SQL
from quarrylight.streaming import indexing as streams


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# References

REFERENCES = [
    references.Reference("qrels", "document_id", "documents", "id", "judged_at", "ingested_at", "deleted_at"),
    references.Reference("qrels", "IN", "queries", "IN", "judged_at", "received_at"),
    references.Reference("queries", "IN", "qrels", "IN"),
]
ROW_KEYS = {"documents": "doc_id", "queries": "line_no", "qrels": "line_no"}


def _orphans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    tables = {t: _table(spark, sf_dir, t) for t in ROW_KEYS}
    return references.orphan_cascade(spark, tables, ROW_KEYS, REFERENCES), tables


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references without a counterpart."""
    return _orphans(spark, sf_dir)[0].where("level = 0").select("tbl", "field", F.col("row_key").alias("line_no"))


def p1_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every direct and inherited orphan with the round that found it."""
    return _orphans(spark, sf_dir)[0].select("tbl", "field", F.col("row_key").alias("line_no"), "level")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and inherited orphans per table, field and month."""
    found, tables = _orphans(spark, sf_dir)
    return references.orphan_report(found, tables, ROW_KEYS, {"qrels": "judged_at", "queries": "received_at"}).withColumn("month", F.col("month").cast("string"))


# Dense


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    return asked, rows.select(F.col("vec_id").alias("id"), "embedding", "label", F.lit(None).cast("bigint").alias("source_document_id"))


def dense_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.dense_retrieve(*_vectors(spark, sf_dir), k=10, kind="cosine", digits=6)


def dense_topk_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.dense_retrieve(*_vectors(spark, sf_dir), k=10, kind="dot_product", digits=6)


def _same_label(asked: DataFrame, documents: DataFrame) -> DataFrame:
    return asked.select("query_id", "label").join(documents.select(F.col("id").alias("document_id"), "label"), "label").select("query_id", "document_id")


def dense_topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates are the vectors of the query's own label."""
    asked, documents = _vectors(spark, sf_dir)
    return dense.dense_retrieve_candidates(asked, documents, _same_label(asked, documents), k=10, digits=6)


def dense_empty_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without candidates there are no results."""
    asked, documents = _vectors(spark, sf_dir)
    return dense.dense_retrieve_candidates(asked, documents, _same_label(asked, documents).where(F.lit(False)), k=10, digits=6)


def rerank_bi_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of a query by cosine, ties in input order."""
    asked, documents = _vectors(spark, sf_dir)
    pairs = dense.candidate_pairs(asked, documents, _same_label(asked, documents)).withColumn("pos", F.col("id"))
    rounded = dense.rank_candidates(pairs).withColumn("score", F.round("score", 6))
    return rounded.select("query_id", "id", "score")


def dense_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking metrics of dense retrieval, a vector of the query's label being relevant."""
    asked, documents = _vectors(spark, sf_dir)
    found = dense.dense_retrieve(asked, documents, k=10, digits=6)
    predictions = found.select(F.col("query_id").cast("string").alias("query_id"), "rank", F.col("id").cast("string").alias("document_id"), "score")
    needs = asked.select(F.col("query_id").cast("string").alias("id"), F.col("label").cast("string").alias("IN"))
    judged = documents.select(F.col("label").cast("string").alias("IN"), F.col("id").cast("string").alias("document_id"), F.lit(1).alias("label"))
    return metrics.evaluate(spark, predictions, needs, judged, ["Recall@10", "Precision@10", "HitRate@10", "MRR@10", "NDCG@10", "MAP@10"]).select("metric", F.round("value", 6).alias("value"))


# Lexical

def _lexical(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked = _table(spark, sf_dir, "queries").where("line_no % 20 = 0").select(F.col("line_no").alias("query_id"), "content")
    return asked, _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "content")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25_retrieve(*_lexical(spark, sf_dir), k=10)


def bm25_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 among the documents of each query's candidate list."""
    queries = _table(spark, sf_dir, "queries").where("line_no % 20 = 0")
    asked = queries.select(F.col("line_no").alias("query_id"), "content")
    documents = _table(spark, sf_dir, "documents")
    listed = queries.select(F.col("line_no").alias("query_id"), "IN").join(_table(spark, sf_dir, "input_mapping"), "IN")
    pairs = listed.join(documents.select(F.col("id").alias("document_id"), "doc_id"), "document_id").select("query_id", F.col("doc_id").alias("document_id"))
    return lexical.bm25_candidates(asked, documents.select(F.col("doc_id").alias("id"), "content"), pairs, k=10)


def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and collection frequency of every word."""
    rows = lexical.term_postings(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "content"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


# Sparse: the positive components of the vectors

def _sparse(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    positive = F.transform("embedding", lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", sparse.dense_to_sparse(positive).alias("sparse"))
    documents = rows.select(F.col("id").alias("ordinal"), F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("source_document_id"), "label", "sparse")
    return rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "label", "sparse"), documents


def sparse_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.postings(_sparse(spark, sf_dir)[1]).select("dim", "ordinal", F.round("weight", 6).alias("weight"))


def sparse_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _sparse(spark, sf_dir)[1]
    return sparse.index_statistics(sparse.postings(documents), documents)


def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, documents = _sparse(spark, sf_dir)
    return sparse.sparse_retrieve(asked, sparse.postings(documents), documents, k=10, digits=6)


def sparse_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates are the vectors of the query's own label."""
    asked, documents = _sparse(spark, sf_dir)
    listed = asked.select("query_id", "label").join(documents.select(F.col("id").alias("document_id"), "label"), "label").select("query_id", "document_id")
    return sparse.sparse_retrieve(asked, sparse.postings(documents), documents, k=10, digits=6, candidates=listed)


def sparse_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, documents = _sparse(spark, sf_dir)
    return sparse.sparse_retrieve(asked, sparse.postings(documents), documents, k=1000, digits=6, min_score=0.25)


# Ranked lists: the runs of predictions are the sources

WEIGHTS = {"dense-baseline": 1.0, "dense-repeated": 0.5, "sparse-ccsa": 2.0}


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "predictions")
    return rows.select("query_id", F.col("run_id").alias("source"), "rank", "id", F.when(F.col("id") != F.col("document_id"), F.col("document_id")).alias("source_document_id"), "score")


def _fused(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", F.round("score", 8).alias("score"))


def fuse_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(fusion.reciprocal_rank_fusion(_ranked(spark, sf_dir), WEIGHTS))


def fuse_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(fusion.score_fusion(_ranked(spark, sf_dir), WEIGHTS))


def fuse_sum_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(fusion.score_fusion(_ranked(spark, sf_dir), WEIGHTS, normalize="minmax"))


def fuse_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(fusion.linear_score_fusion(_ranked(spark, sf_dir), {"sparse-ccsa": 1.0, "dense-baseline": -0.25}))


def fuse_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(fusion.zscore_fusion(_ranked(spark, sf_dir), WEIGHTS))


def fuse_missing_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(fusion.score_fusion(_ranked(spark, sf_dir), WEIGHTS, missing_score=-1.0))


def topk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best documents of each query after rank fusion."""
    fused = fusion.reciprocal_rank_fusion(_ranked(spark, sf_dir), WEIGHTS).withColumn("score", F.round("score", 9))
    return cascade.top_k_documents(fused, 3).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def chunk_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunk of each document in each list; a missing score counts as minus the rank."""
    ranked = _ranked(spark, sf_dir).withColumn("score", metrics.ranking_score(F.col("score"), F.col("rank"))).dropDuplicates()
    return cascade.chunk_cascade(ranked, 1, ("source", "query_id")).select("source", "query_id", "rank", "id", F.round("score", 6).alias("score"))


def chunk_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.collapse_chunks(_table(spark, sf_dir, "predictions"), ("run_id", "query_id"))
    return found.select("run_id", "query_id", "document_id", F.round("score", 6).alias("score"), "rank")


# Metrics

ALL_METRICS = [f"{m}@{k}" for m in ("Recall", "Precision", "HitRate", "MRR", "NDCG", "MAP") for k in (1, 5, 10)]


def _metrics(names: list[str]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = [_table(spark, sf_dir, t) for t in ("predictions", "queries", "qrels")]
        found = metrics.evaluate(spark, *tables, names, by=("run_id",), policy="max", check=False)
        return found.select("run_id", "metric", F.round("value", 6).alias("value"))

    return query


def metrics_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG and MRR of every wording; wordings of one need are scored apart."""
    tables = [_table(spark, sf_dir, t) for t in ("predictions", "queries", "qrels")]
    found = metrics.query_metrics(*tables, ["NDCG@10", "MRR@10"], by=("run_id",), policy="max", check=False)
    return found.select("run_id", "query_id", "metric", F.round("value", 6).alias("value"))


# Text, filter, enrichment

def prefix_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "documents").select("doc_id", "id", "content")
    return text.preprocess(df, nulls="keep", prefix="passage: ", replace={r"\s+": " "}).select("doc_id", "content")


def preprocess_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "queries").select("line_no", "id", "content")
    return text.preprocess(df, nulls="keep", prefix="query: ", suffix=" ?", replace={r"\s+": " ", r"(\w+)@(\d+)": r"\1 at \2"}).select("line_no", "content")


def repeat_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    repeated = text.repeat_query(_table(spark, sf_dir, "queries").select("line_no", "content"))
    return repeated.withColumn("content", transform_text(F.col("content"), prefix="query: "))


FILTER = {"include_regex": "(dense|sparse|metric)", "exclude_regex": "shard", "min_words": 20, "max_words": 400, "flags": "i"}


def content_filter_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.filter_by_content(_table(spark, sf_dir, "documents"), nulls="reject", **FILTER)[0].select("doc_id")


def content_filter_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.filter_by_content(_table(spark, sf_dir, "documents"), nulls="reject", **FILTER)[1].select("doc_id")


def identity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents as they are; rows without content are none of its input."""
    return text.identity_parse(_table(spark, sf_dir, "documents").where("content IS NOT NULL")).select("doc_id", "content")


def query_to_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.query_text(_table(spark, sf_dir, "queries").where("content IS NOT NULL"))


def _judgment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "qrels").where("document_id IS NOT NULL").groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("id", F.concat(F.lit('{"judgments":'), F.col("n").cast("string"), F.lit("}")).alias("meta"))


def enrich_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the number of their judgments in their metadata; documents without any stay as they are."""
    return enrich.enrich(_table(spark, sf_dir, "documents").select("doc_id", "id", "meta"), _judgment_counts(spark, sf_dir), on_missing="keep").select("doc_id", "meta")


def enrich_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose metadata has the keys ``topic`` or ``dataset`` that a mapping would bring."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "id", "meta")
    brought = documents.select("id").distinct().withColumn("meta", F.lit('{"topic":"x","dataset":1}'))
    return enrich.enrichment_conflicts(documents, brought).select("id", "keys")


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "documents").where("content IS NOT NULL").select(F.col("doc_id").cast("string").alias("id"), "content")
    return chunking.chunk_documents(df)


def reformulate_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variants of every query by a stand-in for the service."""
    df = _table(spark, sf_dir, "queries").where("content IS NOT NULL").select("line_no", "content")
    answer = lambda body: {"variants": {"texts": [body["ask"], body["ask"] + " ?"]}}
    return reformulate.reformulate(df, answer, "ask", "variants.texts").select("line_no", "variant", "content")


# Mappings

RECIPE = {
    "seed": 7, "query_subset_size": None, "document_subset_size": None, "include_annotated_docs": False, "use_all_selected_documents_for_every_query": False,
    "random_docs_per_query": 0, "easy_negative_docs_per_query": 0, "gold_passage_docs_per_query": 0,
}


def _mapping(**changes):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        documents = _table(spark, sf_dir, "documents").select("id", F.col("doc_id").alias("pos"))
        queries = _table(spark, sf_dir, "queries").select("IN", F.col("line_no").alias("pos"))
        return mapping.generate_mapping(spark, documents, queries, _table(spark, sf_dir, "qrels"), RECIPE | changes)

    return query


def mapping_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _mapping(include_annotated_docs=True)(spark, sf_dir)
    needs = _table(spark, sf_dir, "queries").where("`IN` IS NOT NULL").select("IN")
    found = mapping.mapping_statistics(made, needs, _table(spark, sf_dir, "documents").select(F.col("id").alias("document_id")))
    return found.withColumn("candidate_count_mean", F.round("candidate_count_mean", 6))


def mapping_first_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored mapping without repetitions, for needs and documents that exist."""
    stored = _table(spark, sf_dir, "input_mapping")
    queries, documents = _table(spark, sf_dir, "queries"), _table(spark, sf_dir, "documents")
    known = stored.join(queries.select("IN").distinct(), "IN", "left_semi").join(documents.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_semi")
    return mapping.resolve_mapping(known, queries, documents)


def _limited(part: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        documents = _table(spark, sf_dir, "documents").select("id", F.col("doc_id").alias("pos"))
        queries = _table(spark, sf_dir, "queries").select("line_no", "IN", F.col("line_no").alias("pos"))
        qrels = _table(spark, sf_dir, "qrels").select("line_no", "IN", "document_id", F.col("line_no").alias("pos"))
        found = mapping.limit_dataset(documents, queries, qrels, 400, 25)[part]
        return found.select(F.col("pos").alias("line_no")) if part else found.select(F.col("pos").alias("doc_id"))

    return query


# Validation and predictions

def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.duplicate_ids(_table(spark, sf_dir, "documents"), "id")


def qrel_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.qrel_conflicts(_table(spark, sf_dir, "qrels"))


def validate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of queries and qrels are no strict records, by problem."""
    parts = []
    for name, kind, fields in (("queries", "query", ["id", "content", "IN"]), ("qrels", "qrel", ["IN", "document_id", "label"])):
        df = _table(spark, sf_dir, name)
        record = F.to_json(F.struct(*[F.col(c) for c in fields], *([F.from_json("meta", "map<string,variant>").alias("meta")] if kind == "query" else [])), {"ignoreNullFields": "true"})
        parts.append(df.select(F.lit(name).alias("tbl"), schemas.record_problem(record, kind).alias("problem")))
    return parts[0].union(parts[1]).where("problem IS NOT NULL").groupBy("tbl", "problem").agg(F.count(F.lit(1)).alias("n"))


def predictions_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's results as nested records, one a query."""
    rows = _table(spark, sf_dir, "predictions").withColumn("query_id", F.concat_ws("/", "run_id", "query_id")).dropDuplicates(["query_id", "rank", "id"])
    return results.nest(rows)


def predictions_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records flattened again; rank is the place in the list."""
    found = results.flatten(predictions_nested(spark, sf_dir))
    return found.select("query_id", "rank", "id", "document_id", F.round("score", 6).alias("score"))


# Analysis

def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.query_summary(*[_table(spark, sf_dir, t) for t in ("predictions", "queries", "qrels")])


def query_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _summary(spark, sf_dir)
    return found.withColumns({c: F.round(c, 6) for c in ("reciprocal_rank", "recall_at_run_depth")})


def run_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analysis.run_means(_summary(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("mean_reciprocal_rank", "mean_recall")})


def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the dense baseline against those of the sparse run."""
    found = _metrics(ALL_METRICS)(spark, sf_dir)
    return analysis.compare_metrics(found.where("run_id = 'dense-baseline'"), found.where("run_id = 'sparse-ccsa'")).withColumn("delta", F.round("delta", 6))


def paired_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.paired_outcomes(_summary(spark, sf_dir), "dense-baseline", "sparse-ccsa").withColumn("mean_delta", F.round("mean_delta", 6))


# Codes and events

def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    model, _ = ccsa.train(ccsa.training_vectors(rows, limit=20_000), codebooks=8, size=16, epochs=3, batch_size=256)
    return ccsa.encode_sparse(rows.select(F.col("vec_id").alias("ordinal"), "embedding"), model)


def ccsa_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active dimensions of every vector by an autoencoder trained here."""
    return _codes(spark, sf_dir).select("ordinal", F.col("sparse.indices").alias("dims"))


def ccsa_postings_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of each dimension's posting list."""
    return sparse.postings(_codes(spark, sf_dir)).groupBy("dim").agg(F.count(F.lit(1)).alias("n"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and ten minutes; the plan that a stream of events would run."""
    found = streams.event_counts(_table(spark, sf_dir, "events"), "ts", "event_type", "value")
    return found.withColumn("total", F.round("total", 4))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_cascade, p1_report, dense_topk_cosine, dense_topk_dot, dense_topk_candidates, dense_empty_candidates, rerank_bi_encoder, dense_metrics,
        bm25_topk, bm25_candidates, term_statistics, sparse_postings, sparse_index_stats, sparse_topk, sparse_candidates, sparse_min_score,
        fuse_rrf, fuse_sum, fuse_sum_norm, fuse_linear, fuse_zscore, fuse_missing_score, topk_documents, chunk_cascade, chunk_collapse, metrics_per_query,
        prefix_documents, preprocess_queries, repeat_queries, content_filter_kept, content_filter_rejected, identity_parse, query_to_string,
        enrich_documents, enrich_conflicts, chunk_documents, reformulate_explode, mapping_stats, mapping_first_places,
        duplicate_ids, qrel_conflicts, validate_records, predictions_nested, predictions_flat, query_summary, run_means, run_comparison, paired_outcomes,
        ccsa_codes, ccsa_postings_balance, event_windows,
    )
} | {
    "metrics_all": _metrics(ALL_METRICS),
    **{f"metric_{m.lower()}": _metrics([f"{m}@{k}" for k in (1, 5, 10)]) for m in ("Recall", "Precision", "HitRate", "MRR", "NDCG", "MAP")},
    "mapping_all_docs": _mapping(use_all_selected_documents_for_every_query=True, query_subset_size=20, document_subset_size=100),
    "mapping_annotated": _mapping(include_annotated_docs=True),
    "mapping_random": _mapping(random_docs_per_query=5),
    "mapping_easy_negatives": _mapping(include_annotated_docs=True, easy_negative_docs_per_query=2),
    "mapping_gold_negatives": _mapping(gold_passage_docs_per_query=4),
    "mapping_mixed": _mapping(include_annotated_docs=True, random_docs_per_query=3, gold_passage_docs_per_query=3),
    "limit_documents": _limited(0),
    "limit_queries": _limited(1),
    "limit_qrels": _limited(2),
}
