"""Queries that go through a source or sink and back, through the stages, or through models with known answers.

What they write lies in a workspace of the shared folder. Their SQL is in ``quarrylight.store_sql``.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylight.operators import ccsa, chunking, metrics, models, references, sparse
from quarrylight.plans import stages
from quarrylight.session import Workspace
from quarrylight.sources import artifacts, benchmark, indexes, predictions as results, records
from quarrylight.store_sql import SQL as SQL
from quarrylight.streaming import indexing as streams


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


# Record files


def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines, written and read again."""
    path = Workspace(spark, "jsonl").path("documents")
    records.write_jsonl(_table(spark, sf_dir, "documents").select("doc_id", "id", "title", "content"), path)
    return records.read_jsonl(spark, path, _schema("doc_id BIGINT, id STRING, title STRING, content STRING"))


def _strict_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "queries").where("content IS NOT NULL AND `IN` <> '' AND id <> '' AND meta IS NOT NULL")
    return rows.select("id", "content", "IN", F.parse_json("meta").alias("meta"))


def strict_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries as strict records, written and read by the strict reader."""
    path = Workspace(spark, "strict").path("queries")
    records.write_jsonl(_strict_queries(spark, sf_dir), path)
    return records.read_records(spark, path, "query").select("id", "content", "IN")


def indexing_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an indexing of all documents in batches of 64 reports of its input file."""
    path = Workspace(spark, "batches").path("documents")
    first = _table(spark, sf_dir, "documents").where("content IS NOT NULL AND id <> ''").groupBy("id").agg(F.min_by("content", "doc_id").alias("content"))
    records.write_jsonl(first.select("id", "content", F.parse_json(F.lit("{}")).alias("meta")), path)
    plan = records.batch_plan(spark, path, 64)
    return spark.createDataFrame([(plan["document_count"], plan["batch_count"], records.count_lines(spark, path), len(plan["sha256"]))], "documents BIGINT, batches BIGINT, lines BIGINT, digest_length INT")


def metadata_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata mapping, written as lines of {id, meta} and read by the strict reader."""
    path = Workspace(spark, "metadata").path("mapping")
    n = _table(spark, sf_dir, "qrels").where("document_id <> ''").groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    records.write_jsonl(n.select("id", F.parse_json(F.concat(F.lit('{"judgments":'), F.col("n").cast("string"), F.lit("}"))).alias("meta")), path)
    return records.read_metadata_mapping(spark, path)


def json_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region as a JSON artifact, read again, with the digest of its name."""
    space, rows = Workspace(spark, "artifacts"), []
    for r in _table(spark, sf_dir, "region").collect():  # a fixed table of five rows
        path = records.write_json(spark, space.path(f"{r['r_regionkey']}.json"), {"key": r["r_regionkey"], "name": r["r_name"], "tags": {r["r_name"]}})
        back = records.read_json(spark, path)
        rows.append((back["key"], back["tags"][0], records.sha256_text(back["name"])))
    return spark.createDataFrame(rows, "r_regionkey INT, r_name STRING, digest STRING")


def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").where("content IS NOT NULL").select("doc_id", F.sha2("content", 256).alias("digest"))


def predictions_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's results, written as nested records, read and flattened."""
    path = Workspace(spark, "predictions").path("rows")
    rows = _table(spark, sf_dir, "predictions").withColumn("query_id", F.concat_ws("/", "run_id", "query_id")).dropDuplicates(["query_id", "rank", "id"])
    results.write_predictions(rows, path)
    return results.flatten(results.read_predictions(spark, path)).select("query_id", "rank", "id", "document_id", F.round("score", 6).alias("score"))


def query_extra_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extra data of queries: here their whole metadata, put there before."""
    rows = _table(spark, sf_dir, "queries").where("meta IS NOT NULL")
    held = rows.select(F.col("line_no").cast("string").alias("id"), F.concat(F.lit('{"_extra_data":'), F.col("meta"), F.lit("}")).alias("meta"))
    return results.query_data(held)


# Benchmark files


def _benchmark(spark: SparkSession, sf_dir: str) -> str:
    root = Workspace(spark, "benchmark").path("raw")
    documents, queries, qrels = (_table(spark, sf_dir, t) for t in ("documents", "queries", "qrels"))
    records.write_jsonl(documents.groupBy(F.col("id").alias("_id")).agg(F.min_by("title", "doc_id").alias("title"), F.min_by("text", "doc_id").alias("text")), f"{root}/corpus.jsonl")
    records.write_jsonl(queries.where("`IN` <> ''").groupBy(F.col("IN").alias("_id")).agg(F.min_by("content", "line_no").alias("text")), f"{root}/queries.jsonl")
    plain = ~F.concat("IN", "document_id").rlike(r"[\t\n\r]")  # such a file can't hold others
    judged = qrels.where("`IN` <> '' AND document_id <> ''").where(plain).groupBy("IN", "document_id").agg(F.max("label").alias("label"))
    judged.select(F.concat_ws("\t", "IN", F.lit("0"), "document_id", "label").alias("value")).write.text(f"{root}/qrels/test.tsv")
    return root


def benchmark_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and texts as the reader of a benchmark's corpus joins them."""
    return benchmark.benchmark_documents(spark, f"{_benchmark(spark, sf_dir)}/corpus.jsonl", "own").select("id", "content")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.benchmark_queries(spark, f"{_benchmark(spark, sf_dir)}/queries.jsonl", "own").select("id", "IN", "content")


def benchmark_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments of a file of four columns without header."""
    return benchmark.benchmark_qrels(spark, f"{_benchmark(spark, sf_dir)}/qrels/test.tsv").select("IN", "document_id", "label")


def benchmark_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of records that a preparation writes."""
    root = _benchmark(spark, sf_dir)
    made = benchmark.prepare_benchmark(spark, root, f"{root}-made", "own")
    return spark.createDataFrame(sorted(made.items()), "name STRING, n BIGINT")


# Stores


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("pos"), "label", "embedding")
    positive = F.transform("embedding", lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
    return rows.withColumn("sparse", sparse.dense_to_sparse(positive))


def dense_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense index, written and read again."""
    path = Workspace(spark, "dense-store").path("index")
    indexes.write_dense_index(_vectors(spark, sf_dir).drop("sparse"), path, "dot_product")
    documents, similarity = indexes.read_dense_index(spark, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return documents.select("id", "label", F.size("embedding").alias("dimension"), F.round(total, 5).alias("total"), F.lit(similarity).alias("similarity"))


def _sparse_store(spark: SparkSession, sf_dir: str) -> str:
    """An index of two batches: the vectors of even numbers, then those of odd ones."""
    path, rows = Workspace(spark, "sparse-store").path("index"), _vectors(spark, sf_dir)
    indexes.write_sparse_index(rows.where("pos % 2 = 0"), path)
    indexes.write_sparse_index(rows.where("pos % 2 = 1"), path, append=True)
    return path


def sparse_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents with their ordinals over both batches."""
    return indexes.read_sparse_index(spark, _sparse_store(spark, sf_dir))[0].select("id", "ordinal", "label", F.size("sparse.indices").alias("n_active"))


def sparse_store_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _sparse_store(spark, sf_dir)
    indexes.merge_segments(spark, path)
    return indexes.read_sparse_index(spark, path)[1].select("dim", "ordinal", F.round("weight", 6).alias("weight"))


def sparse_store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = indexes.read_sparse_index(spark, _sparse_store(spark, sf_dir))[2]
    return spark.createDataFrame([tuple(stats.values())], ", ".join(f"{k} BIGINT" for k in stats))


def mapping_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate mapping, stored and read again with its metadata."""
    path = indexes.write_mapping(_table(spark, sf_dir, "input_mapping"), {"dataset": "own"}, Workspace(spark, "mapping-store").path("mapping"))
    found, about = indexes.read_mapping(spark, path)
    return found.select("IN", "pos", "document_id", F.lit(about["dataset"]).alias("dataset"))


def prepared_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics that the mapping stage stores."""
    recipe = {
        "seed": 7, "query_subset_size": None, "document_subset_size": None, "include_annotated_docs": True, "use_all_selected_documents_for_every_query": False,
        "random_docs_per_query": 0, "easy_negative_docs_per_query": 0, "gold_passage_docs_per_query": 0,
    }
    documents = _table(spark, sf_dir, "documents").select("id", F.col("doc_id").alias("pos"))
    queries = _table(spark, sf_dir, "queries").select("IN", F.col("line_no").alias("pos"))
    path = stages.prepare_mapping(spark, Workspace(spark, "stage").path("mappings"), "m1", documents, queries, _table(spark, sf_dir, "qrels"), recipe)
    about = indexes.read_mapping(spark, path)[1]
    names = ["query_count", "active_document_count", "candidate_count_min", "candidate_count_max"]
    return spark.createDataFrame([(*[about[n] for n in names], round(about["candidate_count_mean"], 6))], ", ".join(f"{n} BIGINT" for n in names) + ", candidate_count_mean DOUBLE")


class _FileClient:
    """A stand-in for a search engine: every bulk becomes a file of a folder that all executors share."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.folder, recursive=True)

    def bulk(self, index: str, documents: list[tuple[str, dict]], refresh: bool) -> None:
        body = "".join(json.dumps({"id": i, **d}, ensure_ascii=False) + "\n" for i, d in documents)
        with self.files.open_output_stream(f"{self.folder}/{index}-{uuid.uuid5(uuid.NAMESPACE_OID, documents[0][0])}.json") as f:
            f.write(body.encode("utf-8"))


def search_engine_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sent in bulks to a stand-in for a search engine."""
    folder = Workspace(spark, "engine").path("bulks")
    rows = _table(spark, sf_dir, "documents").where("content IS NOT NULL").select(F.col("doc_id").cast("string").alias("id"), "content", "meta")
    indexes.write_to_search_engine(rows, lambda: _FileClient(folder), "documents")
    return records.read_jsonl(spark, folder, _schema("id STRING, content STRING"))


def stream_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, indexed as a stream."""
    space, documents = Workspace(spark, "stream"), _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "content")
    source = space.path("in")
    documents.write.parquet(source)
    streams.index_stream(spark.readStream.schema(documents.schema).parquet(source), space.path("out"), space.path("progress"), []).awaitTermination()
    return spark.read.parquet(space.path("out")).select("id", "content")


def run_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run a nation, every second of which is completed: what is found again, with its artifact."""
    root = Workspace(spark, "runs").path("root")
    for n in _table(spark, sf_dir, "nation").collect():  # a fixed table of 25 rows
        run = artifacts.Run(spark, root, artifacts.slugify(n["n_name"])).begin({"key": n["n_nationkey"]})
        if n["n_nationkey"] % 2 == 0:
            run.complete("indexing", {"value": run.put("value.json", n["n_regionkey"])})
    rows = [(name, records.read_json(spark, artifacts.Run(spark, root, name).artifact("value"))) for name in artifacts.discover(spark, root, stage="indexing")]
    return spark.createDataFrame(rows, "name STRING, value INT")


def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents numbered in the order of their keys."""
    return sparse.with_ordinal(_table(spark, sf_dir, "documents").select("id", "doc_id"), "id", "doc_id").select("doc_id", "ordinal")


# Models with known answers


class _Letters:
    """Vectors that SQL can count: characters and letters "e"; queries have a third component."""

    def encode_document(self, texts: list[str]) -> np.ndarray:
        return np.array([[len(t), t.count("e")] for t in texts], np.float32)

    def encode_query(self, texts: list[str]) -> np.ndarray:
        return np.array([[len(t), t.count("e"), 1] for t in texts], np.float32)


def embedded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").where("content IS NOT NULL").select("doc_id", "content")
    return models.embed(rows, _Letters, "document").select("doc_id", F.posexplode("embedding").alias("place", "value"))


def embedded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "queries").where("content IS NOT NULL").select("line_no", "content")
    return models.embed(rows, _Letters, "query").select("line_no", F.posexplode("embedding").alias("place", "value"))


def encoded_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the vectors of an encoder: what isn't 0."""
    rows = models.embed(_table(spark, sf_dir, "documents").where("content IS NOT NULL").select(F.col("doc_id").alias("ordinal"), "content"), _Letters, "document")
    return sparse.postings(rows.select("ordinal", sparse.dense_to_sparse(F.col("embedding")).alias("sparse")))


def _overlap():
    def score(asked: list[str], texts: list[str]) -> list[float]:
        return [len(set(a.lower().split()) & set(t.lower().split())) / max(len(set(a.lower().split())), 1) for a, t in zip(asked, texts, strict=True)]

    return score


def _rerank_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _table(spark, sf_dir, "queries").where("line_no % 20 = 0 AND content IS NOT NULL").select(F.col("line_no").alias("query_id"), "IN", F.col("content").alias("query_content"))
    documents = _table(spark, sf_dir, "documents").where("content IS NOT NULL").select(F.col("id").alias("document_id"), F.col("doc_id").alias("id"), "content")
    return queries.join(_table(spark, sf_dir, "input_mapping").select("IN", "document_id").distinct(), "IN").join(documents, "document_id")


def rerank_cross_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each query's need, scored by a stand-in: the share of the query's words in the document."""
    return models.rerank(_rerank_pairs(spark, sf_dir), _overlap, k=10).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def rerank_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, mapped by the logistic function, above a threshold only."""
    found = models.rerank(_rerank_pairs(spark, sf_dir), _overlap, k=5, scale_score=True, calibration_factor=2.0, score_threshold=0.6)
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def _model() -> ccsa.Autoencoder:
    """A model whose logits are the vector itself: 8 codebooks of 8 dimensions."""
    weights = {"enc_w": np.eye(64), "enc_b": np.zeros(64), "dec_w": np.eye(64) / 2, "dec_b": np.full(64, 0.125)}
    return ccsa.Autoencoder(64, 8, 8, batch_norm=False, weights=weights)


def model_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active dimensions of every vector by a stored model."""
    path = Workspace(spark, "model").path("model")
    ccsa.write_model(spark, _model(), path)
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ordinal"), "embedding")
    return ccsa.encode_sparse(rows, ccsa.read_model(spark, path)).select("ordinal", F.explode("sparse.indices").alias("dim"))


def model_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The losses of that model over the matrix of all vectors (at most 20,000, the bound of a fit)."""
    matrix = ccsa.training_vectors(_table(spark, sf_dir, "embeddings"), limit=20_000)
    found = _model().loss(matrix, balance_weight=0.5)
    return spark.createDataFrame([(len(matrix), matrix.shape[1], *(round(float(found[n]), 6) for n in ("reconstruction_loss", "uniformity_loss", "loss")))], "n BIGINT, dimension INT, reconstruction_loss DOUBLE, uniformity_loss DOUBLE, loss DOUBLE")


def training_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a training breaks what holds for every training."""
    matrix = ccsa.training_vectors(_table(spark, sf_dir, "embeddings"), limit=20_000)
    model, history = ccsa.train(matrix, codebooks=8, size=8, epochs=6, batch_size=64, learning_rate=0.01, balance_weight=0.1)
    codes = model.encode(matrix)
    again, _ = ccsa.train(matrix, codebooks=8, size=8, epochs=6, batch_size=64, learning_rate=0.01, balance_weight=0.1)
    rules = {
        "epoch missing": abs(len(history) - 6), "loss not finite": sum(not np.isfinite(list(h.values())).all() for h in history),
        "reconstruction not better": int(history[-1]["reconstruction_loss"] >= history[0]["reconstruction_loss"]),
        "code outside its codebook": int((codes // 8 != np.arange(8)).sum()), "other codes by the same seed": int((again.encode(matrix) != codes).sum()),
    }
    return spark.createDataFrame(list(rules.items()), "rule STRING, n BIGINT")


def chunk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks of all documents break each rule of chunks."""
    source = _table(spark, sf_dir, "documents").where("content IS NOT NULL").select(F.col("doc_id").cast("string").alias("id"), "content")
    chunks = chunking.chunk_documents(source)
    text = source.select(F.col("id").alias("source_document_id"), F.col("content").alias("whole"))
    joined = text.join(chunks, "source_document_id", "left")
    blank = F.length(F.regexp_replace("whole", r"[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]", "")) == 0
    by_document = joined.groupBy("source_document_id").agg(
        F.count("id").alias("n"), F.max("chunk_count").alias("count"), F.min("chunk_index").alias("low"), F.max("chunk_index").alias("high"), F.count_distinct("chunk_index").alias("places"), F.first(blank).alias("blank")
    )
    whole = by_document.agg(
        F.count_if(F.col("blank") != (F.col("n") == 0)).alias("blank and chunks"),
        F.count_if((F.col("n") > 0) & ((F.col("n") != F.col("count")) | (F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("places") != F.col("n")))).alias("numbers with gaps"),
    )
    each = joined.where("id IS NOT NULL").agg(
        F.count_if(F.length("content") > 360).alias("over the size"),
        F.count_if(F.trim("content") == "").alias("blank chunk"),
        F.count_if(~F.contains("whole", "content")).alias("other than the text"),
        F.count_if(F.col("id") != F.concat("source_document_id", F.lit("::chunk-"), F.col("chunk_index").cast("string"))).alias("other id"),
    )
    rows = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("n")) for c in df.columns])).alias("r")).select("r.*")
    return rows(whole).unionByName(rows(each))


# Stages


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a dense and a sparse index, built, searched and fused by the stages."""
    space, rows = Workspace(spark, "pipeline"), _vectors(spark, sf_dir)
    stages.build_index(spark, rows.drop("sparse"), space.path("dense"), [], "dense")
    stages.build_index(spark, rows.drop("embedding"), space.path("sparse"), [], "sparse")
    asked = rows.where("pos % 20 = 0").select("id", F.col("label").cast("string").alias("IN"), "embedding", "sparse")
    sources = [stages.Source("dense", "dense", space.path("dense"), 20, 1.0, options={"digits": 6}), stages.Source("sparse", "sparse", space.path("sparse"), 20, 0.5, options={"digits": 6})]
    return stages.infer(spark, asked, sources, k=10)


def pipeline_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("query_id", "rank", "id", F.round("score", 8).alias("score"))


def pipeline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the fused predictions, as the evaluation stage stores them."""
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("IN"))
    asked = vectors.where("cast(id AS BIGINT) % 20 = 0")
    judged = vectors.select("IN", F.col("id").alias("document_id"), F.lit(1).alias("label"))
    root = Workspace(spark, "evaluation").path("runs")
    found = Workspace(spark, "evaluation").write(_fused(spark, sf_dir), "predictions")
    stages.evaluate(spark, root, "r1", found, asked, judged, ["Recall@10", "Precision@5", "MRR@10"])
    values = records.read_json(spark, artifacts.Run(spark, root, "r1").artifact("metrics"))
    return spark.createDataFrame([(k, round(v, 6)) for k, v in sorted(values.items())], "metric STRING, value DOUBLE")


def pipeline_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical search of a text index among the stored candidates of each need."""
    space = Workspace(spark, "lexical")
    documents = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("id").alias("source_document_id"), "content")
    stages.build_index(spark, documents, space.path("text"), [], "text")
    asked = _table(spark, sf_dir, "queries").where("line_no % 20 = 0").select(F.col("line_no").cast("string").alias("id"), "content", "IN")
    path = indexes.write_mapping(_table(spark, sf_dir, "input_mapping"), {}, space.path("mapping"))
    found = stages.infer(spark, asked, [stages.Source("words", "lexical", space.path("text"), 10)], indexes.read_mapping(spark, path)[0], k=10)
    return found.select("query_id", "rank", "id", "document_id", "score")


def metrics_shared_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the wordings of needs that have several: each wording is scored apart."""
    tables = [_table(spark, sf_dir, t) for t in ("predictions", "queries", "qrels")]
    found = metrics.query_metrics(*tables, ["NDCG@10", "MRR@10"], by=("run_id",), policy="max", check=False)
    needs = tables[1].groupBy(F.col("id").alias("query_id")).agg(F.min("IN").alias("IN"))
    shared = needs.where("`IN` IS NOT NULL").groupBy("IN").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.join(needs.join(shared, "IN").select("query_id"), "query_id").groupBy("run_id", "metric").agg(F.round(F.avg("value"), 6).alias("value"), F.count(F.lit(1)).alias("n_wordings"))


# References with inherited orphans


def p1_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans along a chain of tables, of which the last holds documents of named fields only: most orphans are inherited."""
    tables = {"wordings": _table(spark, sf_dir, "queries"), "asked": _table(spark, sf_dir, "queries"), "judged": _table(spark, sf_dir, "qrels"), "kept": _table(spark, sf_dir, "documents").where("form = 'fields'")}
    keys = {"wordings": "line_no", "asked": "line_no", "judged": "line_no", "kept": "doc_id"}
    chain = [references.Reference("wordings", "id", "asked", "id"), references.Reference("asked", "IN", "judged", "IN"), references.Reference("judged", "document_id", "kept", "id")]
    return references.orphan_cascade(spark, tables, keys, chain).select("tbl", "field", F.col("row_key").alias("line_no"), "level")


QUERIES = {
    f.__name__: f
    for f in (
        jsonl_roundtrip, strict_records, indexing_input, metadata_roundtrip, json_artifacts, content_digests, predictions_store, query_extra_data,
        benchmark_corpus, benchmark_queries, benchmark_qrels, benchmark_prepared, dense_store, sparse_store, sparse_store_postings, sparse_store_stats,
        mapping_store, prepared_mapping, search_engine_store, stream_store, run_discovery, ordinals, embedded_documents, embedded_queries, encoded_postings,
        rerank_cross_encoder, rerank_scaled, model_codes, model_losses, training_violations, chunk_violations, pipeline_fused, pipeline_metrics, pipeline_lexical,
        metrics_shared_in, p1_inherited,
    )
}
