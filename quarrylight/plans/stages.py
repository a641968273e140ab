"""The four stages: prepare a mapping, index, infer, evaluate. Each is one lazy plan up to its sink."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylight.operators import dense, fusion, lexical, mapping as mappings, metrics as measures, sparse
from quarrylight.sources import artifacts, indexes, predictions as results

Step = Callable[[DataFrame], DataFrame]
#: How ranked lists of several sources are fused.
FUSIONS = {"rrf": fusion.reciprocal_rank_fusion, "sum": fusion.score_fusion, "linear": fusion.linear_score_fusion, "zscore": fusion.zscore_fusion}


def prepare_mapping(spark: SparkSession, root: str, run: str, documents: DataFrame, queries: DataFrame, qrels: DataFrame, recipe: dict, dataset: str = "") -> str:
    """Generates and stores a candidate mapping with its metadata; returns its path. An existing run is refused."""
    path = f"{root}/{artifacts.valid_name(run, 'mapping id')}"
    if indexes.exists(spark, path):
        raise FileExistsError(path)
    made = mappings.generate_mapping(spark, documents, queries, qrels, recipe)
    checked = mappings.parse_recipe(recipe)
    active = mappings.sample_keys(mappings.distinct_in_order(documents.withColumnRenamed("id", "document_id"), "document_id", "pos"), "document_id", checked["document_subset_size"], f"{checked['seed']}d", "documents")
    needs = mappings.sample_keys(mappings.distinct_in_order(queries, "IN", "pos"), "IN", checked["query_subset_size"], f"{checked['seed']}q", "queries")
    stats = mappings.mapping_statistics(made, needs, active).first().asDict()
    return indexes.write_mapping(made, {"dataset": dataset, "recipe_name": recipe.get("name", "generated"), "run_id": run, **checked, **stats}, path)


def build_index(spark: SparkSession, documents: DataFrame | None, path: str, steps: list[Step], kind: str = "dense", **options: Any) -> int:
    """Runs documents (id, content, ...) through the steps and publishes the index; returns what was indexed.

    ``kind``: ``dense`` (an embedding a document), ``sparse`` (a sparse vector) or ``text`` (the
    contents, for lexical search). Without documents (None) an empty set would be indexed, which raises.
    """
    if documents is None:
        raise ValueError("there are no documents to index")
    if documents.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("a document id occurs more than once")
    for step in steps:
        documents = step(documents)
    writers = {"dense": indexes.write_dense_index, "sparse": indexes.write_sparse_index, "text": indexes.write_text_index}
    if kind not in writers:
        raise ValueError(f"unknown index kind {kind!r}")
    return writers[kind](documents, path, **options)


@dataclass(frozen=True)
class Source:
    """One ranked list of an inference: an index, how to search it, and its weight in a fusion.

    ``kind``: ``dense``, ``sparse`` or ``lexical``. ``steps`` give the queries what the search
    needs (``embedding``, ``sparse``), where they don't have it. ``options`` go to the search.
    """

    name: str
    kind: str
    index: str
    k: int = 100
    weight: float = 1.0
    steps: tuple[Step, ...] = ()
    options: dict[str, Any] = field(default_factory=dict)


def _units(documents: DataFrame) -> DataFrame:
    """(id, source_document_id, meta, content): what results carry of their documents, null where there is none."""
    return documents.select("id", *[F.col(c) if c in documents.columns else F.lit(None).cast("string").alias(c) for c in ("source_document_id", "meta", "content")])


def search(spark: SparkSession, source: Source, queries: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """(query_id, source, rank, id, score, source_document_id, meta, content): the ranked list of one source.

    ``mapping`` (IN, pos, document_id) restricts a query to its need's candidates; a null one
    leaves all documents. A query whose need isn't in the mapping has no results.
    """
    for step in source.steps:
        queries = step(queries)
    needed = {"dense": "embedding", "sparse": "sparse", "lexical": "content"}
    if source.kind not in needed:
        raise ValueError(f"unknown kind of search {source.kind!r}")
    if needed[source.kind] not in queries.columns:
        raise ValueError(f"source {source.name!r} needs queries with {needed[source.kind]!r}: give it an encoder")
    asked = queries.select(F.col("id").alias("query_id"), needed[source.kind], "IN")
    candidates = None if mapping is None else asked.join(mapping.select("IN", "document_id"), "IN").select("query_id", "document_id").distinct()
    if source.kind == "dense":
        documents, similarity = indexes.read_dense_index(spark, source.index)
        whole = documents if "source_document_id" in documents.columns else documents.withColumn("source_document_id", F.lit(None).cast("string"))
        if candidates is None:
            found = dense.dense_retrieve(asked, whole, source.k, similarity, **source.options)
        else:
            found = dense.dense_retrieve_candidates(asked, whole, candidates, source.k, similarity, **source.options)
    elif source.kind == "sparse":
        documents, entries, _ = indexes.read_sparse_index(spark, source.index)
        whole = documents if "source_document_id" in documents.columns else documents.withColumn("source_document_id", F.lit(None).cast("string"))
        if candidates is not None:  # the search takes a query without candidates as unrestricted; here it has no results
            asked = asked.join(candidates.select("query_id").distinct(), "query_id", "left_semi")
        found = sparse.sparse_retrieve(asked, entries, whole, source.k, candidates=candidates, **source.options)
    else:
        documents = indexes.read_text_index(spark, source.index)
        if candidates is None:
            found = lexical.bm25_retrieve(asked, documents, source.k, **source.options)
        else:
            owner = F.coalesce(F.nullif(_units(documents)["source_document_id"], F.lit("")), F.col("id"))
            owned = _units(documents).select("id", owner.alias("_owner"))
            units = candidates.join(owned, F.col("document_id") == F.col("_owner")).select("query_id", F.col("id").alias("document_id"))
            found = lexical.bm25_candidates(asked, documents, units, source.k, **source.options)
    return found.select("query_id", F.lit(source.name).alias("source"), "rank", "id", "score").join(_units(documents), "id")


def infer(
    spark: SparkSession, queries: DataFrame, sources: list[Source], mapping: DataFrame | None = None, fuse: str = "rrf", fuse_options: dict[str, Any] | None = None,
    steps: list[Step] | None = None, k: int = 10,
) -> DataFrame:
    """Predictions (query_id, rank, id, document_id, score, data) of queries (id, content, IN) over one index or several.

    Every source gives a ranked list; several are fused by ``fuse`` (``rrf``, ``sum``, ``linear``,
    ``zscore``) with the sources' weights. ``steps`` (reranking, cuts by document, ...) then run
    over rows (query_id, rank, id, score, source_document_id, meta, content), and the ``k`` first
    of each query by rank stay. Names of sources must differ.
    """
    if not sources:
        raise ValueError("inference needs a source")
    if len({s.name for s in sources}) != len(sources):
        raise ValueError("two sources have the same name")
    lists = [search(spark, s, queries, mapping) for s in sources]
    payload = ["source_document_id", "meta", "content"]
    if len(lists) == 1:
        found = lists[0].drop("source")
    else:
        if fuse not in FUSIONS:
            raise ValueError(f"unknown fusion {fuse!r}")
        found = FUSIONS[fuse](reduce(DataFrame.unionByName, lists), {s.name: s.weight for s in sources}, payload=payload, **(fuse_options or {}))
    for step in steps or []:
        found = step(found)
    return results.project_results(found.where(F.col("rank") <= k))


def evaluate(spark: SparkSession, root: str, run: str, predictions: DataFrame, queries: DataFrame, qrels: DataFrame, metrics: list[str], inputs: dict[str, str] | None = None, **options: Any) -> dict[str, float]:
    """Metrics of predictions, written with the run's description to its folder, which must not exist."""
    made = artifacts.Run(spark, root, run).begin({"stage": "evaluation", "metrics": metrics, **options})
    found = {r["metric"]: r["value"] for r in measures.evaluate(spark, predictions, queries, qrels, metrics, **options).collect()}  # one row a metric
    made.complete("evaluation", {"metrics": made.put("metrics.json", found)}, inputs)
    return found
