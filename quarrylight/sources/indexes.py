"""Stores of dense and sparse indexes and of candidate mappings, published as whole folders.

A store is written beside its place and renamed when it is complete; a failure publishes
nothing. ``index.json`` says what it is. An existing store is refused unless overwriting
is asked for.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylight.operators.dense import SIMILARITIES
from quarrylight.operators.sparse import postings, with_ordinal
from quarrylight.schemas import duplicate_ids, require
from quarrylight.session import Workspace, delete_path, read_text, replace_path, restore_path, write_text_atomic


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path; a version that a dead process had set aside is put back."""
    return restore_path(spark, path.rstrip("/"))


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], head: dict, overwrite: bool = False) -> str:
    """Writes tables and head beside ``path`` and puts the folder there.

    A failure leaves nothing of the new store and all of the former one: that is set aside,
    put back if the renaming fails, and removed last (see :func:`quarrylight.session.replace_path`).
    """
    if exists(spark, path) and not overwrite:
        raise FileExistsError(path)
    part = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    try:
        for name, df in tables.items():
            df.write.parquet(f"{part}/{name}")
        write_text_atomic(spark, f"{part}/index.json", json.dumps(head, indent=2, ensure_ascii=False) + "\n")
        if exists(spark, path) and not overwrite:
            raise FileExistsError(path)
        replace_path(spark, part, path.rstrip("/"))
    finally:
        delete_path(spark, part)
    return path


def head_of(spark: SparkSession, path: str, kind: str) -> dict:
    """The head of a store; raises where there is none or it is of another kind."""
    text = read_text(spark, f"{path}/index.json") if exists(spark, path) else None
    if text is None:
        raise FileNotFoundError(f"no index at {path}")
    head = json.loads(text)
    if not isinstance(head, dict) or head.get("kind") != kind:
        raise ValueError(f"{path} is no {kind}")
    return head


def write_dense_index(documents: DataFrame, path: str, similarity: str = "cosine", overwrite: bool = False) -> int:
    """Stores documents with embeddings and the similarity they are for; returns their number.

    A repeated id raises at once, a missing embedding while writing; then nothing is published.
    """
    if similarity not in SIMILARITIES:
        raise ValueError(f"unknown similarity {similarity!r}")
    spark = documents.sparkSession
    if duplicate_ids(documents, "id").limit(1).count():
        raise ValueError("a document id occurs more than once")
    checked = require(documents, F.col("embedding").isNotNull(), "a document has no embedding")
    publish(spark, path, {"documents": checked}, {"kind": "dense-index", "similarity": similarity}, overwrite)
    return spark.read.parquet(f"{path}/documents").count()


def read_dense_index(spark: SparkSession, path: str, embeddings: bool = True) -> tuple[DataFrame, str]:
    """(documents, similarity) of a dense index; without ``embeddings`` they aren't read."""
    head = head_of(spark, path, "dense-index")
    documents = spark.read.parquet(f"{path}/documents")
    return documents if embeddings else documents.drop("embedding"), head["similarity"]


def write_text_index(documents: DataFrame, path: str, overwrite: bool = False) -> int:
    """Stores documents (id, content, ...) for lexical search; returns their number. A repeated id raises."""
    spark = documents.sparkSession
    if duplicate_ids(documents, "id").limit(1).count():
        raise ValueError("a document id occurs more than once")
    publish(spark, path, {"documents": documents}, {"kind": "text-index"}, overwrite)
    return spark.read.parquet(f"{path}/documents").count()


def read_text_index(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a text index."""
    head_of(spark, path, "text-index")
    return spark.read.parquet(f"{path}/documents")


def write_sparse_index(documents: DataFrame, path: str, dimension: int | None = None, append: bool = False, overwrite: bool = False, keep_dense: bool = False) -> int:
    """Stores documents (id, sparse, pos, ...) as documents, postings and statistics; returns how many this call added.

    Ordinals follow ``pos`` and go on over appended batches; an id that is there already
    raises, and so does an index beyond ``dimension``. An index is a list of segments. A batch
    is written as a segment of its own, its postings clustered by dimension, and then named in
    ``index.json``; what is there is only read for its ids, so appending costs what the batch
    costs. A failure before that leaves the index as it was. :func:`merge_segments` makes one
    segment of many.
    """
    spark = documents.sparkSession
    if duplicate_ids(documents, "id").limit(1).count():
        raise ValueError("a document id occurs more than once")
    head = {"kind": "sparse-index", "segments": []}
    if append:
        head = head_of(spark, path, "sparse-index")
        dimension = head["dimension"] if dimension is None else dimension
        if _segments(spark, path, head, "documents").select("id").join(documents.select("id"), "id", "left_semi").limit(1).count():
            raise ValueError("a document id is in the index already")
    start = head["statistics"]["document_count"] if append else 0
    space = Workspace(spark, "segment")
    numbered = space.write(with_ordinal(documents, "pos", "id", start=start), "numbered")
    entries = postings(numbered, dimension)
    dims = space.write(entries.groupBy("dim").agg(F.count(F.lit(1)).alias("n")), "dims")
    added = numbered.count()
    known = [dims] if not append else [dims, _segments(spark, path, head, "dims")]
    name = f"segment-{start:012d}-{uuid.uuid4().hex[:8]}"
    head |= {"dimension": dimension, "segments": [*head["segments"], name], "statistics": _statistics(reduce(DataFrame.unionByName, known), dimension, start + added)}
    stored = numbered.drop("pos", *([] if keep_dense else ["embedding"]))
    tables = {"documents": stored, "postings": entries.repartitionByRange("dim").sortWithinPartitions("dim", "ordinal"), "dims": dims}
    if append:
        for table, df in tables.items():
            df.write.parquet(f"{path}/{name}/{table}")
        write_text_atomic(spark, f"{path}/index.json", json.dumps(head, indent=2, ensure_ascii=False) + "\n")
    else:
        publish(spark, path, {f"{name}/{k}": v for k, v in tables.items()}, head, overwrite)
    space.clear()
    return added


def _segments(spark: SparkSession, path: str, head: dict, table: str) -> DataFrame:
    return spark.read.option("mergeSchema", len(head["segments"]) > 1 and table == "documents").parquet(*[f"{path}/{s}/{table}" for s in head["segments"]])


def _statistics(dims: DataFrame, dimension: int | None, n_documents: int) -> dict:
    """Statistics from the segments' counts by dimension, without a look at postings."""
    sums = dims.agg(F.max("dim"), F.countDistinct("dim"), F.sum("n")).first()
    top = dimension if dimension is not None else (sums[0] + 1 if sums[0] is not None else 0)
    return {"document_count": n_documents, "sparse_dimension": top, "active_dimension_count": sums[1], "posting_count": sums[2] or 0}


def merge_segments(spark: SparkSession, path: str) -> None:
    """Makes one segment of all; the former index stays until the new one is complete."""
    head = head_of(spark, path, "sparse-index")
    name = f"segment-{0:012d}-{uuid.uuid4().hex[:8]}"
    tables = {t: _segments(spark, path, head, t) for t in ("documents", "postings", "dims")}
    tables["postings"] = tables["postings"].repartitionByRange("dim").sortWithinPartitions("dim", "ordinal")
    tables["dims"] = tables["dims"].groupBy("dim").agg(F.sum("n").alias("n"))
    publish(spark, path, {f"{name}/{k}": v for k, v in tables.items()}, head | {"segments": [name]}, overwrite=True)


def read_sparse_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(documents, postings, statistics) of a sparse index; posting ordinals outside its documents raise on reading."""
    head = head_of(spark, path, "sparse-index")
    n = head["statistics"]["document_count"]
    checked = require(_segments(spark, path, head, "postings"), (F.col("ordinal") >= 0) & (F.col("ordinal") < n), "a posting's ordinal has no document")
    return _segments(spark, path, head, "documents"), checked, head["statistics"]


def write_mapping(mapping: DataFrame, metadata: dict, path: str) -> str:
    """Stores a candidate mapping with its metadata; an existing one is refused."""
    return publish(mapping.sparkSession, path, {"mapping": mapping}, {"kind": "input-mapping", **metadata})


def read_mapping(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(mapping, metadata) of a stored candidate mapping."""
    head = head_of(spark, path, "input-mapping")
    return spark.read.parquet(f"{path}/mapping"), head


def write_to_search_engine(documents: DataFrame, connect, index_name: str, content: str = "content", meta: str = "meta", refresh: bool = False, batch: int = 500) -> None:
    """Sends all documents to a search engine, partition by partition in bulks, through an injected client.

    ``connect`` makes a client with ``bulk(index, documents, refresh)``, documents being (id,
    body) pairs, at most ``batch`` at a time; it runs once per partition. Ids name the entries,
    so a repeated task writes the same.
    """
    columns = [c for c in ("id", content, meta, "embedding") if c in documents.columns]

    def body(row) -> tuple[str, dict]:
        out = {content: row[content], meta: json.loads(row[meta]) if meta in columns and row[meta] else {}}
        if "embedding" in columns and row["embedding"] is not None:
            out["embedding"] = list(row["embedding"])
        return row["id"], out

    def send(rows) -> None:
        client, rows = connect(), iter(rows)
        while bulk := [body(r) for r in islice(rows, batch)]:
            client.bulk(index=index_name, documents=bulk, refresh=refresh)

    documents.select(*columns).foreachPartition(send)
