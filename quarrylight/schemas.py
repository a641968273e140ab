"""Schemas of the data model and strict validation at the dataset boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()
QUERY = _schema(("id", _S, False), ("content", _S, True), ("IN", _S, True), ("meta", _S, True))
DOCUMENT = _schema(("id", _S, False), ("content", _S, True), ("meta", _S, True))
QREL = _schema(("IN", _S, False), ("document_id", _S, False), ("label", _I, False))
RANKED = _schema(("query_id", _S, False), ("source", _S, False), ("rank", _I, False), ("id", _S, True), ("source_document_id", _S, True), ("score", _D, True), ("content", _S, True))
PREDICTION = _schema(("query_id", _S, False), ("rank", _I, False), ("id", _S, False), ("document_id", _S, False), ("score", _D, True), ("data", _S, True))
INPUT_MAPPING = _schema(("IN", _S, False), ("pos", _I, False), ("document_id", _S, False))
SPARSE = T.StructType([T.StructField("indices", T.ArrayType(_I)), T.StructField("values", T.ArrayType(_D))])
POSTING = _schema(("dim", _I, False), ("ordinal", T.LongType(), False), ("weight", _D, False))

#: Fields of each strict record, with those that must not be null or empty.
STRICT = {
    "query": ({"id", "content", "IN", "meta"}, {"id", "content", "IN"}),
    "document": ({"id", "content", "meta"}, {"id", "content"}),
    "qrel": ({"IN", "document_id", "label"}, {"IN", "document_id"}),
}


def record_problem(record: Column, kind: str) -> Column:
    """Why a JSON record isn't a valid one of its kind; null if it is.

    Queries and qrels have exactly their fields, documents at least theirs. Ids and needs are
    non-empty strings, contents are strings, meta is an object, a label is an integer and no
    boolean.
    """
    names, text = STRICT[kind]
    keys = F.json_object_keys(record)
    field = lambda n: F.get_json_object(record, f"$.{n}")
    raw = lambda n: F.regexp_extract(F.to_json(F.from_json(record, "map<string,variant>")), rf'"{n}":(.)', 1)
    problem = F.when(keys.isNull(), F.lit("not an object"))
    for n in sorted(names):
        problem = problem.when(~F.array_contains(keys, n), F.lit(f"missing {n}"))
    if kind != "document":
        problem = problem.when(F.size(F.array_except(keys, F.array(*map(F.lit, sorted(names))))) > 0, F.lit("unexpected field"))
    for n in sorted(text):
        problem = problem.when(raw(n) != '"', F.lit(f"{n} is no string"))
        if n != "content":
            problem = problem.when(F.coalesce(field(n), F.lit("")) == "", F.lit(f"{n} is empty"))
    if kind == "qrel":
        problem = problem.when(~F.coalesce(field("label"), F.lit("")).rlike(r"^-?\d+$") | raw("label").isin('"', "t", "f"), F.lit("label is no integer"))
    else:
        problem = problem.when(raw("meta") != "{", F.lit("meta is no object"))
    return problem


def require(df: DataFrame, ok: Column, message: Column | str) -> DataFrame:
    """``df`` unchanged; reading a row for which ``ok`` isn't true raises with the message."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """(key, n): the keys that occur more than once; nulls count as one key."""
    return df.groupBy(F.col(f"`{key}`").alias(key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def qrel_conflicts(qrels: DataFrame) -> DataFrame:
    """(IN, document_id, n_labels, n_rows): judged pairs with more than one label; repeated equal rows are none."""
    agg = qrels.groupBy("IN", "document_id").agg(F.count_distinct("label").alias("n_labels"), F.count(F.lit(1)).alias("n_rows"))
    return agg.where("n_labels > 1")


def resolve_qrels(qrels: DataFrame, policy: str = "error") -> DataFrame:
    """One (IN, document_id, label) per judged pair.

    Rows with a null need, document or label are no judgments. ``policy`` for pairs of
    several labels: ``error`` raises on reading, ``max`` and ``min`` take that label.
    """
    if policy not in ("error", "max", "min"):
        raise ValueError(f"unknown policy {policy!r}")
    agg = qrels.where("`IN` IS NOT NULL AND document_id IS NOT NULL AND label IS NOT NULL").groupBy("IN", "document_id").agg(F.min("label").alias("_low"), F.max("label").alias("_high"))
    if policy == "error":
        agg = require(agg, F.col("_low") == F.col("_high"), F.concat(F.lit("conflicting labels for "), F.col("IN"), F.lit(" and "), F.col("document_id")))
    return agg.select("IN", "document_id", F.col("_low" if policy == "min" else "_high").alias("label"))
