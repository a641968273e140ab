"""Copies hidden by formatting: an incremental ledger of canonical keys with their counts."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quarrylight.llm.canonical import canonical_key
from quarrylight.operators.skew import join_unique_skewed
from quarrylight.session import Workspace, delete_path, list_names, read_text, write_text_atomic

#: ``kept_key`` is the smallest row key, ``first_key`` the one that arrived first (at ``first_at``, seconds; null counts as earliest).
LEDGER = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("tbl", T.StringType()),
    T.StructField("copies", T.LongType()),
    T.StructField("kept_key", T.LongType()),
    T.StructField("first_at", T.DoubleType()),
    T.StructField("first_key", T.LongType()),
])
#: Ledger rows of one bucket; there are as many buckets, a power of two, as this takes.
BUCKET_ROWS = 1_000_000
LEAST_BUCKETS = 16
#: Batches are merged into the buckets when they hold this share of the buckets' rows.
MERGE_SHARE = 0.25


def _added_up(df: DataFrame, copies=None) -> DataFrame:
    """One row a key of rows with the ledger's columns."""
    first = F.min(F.struct(F.col("first_at"), F.col("first_key")))  # nulls first
    summed = df.groupBy("key").agg(F.min("tbl").alias("tbl"), F.sum("copies").alias("copies"), F.min("kept_key").alias("kept_key"), first.alias("_f"))
    return summed.select("key", "tbl", "copies", "kept_key", F.col("_f.first_at").alias("first_at"), F.col("_f.first_key").alias("first_key"))


def _joined(old: DataFrame, new: DataFrame) -> DataFrame:
    """The full outer join of two tables with one row a key: counts added up, the earlier representative kept."""
    a, b = old.alias("a"), new.alias("b")
    side = lambda x: F.when(F.col(f"{x}.key").isNotNull(), F.struct(F.col(f"{x}.first_at").isNotNull().alias("dated"), F.col(f"{x}.first_at").alias("at"), F.col(f"{x}.first_key").alias("row")))
    first = F.least(side("a"), side("b"))  # of the two that are there
    return a.join(b, F.col("a.key") == F.col("b.key"), "full_outer").select(
        F.coalesce("a.key", "b.key").alias("key"),
        F.coalesce("a.tbl", "b.tbl").alias("tbl"),
        (F.coalesce("a.copies", F.lit(0)) + F.coalesce("b.copies", F.lit(0))).alias("copies"),
        F.least("a.kept_key", "b.kept_key").alias("kept_key"),
        first["at"].alias("first_at"),
        first["row"].alias("first_key"),
    )


class CopyLedger:
    """Counts per canonical key, kept in buckets of the key, batch after batch.

    ``apply`` aggregates a batch by key and writes that, which costs what the batch costs.
    When the batches since the last merge hold ``merge_share`` of the ledger's rows, they are
    full-outer-joined with the buckets they touch, counts added up and the earliest
    representative kept; so a row is rewritten only as often as the ledger grows by that
    share. The number of buckets follows the rows. ``rows`` joins what isn't merged yet.

    Every version is published by a manifest of its own, written last: a job that dies leaves
    the former version, and no file of it is changed. The newest complete manifest counts. A
    folder with parts but no manifest raises instead of starting empty. A batch id that was
    applied before changes nothing, so a batch can be sent again. ``vacuum`` removes what only
    versions before the last two need.
    """

    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = BUCKET_ROWS, least_buckets: int = LEAST_BUCKETS, merge_share: float = MERGE_SHARE):
        self.spark, self.path = spark, path.rstrip("/")
        self.bucket_rows, self.least_buckets, self.merge_share = bucket_rows, least_buckets, merge_share
        names = list_names(spark, self.path)
        manifests = self._manifests(names)
        if not manifests and any(n.startswith(("batch-", "merged-")) for n in names):
            raise ValueError(f"{path} has parts of a ledger but no manifest")
        self.state = json.loads(read_text(spark, f"{self.path}/{manifests[-1]}")) if manifests else {"version": 0, "buckets": least_buckets, "rows": 0, "merged": {}, "fresh": [], "batches": []}

    @staticmethod
    def _manifests(names: list[str]) -> list[str]:
        return [n for n in names if n.startswith("manifest-") and n.endswith(".json")]

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], LEDGER)

    def _merged(self, buckets: list[int] | None = None) -> DataFrame:
        parts: dict[str, list[int]] = {}
        for b, part in self.state["merged"].items():
            if buckets is None or int(b) in buckets:
                parts.setdefault(part, []).append(int(b))
        schema = T.StructType([*LEDGER.fields, T.StructField("bucket", T.IntegerType())])
        reads = [self.spark.read.schema(schema).parquet(f"{self.path}/{part}").where(F.col("bucket").isin(mine)).drop("bucket") for part, mine in sorted(parts.items())]
        return reduce(DataFrame.unionByName, reads) if reads else self._empty()

    def _fresh(self) -> DataFrame:
        parts = [f"{self.path}/{p['part']}" for p in self.state["fresh"]]
        if not parts:
            return self._empty()
        found = self.spark.read.schema(LEDGER).parquet(*parts)
        return found if len(parts) == 1 else _added_up(found)

    def rows(self) -> DataFrame:
        """One row per canonical key, by the columns of ``LEDGER``."""
        if not self.state["fresh"]:
            return self._merged()
        return _joined(self._merged(), self._fresh()) if self.state["merged"] else self._fresh()

    def _publish(self, **changes) -> None:
        state = self.state | changes | {"version": self.state["version"] + 1}
        write_text_atomic(self.spark, f"{self.path}/manifest-{state['version']:09d}.json", json.dumps(state))
        self.state = state

    def apply(self, batch: DataFrame, batch_id: str) -> bool:
        """Adds a batch of (tbl, row_key, key, at); false if it was added before. Null keys are left out."""
        if batch_id in self.state["batches"]:
            return False
        each = batch.where("key IS NOT NULL").select("key", "tbl", F.lit(1).cast("long").alias("copies"), F.col("row_key").alias("kept_key"), F.col("at").cast("double").alias("first_at"), F.col("row_key").alias("first_key"))
        part = f"batch-{self.state['version'] + 1:09d}"
        _added_up(each).write.mode("overwrite").parquet(f"{self.path}/{part}")
        n = self.spark.read.schema(LEDGER).parquet(f"{self.path}/{part}").count()
        self._publish(fresh=[*self.state["fresh"], {"part": part, "rows": n}], batches=[*self.state["batches"], batch_id])
        if sum(p["rows"] for p in self.state["fresh"]) >= self.merge_share * self.state["rows"]:
            self.merge()
        return True

    def merge(self) -> None:
        """Joins the batches since the last merge with the buckets they touch."""
        if not self.state["fresh"]:
            return
        fresh = self._fresh()
        most = self.state["rows"] + sum(p["rows"] for p in self.state["fresh"])
        buckets = max(self.state["buckets"], self.least_buckets)
        while buckets * self.bucket_rows < most:
            buckets *= 2
        bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
        part, merged = f"merged-{self.state['version'] + 1:09d}", {}
        if buckets == self.state["buckets"]:
            touched = [r[0] for r in fresh.select(bucket.alias("b")).distinct().collect()]  # at most a row a bucket
            merged = {b: p for b, p in self.state["merged"].items() if int(b) not in touched}
            old = self._merged(touched)
        else:  # every bucket is cut in two
            old = self._merged()
        both = _joined(old, fresh) if self.state["merged"] else fresh
        placed = both.withColumn("bucket", bucket)
        placed.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{part}")
        sizes = {r["bucket"]: r["count"] for r in self.spark.read.parquet(f"{self.path}/{part}").groupBy("bucket").count().collect()} if most else {}
        kept = self._merged([int(b) for b in merged]).count() if merged else 0
        self._publish(buckets=buckets, rows=kept + sum(sizes.values()), merged=merged | {str(b): part for b in sizes}, fresh=[])

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes manifests before the last ``keep`` and parts that none of those names; returns their names."""
        names = list_names(self.spark, self.path)
        manifests = self._manifests(names)
        needed = set(manifests[-keep:])
        for m in manifests[-keep:]:
            state = json.loads(read_text(self.spark, f"{self.path}/{m}"))
            needed |= {*state["merged"].values(), *(p["part"] for p in state["fresh"])}
        gone = [n for n in names if n.startswith(("manifest-", "batch-", "merged-")) and n not in needed]
        for n in gone:
            delete_path(self.spark, f"{self.path}/{n}")
        return gone


def find_copies(spark: SparkSession, sources: list[tuple[str, DataFrame, str, str]], batches: int = 3, **options) -> tuple[DataFrame, DataFrame]:
    """Runs whole tables through a ledger; returns its rows and the copies with what they are copies of.

    ``sources``: (table name, DataFrame, unique BIGINT column, time column). The tables are
    read once, their keys written, and applied in ``batches`` batches of equal spans of
    arrival time (null times first), as a feed would bring them. The ledger's final counts
    don't depend on the batches. The second result has one row (tbl, kept_key, copy_key)
    per row that isn't its key's smallest; equal keys of one row key count once per row.
    ``options`` are the ledger's.
    """
    space = Workspace(spark, "copies")
    parts = []
    for tbl, df, row_key, time in sources:
        at = df[f"`{time}`"].cast("timestamp").cast("double")
        low, high = df.agg(F.min(at), F.max(at)).first()
        low, span = low or 0.0, max((high or 0.0) - (low or 0.0), 1.0)
        text, kind = df["content"], F.coalesce(df["form"], F.lit(""))
        number = F.coalesce(F.least(F.floor((at - F.lit(low)) / F.lit(span) * batches), F.lit(batches - 1)), F.lit(0)).cast("int")
        key = canonical_key(text, kind, F.lit(tbl))
        parts.append(
            df.where(text.rlike(r"[\p{L}\p{N}]") & df[f"`{row_key}`"].isNotNull()).select(F.lit(tbl).alias("tbl"), df[f"`{row_key}`"].cast("long").alias("row_key"), key.alias("key"), at.alias("at"), number.alias("batch"))
        )
    rows = space.write(reduce(DataFrame.unionByName, parts), "keys", "batch")
    ledger = CopyLedger(spark, space.path("ledger"), **options)
    for k in range(batches):
        ledger.apply(rows.where(F.col("batch") == k), f"span-{k}")
    ledger.vacuum(keep=1)
    several = ledger.rows().where("copies > 1").select("key", "copies", "kept_key")
    found = join_unique_skewed(rows.select("tbl", "row_key", "key"), several, "key", F.col("copies"))
    copies = found.where("row_key <> kept_key").select("tbl", "kept_key", F.col("row_key").alias("copy_key"))
    return ledger.rows(), copies
