"""Indexing of a stream of documents, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylight.schemas import require
from quarrylight.session import delete_path
from quarrylight.sources.indexes import exists


def index_stream(stream: DataFrame, path: str, checkpoint: str, steps: list[Callable[[DataFrame], DataFrame]], on_duplicate: str = "error") -> StreamingQuery:
    """Appends each micro-batch of documents (id, content, ...) to Parquet below ``path``, one folder a batch.

    A batch that runs again after a failure replaces its own folder, so each document is
    indexed once. An id that an earlier batch or the same one holds raises, or with
    ``on_duplicate='skip'`` the later row is left out (of equal ids in one batch, one stays).
    Ends when all input that is there is processed.
    """
    if on_duplicate not in ("error", "skip"):
        raise ValueError("on_duplicate must be 'error' or 'skip'")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mine = f"{path}/batch={number}"
        delete_path(spark, mine)
        rows = batch.dropDuplicates(["id"]) if on_duplicate == "skip" else batch
        if on_duplicate == "error" and batch.groupBy("id").count().where("count > 1").limit(1).count():
            raise ValueError("a document id occurs more than once in a batch")
        if exists(spark, path):
            known = spark.read.parquet(path).where(F.col("batch") < number).select("id") if _has_rows(spark, path) else None
            if known is not None:
                if on_duplicate == "skip":
                    rows = rows.join(known, "id", "left_anti")
                elif rows.join(known, "id", "left_semi").limit(1).count():
                    raise ValueError("a document id is in the index already")
        for step in steps:
            rows = step(rows)
        rows.write.mode("overwrite").parquet(mine)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _has_rows(spark, path: str) -> bool:
    from quarrylight.session import _path

    found, fs = _path(spark, path)
    return any("batch=" in s.getPath().getName() for s in fs.listStatus(found))


def event_counts(stream: DataFrame, time: str, key: str, value: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window_start, key, n, total): tumbling windows of a stream, rows later than ``late`` behind left out.

    On a batch table the watermark has no effect and all rows count. Null times are no
    event and raise on reading.
    """
    checked = require(stream, F.col(time).isNotNull(), "an event has no time")
    counted = checked.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), key, "n", "total")
