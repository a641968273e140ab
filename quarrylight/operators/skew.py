"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Rows that one key may have in one task. Keys of more rows are heavy.
HEAVY_ROWS = 1_000_000
#: Heavy keys at most: the limit rises with the rows so that no more can exist, which bounds
#: what is broadcast or comes to the driver. It takes 10 ** 11 rows until the limit rises.
MOST_HEAVY = 100_000
#: Up to so many rows a side is joined plainly: even a third of them is little for one task.
PLAIN_ROWS = 2_000_000


def heavy_limit(rows: int, heavy_rows: int | None = None) -> int:
    """Keys of more rows than this are heavy: at most ``MOST_HEAVY`` keys of ``rows`` rows can be."""
    return max(HEAVY_ROWS if heavy_rows is None else heavy_rows, rows // MOST_HEAVY)


def join_unique_skewed(
    left: DataFrame, right: DataFrame, key: str, weight: Column, how: str = "inner", left_rows: int | None = None, heavy_rows: int | None = None, plain_rows: int | None = None
) -> DataFrame:
    """Joins ``left`` to ``right``, which has one row per ``key``, when keys of ``left`` are skewed.

    ``weight`` is an expression over ``right`` that says how many rows of ``left`` a key has.
    Keys above :func:`heavy_limit` are joined by broadcast, all others by a shuffle in which
    none of them is large. No row is dropped: both parts together are the whole join.
    ``right`` is used several times and should be a written table. ``how``: ``inner`` or
    ``left``. Null keys match nothing; with ``left`` their rows stay. ``left_rows``: the
    number of rows of ``left`` where the caller knows it, else the weights are added up; few
    rows take one plain join, with the same result.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    rows = left_rows if left_rows is not None else right.agg(F.sum(weight)).first()[0] or 0
    if rows <= (PLAIN_ROWS if plain_rows is None else plain_rows):
        return left.join(right, key, how)
    heavy = right.where(weight > heavy_limit(rows, heavy_rows))
    marks = F.broadcast(heavy.select(F.col(key).alias("_heavy_key")))
    marked = left.join(marks, left[key] == F.col("_heavy_key"), "left")
    hot = marked.where(F.col("_heavy_key").isNotNull()).drop("_heavy_key").join(F.broadcast(heavy), key)
    rest = marked.where(F.col("_heavy_key").isNull()).drop("_heavy_key").join(right, key, how)
    return hot.unionByName(rest)


def heavy_keys_of(df: DataFrame, key: str, heavy_rows: int | None = None) -> DataFrame | None:
    """(key, salts) of the keys above :func:`heavy_limit`, None if there is none; one aggregation.

    A key gets a salt for every ``HEAVY_ROWS`` of its rows. At most ``MOST_HEAVY`` rows come
    to the driver.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    size = HEAVY_ROWS if heavy_rows is None else heavy_rows
    found = counts.where(F.col("n") > size)
    total = found.agg(F.sum("n")).first()[0]
    if not total:
        return None
    rows = [(r[0], -(-r["n"] // size)) for r in found.where(F.col("n") > heavy_limit(total, heavy_rows)).collect()]
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("salts", T.IntegerType(), False)])
    return df.sparkSession.createDataFrame(rows, schema)


def salted(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame | None, spread: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``_salt`` to join on beside ``key``, whatever the kind of join.

    Rows of ``left`` with a heavy key get one of its salts by the hash of ``spread``; rows of
    ``right`` with such a key are repeated for every salt. All others have salt 0. So each
    row of ``left`` meets exactly the rows of ``right`` that it would meet without.
    """
    if heavy is None:
        return left.withColumn("_salt", F.lit(0)), right.withColumn("_salt", F.lit(0))
    hot = F.broadcast(heavy.select(F.col(key).alias("_hot"), F.col("salts").alias("_salts")))
    marked = lambda df: df.join(hot, df[key] == F.col("_hot"), "left")
    salts = F.coalesce("_salts", F.lit(1))
    a = marked(left).withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("_hot", "_salts")
    return a, marked(right).withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_hot", "_salts")
