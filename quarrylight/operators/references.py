"""References to records that do not exist, found directly and by inheritance.

A :class:`Reference` says that a column of a child table names rows of a parent table,
optionally that the parent has to be present at the child's time. ``orphan_cascade`` finds
the rows whose reference has no counterpart (direct, level 0) and then, round by round,
those whose counterparts are all orphans themselves (inherited, level 1 and up), by
semi-joins down the graph of references until a round finds nothing new. Only the keys
that a round touched are looked at in the next one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from quarrylight.operators.skew import heavy_keys_of, salted
from quarrylight.session import Workspace

FOREVER = "9999-12-31 00:00:00"
ORPHANS = T.StructType([
    T.StructField("tbl", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("row_key", T.LongType()),
    T.StructField("parent", T.StringType()),
    T.StructField("level", T.IntegerType()),
])


@dataclass(frozen=True)
class Reference:
    """``child.field`` names rows of ``parent`` by ``parent_field``.

    ``child_time``: column of the child at whose time the parent has to be present; a null
    time asks for a parent at any time. ``present_from`` and ``present_until``: columns of
    the parent that bound its presence, from inclusive, until exclusive, a null until is
    open. A parent whose ``present_from`` is null counts at null times only.
    """

    child: str
    field: str
    parent: str
    parent_field: str
    child_time: str | None = None
    present_from: str | None = None
    present_until: str | None = None

    def __post_init__(self) -> None:
        if (self.child_time is None) != (self.present_from is None):
            raise ValueError("child_time and present_from go together")
        if self.present_until and not self.present_from:
            raise ValueError("present_until needs present_from")


def _presence(parents: DataFrame, salts: int) -> DataFrame:
    """(key, _from, _until) rows of parents -> disjoint periods per key, with the key's row count.

    Islands are merged twice: within salted parts of a key first, which shrinks a key that
    holds a large share of the rows to its few disjoint periods, then over the parts.
    """

    def merge(df: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("_from", "_until")
        reach = F.max("_until").over(w.rowsBetween(Window.unboundedPreceding, -1))
        starts = df.withColumn("_new", F.when(reach.isNull() | (F.col("_from") > reach), 1).otherwise(0))
        islands = starts.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return islands.groupBy(*by, "_island").agg(F.min("_from").alias("_from"), F.max("_until").alias("_until")).drop("_island")

    periods = parents.where("_from IS NOT NULL AND _until > _from").groupBy("_key", "_until").agg(F.min("_from").alias("_from"))
    salted = periods.withColumn("_salt", F.pmod(F.xxhash64("_until"), F.lit(salts)))
    return merge(merge(salted, "_key", "_salt").drop("_salt"), "_key")


def _unmatched(reference: Reference, children: DataFrame, parents: DataFrame, salts: int) -> DataFrame:
    """The child rows (``row_key``, ``_key``, ``_time``) that no parent row answers; hot keys are salted."""
    heavy = heavy_keys_of(children, "_key")

    def without(left: DataFrame, right: DataFrame, *conditions: Column) -> DataFrame:
        a, b = salted(left, right, "_key", heavy, F.col("row_key"))
        b = b.withColumnsRenamed({"_key": "_parent_key", "_salt": "_parent_salt"})
        met = (F.col("_key") == F.col("_parent_key")) & (F.col("_salt") == F.col("_parent_salt"))
        for c in conditions:
            met &= c
        return a.join(b, met, "left_anti").select(*left.columns)

    known = parents.select("_key").distinct()
    if reference.child_time is None:
        return without(children, known)
    untimed = without(children.where("_time IS NULL"), known)
    timed = children.where("_time IS NOT NULL")
    if reference.present_until is None:
        first = parents.where("_from IS NOT NULL").groupBy("_key").agg(F.min("_from").alias("_from"))
        found = without(timed, first, F.col("_from") <= F.col("_time"))
    else:
        found = without(timed, _presence(parents, salts), F.col("_from") <= F.col("_time"), F.col("_time") < F.col("_until"))
    return found.unionByName(untimed)


def orphan_cascade(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    row_keys: dict[str, str],
    references: list[Reference],
    max_rounds: int = 1000,
    salts: int = 32,
) -> DataFrame:
    """All broken references of ``tables`` as (tbl, field, row_key, parent, level).

    ``row_keys`` names each table's unique BIGINT column. ``level`` is 0 for a reference
    without any counterpart and k for one whose last counterparts became orphans in round
    k - 1. A row is an orphan as soon as one of its fields is; it then no longer counts as
    a counterpart. Keys compare exactly; a null key is no reference; an empty string is a
    key like any other. An empty parent table makes every reference direct. Repeated rows
    count once each by their row key; child rows without one are left out, parent rows without
    one count as counterparts for good. Other columns are ignored, whatever they are called.
    Raises if the cascade needs more than ``max_rounds`` rounds, never returns part of it.

    Cost: one pass over the keys for level 0. Later rounds semi-join only the keys that
    lost a parent. Nothing is collected but the number of rows a round found.
    """
    for r in references:
        for name in (r.child, r.parent):
            if name not in tables or name not in row_keys:
                raise ValueError(f"unknown table {name!r}")
    if len({(r.child, r.field) for r in references}) != len(references):
        raise ValueError("a field has more than one reference")
    space = Workspace(spark, "orphans")

    def column(df: DataFrame, name: str) -> Column:
        return df["`" + name.replace("`", "``") + "`"]

    def children(r: Reference) -> DataFrame:
        df = tables[r.child]
        time = column(df, r.child_time) if r.child_time else F.lit(None).cast("timestamp")
        found = df.select(column(df, row_keys[r.child]).cast("long").alias("row_key"), column(df, r.field).cast("string").alias("_key"), time.alias("_time"))
        return found.where("_key IS NOT NULL AND row_key IS NOT NULL")

    def parents(r: Reference) -> DataFrame:
        df = tables[r.parent]
        kind = df.schema[r.present_from].dataType.simpleString() if r.present_from else "timestamp"
        start = column(df, r.present_from) if r.present_from else F.lit(None).cast(kind)
        end = F.coalesce(column(df, r.present_until).cast(kind), F.lit(FOREVER).cast(kind)) if r.present_until else F.lit(FOREVER).cast(kind)
        found = df.select(column(df, row_keys[r.parent]).cast("long").alias("_parent_row"), column(df, r.parent_field).cast("string").alias("_key"), start.alias("_from"), end.alias("_until"))
        return found.where("_key IS NOT NULL")

    def label(df: DataFrame, r: Reference, level: int) -> DataFrame:
        return df.select(F.lit(r.child).alias("tbl"), F.lit(r.field).alias("field"), "row_key", F.lit(r.parent).alias("parent"), F.lit(level).cast("int").alias("level"))

    def union(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], ORPHANS)

    rounds = [space.write(union([label(_unmatched(r, children(r), parents(r), salts), r, 0) for r in references]), "level-0")]
    while True:
        last, level = rounds[-1], len(rounds)
        fresh = {row["tbl"] for row in last.select("tbl").distinct().collect()}  # at most one row a table
        if not fresh:
            break
        if level > max_rounds:
            raise ValueError(f"the cascade did not end within {max_rounds} rounds")
        known = union(rounds)
        parts = []
        for r in references:
            if r.parent not in fresh:
                continue
            gone = known.where(F.col("tbl") == r.parent).select(F.col("row_key").alias("_parent_row")).distinct()
            lost = last.where(F.col("tbl") == r.parent).select(F.col("row_key").alias("_parent_row")).distinct()
            touched = parents(r).join(lost, "_parent_row", "left_semi").select("_key").distinct()
            left = parents(r).join(touched, "_key", "left_semi").join(gone, "_parent_row", "left_anti")
            asked = children(r).join(touched, "_key", "left_semi")
            listed = known.where((F.col("tbl") == r.child) & (F.col("field") == r.field)).select("row_key")
            parts.append(label(_unmatched(r, asked, left, salts).join(listed, "row_key", "left_anti"), r, level))
        rounds.append(space.write(union(parts), f"level-{level}"))
    return union(rounds)


def orphan_report(orphans: DataFrame, tables: dict[str, DataFrame], row_keys: dict[str, str], periods: dict[str, str]) -> DataFrame:
    """Counts of direct and inherited orphans by (tbl, field, month).

    ``periods`` names each table's time column; month is its first day, null where the time
    is null. Tables and fields without orphans have no rows.
    """
    times = [
        df.select(F.lit(name).alias("tbl"), df[f"`{row_keys[name]}`"].cast("long").alias("row_key"), F.trunc(df[f"`{periods[name]}`"], "month").alias("month"))
        for name, df in tables.items()
        if name in periods
    ]
    dated = orphans.join(reduce(DataFrame.unionByName, times), ["tbl", "row_key"], "left")
    return dated.groupBy("tbl", "field", "month").agg(
        F.count_if(F.col("level") == 0).alias("direct"),
        F.count_if(F.col("level") > 0).alias("inherited"),
    )
