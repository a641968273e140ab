"""Connected components by alternating large-star and small-star, and splits that keep them whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarrylight.operators.skew import join_unique_skewed
from quarrylight.operators.sparse import with_ordinal
from quarrylight.session import Workspace


def _towards_minimum(edges: DataFrame, n_edges: int) -> DataFrame:
    """(u, v) -> (u, v, least, n): the least neighbour of each u, by aggregation and a skew-safe join."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("n"))
    return join_unique_skewed(edges, least, "u", F.col("n"), left_rows=n_edges)


def star_components(spark: SparkSession, edges: DataFrame, max_rounds: int = 100, space: Workspace | None = None) -> DataFrame:
    """(node, component) of an undirected graph of edges (u, v); component is its least node.

    Nodes are of any ordered type; edges with a null end and loops are left out, so a node
    without an edge to another has no row. Large-star links every larger neighbour of a node
    to the node's least neighbour, small-star every smaller one; both keep connectivity, and
    when neither changes anything the graph is a set of stars. Neighbourhoods are never
    gathered: the least neighbour is an aggregate, joined back with the heaviest nodes apart.
    Every round is written to the shared folder, or to the workspace of the caller, who may
    clear it when the result is read. Raises if ``max_rounds`` don't suffice.
    """
    space = space or Workspace(spark, "stars")
    u, v = F.col("u"), F.col("v")
    current = space.write(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "round-0")
    state = (current.count(), None)
    for k in range(1, max_rounds + 1):
        both = current.union(current.select("v", "u"))
        large = _towards_minimum(both, 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).where("u <> v").distinct()
        pulled = _towards_minimum(large.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")), 2 * state[0])
        small = pulled.select("v", "least").where("v <> least").union(pulled.select("u", "least")).toDF("u", "v").distinct()
        current = space.write(small, f"round-{k}")
        now = tuple(current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if k > 1:
            space.drop(f"round-{k - 2}")
        if now == state:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select("v", "v").distinct())
        state = now
    raise ValueError(f"no fixpoint within {max_rounds} rounds")


def related_groups(spark: SparkSession, df: DataFrame, row_key: str, strong: str, weak: str) -> DataFrame:
    """(row_key, component, group_in, n_rows) of every row; rows that share an entity are in one component.

    ``strong`` is compared without letter case and surrounding white space, ``weak``
    exactly; a null is no entity, a row with neither is alone. Entities are the nodes, a row
    links its two. Names of ``strong`` entities come before those of ``weak`` ones, so a
    component's least node is its smallest ``strong`` value where it has any: that value is
    ``group_in``, else null. Repeated rows stay repeated; rows without a key are left out.
    """
    name = F.lower(F.regexp_replace(F.col("_strong"), r"^[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$", ""))
    rows = df.select(df[f"`{row_key}`"].cast("long").alias("row_key"), df[f"`{strong}`"].cast("string").alias("_strong"), df[f"`{weak}`"].cast("string").alias("_weak"))
    rows = rows.where("row_key IS NOT NULL").select("row_key", F.concat(F.lit("0"), name).alias("a"), F.concat(F.lit("1"), F.col("_weak")).alias("b"))
    space, rounds, n_rows = Workspace(spark, "groups"), Workspace(spark, "stars"), rows.count()
    names = rows.select(F.col("a").alias("name")).union(rows.select("b")).where("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    # Numbers in the order of the names, so that the least node is the least name; they are exact, unlike hashes.
    numbered = rounds.write(with_ordinal(names, "name", name="node").select("name", "node", "n"), "names")
    keyed = rows
    for side in ("a", "b"):
        keyed = join_unique_skewed(keyed, numbered.select(F.col("name").alias(side), F.col("node").alias(f"node_{side}"), F.col("n").alias(f"n_{side}")), side, F.col(f"n_{side}"), "left", n_rows).drop(f"n_{side}")
    keyed = rounds.write(keyed.select("row_key", "node_a", "node_b"), "rows")
    found = star_components(spark, keyed.select(F.col("node_b").alias("u"), F.col("node_a").alias("v")), space=rounds)
    mine = keyed.select("row_key", F.coalesce("node_b", "node_a").alias("node"))
    weight = mine.where("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    sized = weight.join(found, "node", "left").select("node", "n", F.coalesce("component", "node").alias("least"))
    named = sized.join(numbered.select(F.col("node").alias("least"), F.col("name").alias("component")), "least").select("node", "n", "component")
    placed = join_unique_skewed(mine, named, "node", F.col("n"), "left", n_rows).select("row_key", F.coalesce("component", F.concat(F.lit("2"), F.col("row_key").cast("string"))).alias("component"))
    placed = space.write(placed, "placed")
    rounds.clear()
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n_rows"))
    group_in = F.when(F.col("component").startswith("0"), F.expr("substring(component, 2)"))
    return join_unique_skewed(placed, sizes, "component", F.col("n_rows"), left_rows=n_rows).select("row_key", "component", group_in.alias("group_in"), "n_rows")


def assign_splits(groups: DataFrame, targets: DataFrame, heavy_share: float = 0.005, seed: int = 0, fixed: bool = False) -> DataFrame:
    """(row_key, split_name) of every row of ``groups`` (see :func:`related_groups`).

    The hash of a component falls into a range of [0, 1) that belongs to a split; ranges are
    proportional to the targets. With ``fixed`` that is all: ranges depend on the targets
    only, so a component stays in its split whatever else the data holds (unless it gets
    another least entity), and shares are as near as its largest components allow. Without,
    the shares are nearer, but ranges move with the data. Components of more than ``heavy_share`` of all rows (at most
    1 / heavy_share of them, which bounds what the driver and the broadcast hold) would upset
    the shares wherever they fall: they go first, largest first, each to the split that is
    furthest below its target, and the ranges of the others are proportional to what the
    targets leave. Targets need not sum to 1; null or negative ones count as 0. Without any
    positive target the split is null.
    """
    names = sorted(((r["split_name"], max(r["target_share"] or 0.0, 0.0)) for r in targets.collect()), key=lambda x: str(x[0]))
    whole = sum(s for _, s in names)
    if not whole:
        return groups.select("row_key", F.lit(None).cast("string").alias("split_name"))
    if fixed:
        return groups.select("row_key", _range_of(dict(names), seed).alias("split_name"))
    total = groups.count()
    sizes = groups.select("component", "n_rows").where(F.col("n_rows") > F.lit(heavy_share * total)).distinct()
    heavy = sorted(((r["component"], r["n_rows"]) for r in sizes.collect()), key=lambda x: (-x[1], x[0]))
    room = {n: s / whole * total for n, s in names}
    placed: dict[str, list[str]] = {}
    for component, n in heavy:
        best = max(room, key=lambda k: (room[k], str(k)))
        room[best] -= n
        placed.setdefault(best, []).append(component)
    ranges = _range_of({n: max(x, 0.0) for n, x in room.items()}, seed)
    heaviest = reduce(lambda acc, kv: acc.when(F.col("component").isin(kv[1]), F.lit(kv[0])), placed.items(), F.when(F.lit(False), F.lit("")))
    return groups.select("row_key", F.coalesce(heaviest, ranges).alias("split_name"))


def _range_of(shares: dict[str, float], seed: int) -> Column:
    """The split in whose range a component's hash falls; ranges are proportional to ``shares``, in the order of names."""
    point = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("component")), 11).cast("double") / F.lit(float(1 << 53))
    edge, ranges, scale = 0.0, F.when(F.lit(False), F.lit("")), sum(shares.values()) or 1.0
    for n, x in shares.items():
        edge += x / scale
        ranges = ranges.when(point < edge, F.lit(n))
    return ranges.otherwise(F.lit(max(shares, key=lambda k: (shares[k], str(k)))))
