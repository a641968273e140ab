"""Mixing sources to target shares of the tokens by hash thresholds, without sorting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylight.session import Workspace

#: Bits of the hash that one histogram resolves; 2 ** BITS rows a source come to the driver.
BITS = 10
LEVELS = 6


@dataclass(frozen=True)
class Budget:
    """What one source gives: every document ``copies`` times, and once more below the threshold."""

    source: str
    target_share: float
    max_repeats: int
    available: int
    budget: float
    copies: int
    threshold: int  # of the first BITS * LEVELS bits of the hash, exclusive


def _point(seed: int, key: str):
    """The first BITS * LEVELS bits of a row's hash, as a BIGINT of [0, 2 ** 60)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 64 - BITS * LEVELS)


def plan_budgets(rows: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[Budget]:
    """Budgets and thresholds of each source of ``targets`` over ``rows`` (source, point, n_tokens).

    Without ``total_tokens`` the total is the largest at which every source that has tokens
    reaches its share within its repeats. Sources without tokens, and repeats below 1, give
    nothing; shares are of the whole target, so what they leave open isn't filled by others.
    The histograms have one row per source and hash bucket. A source's threshold is the
    bucket edge up to which the sum stays within the budget; then only that boundary bucket
    is split again, until the hash's bits are used.
    """
    wanted = {r["source"]: (max(r["target_share"] or 0.0, 0.0), max(r["max_repeats"] or 0, 0)) for r in targets.collect() if r["source"] is not None}
    if not wanted:
        return []
    mine = rows.where(F.col("source").isin(list(wanted)))
    top = BITS * LEVELS - BITS
    buckets: dict[str, dict[int, int]] = {s: {} for s in wanted}
    for r in mine.groupBy("source", F.shiftrightunsigned("point", top).alias("b")).agg(F.sum("n_tokens").alias("n")).collect():
        buckets[r["source"]][r["b"]] = r["n"]
    available = {s: sum(b.values()) for s, b in buckets.items()}
    feasible = [available[s] * k / share for s, (share, k) in wanted.items() if share and k and available[s]]
    total = total_tokens if total_tokens is not None else min(feasible, default=0.0)
    state = {}
    for s, (share, k) in wanted.items():
        budget = min(share * total, k * available[s])
        copies = min(int(budget // available[s]), k) if available[s] else 0
        state[s] = {"share": share, "k": k, "budget": budget, "copies": copies, "rest": budget - copies * available[s], "threshold": 0, "done": copies >= k or not available[s]}
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        if level:
            open_ = {s: x["threshold"] >> (shift + BITS) for s, x in state.items() if not x["done"]}
            if not open_:
                break
            buckets = {s: {} for s in open_}
            cond = F.lit(False)
            for s, b in open_.items():
                cond |= (F.col("source") == s) & (F.col("point") >= F.lit(b << (shift + BITS))) & (F.col("point") < F.lit((b + 1) << (shift + BITS)))
            for r in mine.where(cond).groupBy("source", F.shiftrightunsigned("point", shift).alias("b")).agg(F.sum("n_tokens").alias("n")).collect():
                buckets[r["source"]][r["b"]] = r["n"]
        for s, x in state.items():
            if x["done"]:
                continue
            base = (x["threshold"] >> shift) if level else 0
            for b in range(base, base + (1 << BITS)):
                n = buckets[s].get(b, 0)
                if n > x["rest"]:
                    x["threshold"] = b << shift
                    break
                x["rest"] -= n
            else:
                x["threshold"], x["done"] = (base + (1 << BITS)) << shift, True
    return [Budget(s, x["share"], x["k"], available[s], x["budget"], x["copies"], x["threshold"]) for s, x in sorted(state.items())]


def mix_sources(spark: SparkSession, documents: DataFrame, targets: DataFrame, key: str = "doc_id", total_tokens: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares) of ``documents`` (key, source, n_tokens) by ``targets`` (source, target_share, max_repeats).

    The mixture has a row (key, source, n_tokens, copies) per document that is used, copies
    between 1 and the source's max_repeats. A document of a null source, or of one without
    target, isn't used. Documents without tokens add nothing and follow the threshold like
    the others. ``shares`` reports per source of either table the tokens available and used
    and the target and actual share; actual shares are null for an empty mixture. Tables of
    the same source repeated in ``targets`` raise.
    """
    if targets.groupBy("source").count().where("count > 1 AND source IS NOT NULL").limit(1).count():
        raise ValueError("a source has more than one target")
    space = Workspace(spark, "mixing")
    rows = space.write(documents.select(F.col(key).alias("key"), "source", F.col("n_tokens").cast("long").alias("n_tokens")).withColumn("point", _point(seed, "key")), "tokens")
    budgets = plan_budgets(rows, targets, total_tokens)
    copies = F.when(F.lit(False), F.lit(0))
    for b in budgets:
        copies = copies.when(F.col("source") == b.source, F.lit(b.copies) + F.when((F.col("point") < F.lit(b.threshold)) & F.lit(b.copies < b.max_repeats), 1).otherwise(0))
    used = rows.select("key", "source", "n_tokens", F.coalesce(copies, F.lit(0)).cast("int").alias("copies"))
    mixture = used.where("copies > 0").withColumnRenamed("key", key)
    sums = used.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.count_if(F.col("copies") > 0).alias("n_docs"), F.max("copies").alias("most_copies"))
    whole = sums.agg(F.sum("used_tokens").alias("_total"))
    shares = (
        sums.join(targets.select("source", "target_share", "max_repeats"), "source", "full_outer")
        .crossJoin(F.broadcast(whole))  # one row
        .select(
            "source", "target_share", F.when(F.col("_total") > 0, F.coalesce("used_tokens", F.lit(0)) / F.col("_total")).alias("actual_share"),
            F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
            F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "max_repeats", F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        )
    )
    return mixture, shares
