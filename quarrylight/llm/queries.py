"""The queries of the problems on training data, over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylight.llm import components, copies, mixing, near_duplicates, pieces, sentences, tokens
from quarrylight.llm.sql import SQL as SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents, asked = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "queries")
    return copies.find_copies(spark, [("documents", documents, "doc_id", "ingested_at"), ("queries", asked, "line_no", "received_at")])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy with the smallest key of its group."""
    return _copies(spark, sf_dir)[1]


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of each group of copies with the number of its copies and the one that came first, from the ledger."""
    return _copies(spark, sf_dir)[0].select("tbl", "kept_key", "copies", "first_key")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.related_groups(spark, _table(spark, sf_dir, "queries"), "line_no", "IN", "id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connected groups of at least two rows that have a need."""
    return _groups(spark, sf_dir).where("n_rows > 1 AND group_in IS NOT NULL").select(F.col("row_key").alias("line_no"), "group_in")


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every row; connected rows share theirs."""
    found = components.assign_splits(_groups(spark, sf_dir), _table(spark, sf_dir, "split_targets"))
    return found.select(F.col("row_key").alias("line_no"), "split_name")


def _rows(df: DataFrame) -> DataFrame:
    """(rule, n) of one row whose columns are rules."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").cast("long").alias("n")) for c in df.columns])).alias("r")).select("r.*")


def p3_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the splits break each rule: checked by plain aggregation over the table's own columns."""
    asked, targets = _table(spark, sf_dir, "queries"), _table(spark, sf_dir, "split_targets")
    placed = asked.join(p3_splits(spark, sf_dir), "line_no", "left").select("line_no", "id", F.lower(F.trim(F.translate("IN", "\t\n\r", "   "))).alias("need"), "split_name")
    apart = lambda key: placed.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("split_name").alias("n")).agg(F.count_if(F.col("n") > 1).alias(f"{key} in two splits"))
    total = placed.count()
    shares = targets.join(placed.groupBy("split_name").agg(F.count(F.lit(1)).alias("n")), "split_name", "full_outer")
    off = F.abs(F.coalesce("n", F.lit(0)) / F.lit(max(total, 1)) - F.coalesce("target_share", F.lit(0.0))) > 0.06
    rows = placed.agg(F.count_if(F.col("split_name").isNull()).alias("row without split"), (F.count(F.lit(1)) - F.count_distinct("line_no")).alias("row twice"))
    parts = [rows, apart("id"), apart("need"), shares.agg(F.count_if(off).alias("share off by over 0.06"))]
    return reduce(DataFrame.unionByName, map(_rows, parts))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the profile 'wide' cuts, and those of them with a cut through a longer stretch without boundary."""
    limit, overlap = _profile(spark, sf_dir, "wide")
    found = pieces.split_documents(_table(spark, sf_dir, "documents"), "doc_id", "content", limit, overlap, with_text=False)
    # A stretch longer than a piece is cut somewhere, wherever else it would be cut: the pieces show it.
    over = F.when((F.col("piece_no") == 0) & (F.col("n_pieces") > 1), F.lit("over"))
    kinds = F.array_compact(F.array(over, F.when(F.col("solid") > limit, F.lit("solid"))))
    return found.select("doc_id", F.explode(kinds).alias("kind")).distinct()


def _profile(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, int]:
    row = _table(spark, sf_dir, "chunk_profiles").where(F.col("profile") == name).first()
    if row is None:
        raise ValueError(f"no profile {name!r}")
    return row["max_chars"], row["overlap_chars"]


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all oversized contents by the profile 'stock', with their texts."""
    return pieces.split_documents(_table(spark, sf_dir, "documents"), "doc_id", "content", *_profile(spark, sf_dir, "stock"))


def p4_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pieces of all contents by the profile 'stock' break each rule of pieces."""
    limit, overlap = _profile(spark, sf_dir, "stock")
    return pieces.piece_violations(p4_pieces(spark, sf_dir), _table(spark, sf_dir, "documents"), "doc_id", "content", limit, overlap)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence units of every text."""
    return sentences.sentence_units(_table(spark, sf_dir, "documents"))


def p8_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many units break each rule: of every text, and of long texts made of 200 neighbours each, which have to be cut as their parts are."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("form", F.lit("")).alias("form"))
    return sentences.unit_violations(documents, per_text=200)


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    prose = _table(spark, sf_dir, "documents").where("form = 'prose'")
    return near_duplicates.near_duplicates(spark, prose, "doc_id", "content")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of similar documents, copies included."""
    found = near_duplicates.similar_pairs(*_near(spark, sf_dir))
    return found.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of equal texts of every document, and how many other classes are similar to it."""
    members, links = _near(spark, sf_dir)
    ends = links.select(F.col("a").alias("class_id")).union(links.select("b"))
    return members.join(ends.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links")), "class_id", "left").select(F.col("id").alias("doc_id"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each document's text."""
    return tokens.encode_documents(_table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents' ids break each rule; decoding has to give the text back."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = documents.join(p6_ids(spark, sf_dir), "doc_id", "left").join(tokens.decode_documents(p6_ids(spark, sf_dir), "doc_id", "ids"), "doc_id", "left")
    blank = F.coalesce(F.length("text"), F.lit(0)) == 0
    counted = joined.agg(
        F.count_if(F.col("ids").isNull()).alias("document without list"), (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("document twice"),
        F.count_if(blank & (F.size("ids") > 0)).alias("ids of no text"), F.count_if(F.coalesce("text", F.lit("")) != F.coalesce("decoded", F.lit("?"))).alias("other text"),
    )
    return _rows(counted)


def p7_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mixture breaks each rule."""
    mixture, shares = _mix(spark, sf_dir)
    targets = _table(spark, sf_dir, "mix_targets")
    used = mixture.join(targets, "source", "left").agg(
        F.count_if(F.col("target_share").isNull()).alias("source without target"), F.count_if(F.col("copies") > F.col("max_repeats")).alias("too many copies"),
        F.count_if(F.col("copies") < 1).alias("row without copies"), (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("document twice"),
    )
    there = shares.where("target_share > 0 AND available_tokens > 0")
    whole = there.agg(F.sum("target_share")).first()[0] or 1.0
    off = F.abs(F.coalesce("actual_share", F.lit(0.0)) - F.col("target_share") / F.lit(whole)) > 0.02
    again = mixture.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("n")).join(shares, "source", "full_outer")
    return _rows(used).unionByName(_rows(there.agg(F.count_if(off).alias("share off by over 0.02")))).unionByName(_rows(again.agg(F.count_if(F.coalesce("n", F.lit(0)) != F.coalesce("used_tokens", F.lit(0))).alias("other sum than reported"))))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    counted = tokens.count_tokens(_table(spark, sf_dir, "documents"), ["doc_id", "source"], "text")
    return mixing.mix_sources(spark, counted, _table(spark, sf_dir, "mix_targets"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture with the number of copies of each."""
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mix(spark, sf_dir)[1]


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_kept, p3_found, p3_splits, p3_violations, p4_found, p4_pieces, p4_violations, p5_found, p5_classes, p6_ids, p6_violations, p7_mixture, p7_shares, p7_violations, p8_found, p8_violations)
}
