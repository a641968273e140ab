"""Groups of near-duplicate texts by a blocked sparse product of documents and n-grams.

Similarity of two texts is the Jaccard index of their sets of runs of ``width`` characters,
over lower-cased letters, digits and marks. The product of the incidence matrix with its
transpose counts the runs that two documents share. It isn't formed over all runs:

* Texts that are equal after reduction are one class; only its smallest key takes part.
* Rows of the matrix are thinned to anchors: runs of ``length`` characters whose hash is the
  least among ``window`` neighbours. Any common stretch of ``length + window - 1`` characters
  has an anchor in both texts. Two texts of n runs with threshold 0.6 have three quarters of
  the smaller one's runs in common, and each place where they differ spoils about ``width``
  runs, so some common stretch has at least 36 n / (n + 48) runs. Short texts therefore take
  denser anchors (see ``Setting.tiers``), and texts near a tier's end take those of both, so
  that texts of sizes that can be similar always share a tier.
* Of its anchors a document needs only the rarer ones: two similar documents share at least
  the fraction ``common`` of their anchors. Each leaves out the fraction ``spare`` of its most
  frequent ones, in one order for all documents, so a similar pair still shares at least
  ``common - spare`` of the larger one's. Phrases that occur everywhere drop out.
* An anchor of over ``frequent`` documents, which would give the square of them as pairs, is left
  out even where a document has more of them than it may spare. Such documents follow a
  template. One of them and one that spares all its frequent anchors still share others;
  two of them are looked for among each other by the exact setting, which may leave out
  nearly 60 % of a document's runs, so their template drops out there.
* The product runs in blocks: an anchor's documents are cut into blocks, and each pair of
  blocks is multiplied apart. Counts are added up per pair, and pairs are dropped that
  share less than ``common - spare`` of the smaller one's anchors, or whose sizes alone rule
  out the threshold.

What remains is compared exactly, over all runs of both whole texts. ``Setting.exact()``
takes all runs as anchors and leaves out only what cannot matter, for those who need every
pair whatever the pattern of its edits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from quarrylight.operators.skew import join_unique_skewed
from quarrylight.session import Workspace

NOT_WORD = regex.compile(r"[^\p{L}\p{N}\p{M}]+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Setting:
    """``threshold`` of the Jaccard index of runs of ``width`` characters, and how candidates are found."""

    width: int = 12
    threshold: float = 0.6
    #: (least number of runs, length, window) of each tier; a text is in its own tier and in all
    #: lower ones that a similar smaller text can be in.
    tiers: tuple[tuple[int, int, int], ...] = ((0, 12, 1), (60, 20, 12), (256, 24, 20))
    common: float = 0.3
    spare: float = 0.2
    #: Documents in one block of an anchor's list.
    block: int = 256
    #: Anchors of more documents than this are left out whatever a document would spare; what that could lose is found another way.
    frequent: int | None = 5_000
    #: Anchors of cells of more entries than this (and than a 4096th of all) are counted by aggregation.
    heavy: int = 200_000

    @classmethod
    def exact(cls, width: int = 12, threshold: float = 0.6) -> Setting:
        """Loses no pair: every run is an anchor, and only what the threshold itself allows is left out.

        Two texts of that similarity share at least ``threshold`` of the larger one's runs, so
        if each leaves out less than that of its most frequent runs, in one order for all, a
        shared one remains. The prefix holds over 40 % of all runs instead of a tenth of them
        as anchors: several times the shuffle and disk of the default setting.
        """
        return cls(width, threshold, ((0, width, 1),), common=threshold, spare=threshold - 0.01, frequent=None)


def reduce_text(text: str) -> str:
    """Lower-cased letters, digits and marks; final sigma counts as sigma."""
    return NOT_WORD.sub("", text.lower()).replace("ς", "σ")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= _B
    h ^= h >> np.uint64(27)
    h *= _C
    return h ^ (h >> np.uint64(31))


class Runs:
    """Hashes of all runs of some lengths over a sequence of code points.

    A run's hash is a polynomial in its code points, so that of a long run follows from those
    of its two parts: a length takes one step per binary digit, and lengths share their parts.
    """

    def __init__(self, codes: np.ndarray):
        self._raw = {1: codes.astype(np.uint64)}

    def _polynomial(self, length: int) -> np.ndarray:
        if length not in self._raw:
            head = max((k for k in self._raw if 2 * k >= length and k < length), default=(length + 1) // 2)
            tail = length - head
            first, second = self._polynomial(head), self._polynomial(tail)
            n = max(len(self._raw[1]) - length + 1, 0)
            factor = np.uint64(pow(int(_A), tail, 1 << 64))
            self._raw[length] = first[:n] * factor + second[head : head + n]
        return self._raw[length]

    def hashes(self, length: int) -> np.ndarray:
        return _mixed(self._polynomial(length))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def run_hashes(text: str, width: int) -> np.ndarray:
    """The 64-bit hash of every run of ``width`` characters, in order."""
    return Runs(code_points(text)).hashes(width)


def _sliding_least(h: np.ndarray, window: int) -> np.ndarray:
    """The least of every ``window`` neighbours, by doubling: of 1, 2, 4, ..., then of two that overlap."""
    size, least = 1, h
    while size * 2 <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[: len(h) - window + 1], least[window - size : len(h) - size + 1])
    return least


class Described:
    """Numbers of runs and anchors of many reduced texts, hashed as one sequence.

    A run or window counts for a text only if it lies within it, so the joint sequence gives
    the same as each text by itself.
    """

    def __init__(self, texts: list[str], setting: Setting):
        self.setting = setting
        self.lengths = [len(t) for t in texts]
        self.starts = np.cumsum([0, *self.lengths])
        runs = Runs(code_points("".join(texts)))
        self.hashes = {length: runs.hashes(length) for length in {setting.width, *(length for _, length, _ in setting.tiers)}}
        self.least = {(length, window): _sliding_least(self.hashes[length], window) for _, length, window in setting.tiers if 1 < window <= len(self.hashes[length])}

    def runs(self, i: int, length: int) -> np.ndarray:
        return self.hashes[length][self.starts[i] : self.starts[i] + max(self.lengths[i] - length + 1, 0)]

    def n_runs(self, i: int) -> int:
        return len(np.unique(self.runs(i, self.setting.width)))

    def anchors(self, i: int, n_runs: int) -> list[np.ndarray]:
        """The distinct anchors of a text in each tier; their lowest two bits are the tier."""
        out, tiers = [], self.setting.tiers
        for tier, (least, length, window) in enumerate(tiers):
            end = tiers[tier + 1][0] if tier + 1 < len(tiers) else np.inf
            if not least <= n_runs < end / self.setting.threshold:
                out.append(np.zeros(0, np.uint64))
                continue
            h = self.runs(i, length)
            if window > 1 and len(h) > window:
                h = self.least[length, window][self.starts[i] : self.starts[i] + len(h) - window + 1]
            elif window > 1 and len(h):
                h = h.min(keepdims=True)
            out.append(np.unique(h & np.uint64(0xFFFFFFFFFFFFFFFC)) | np.uint64(tier))
        return out


def _groups(texts: list[str], size: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive groups of about ``size`` characters; a longer text is alone."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        if i > start and n + len(t) > size:
            yield start, i
            start, n = i, 0
        n += len(t)
    if start < len(texts):
        yield start, len(texts)


def _describe(df: DataFrame, key: str, text: str, setting: Setting) -> DataFrame:
    """(id, digest, n_runs, sizes, anchors) of every text of at least ``width`` reduced characters.

    ``sizes`` are the numbers of anchors by tier. Rows without a key are left out.
    """
    import hashlib

    schema = "id BIGINT, digest BINARY, n_runs INT, sizes ARRAY<INT>, anchors ARRAY<BIGINT>"

    def lists(values: list[np.ndarray], kind) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, kind)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                reduced = [reduce_text(t) for t in part.column(1).to_pylist()]
                rows = [i for i, t in enumerate(reduced) if len(t) >= setting.width]
                texts = [reduced[i] for i in rows]
                counts, sizes, found = [], [], []
                for start, end in _groups(texts, GROUP_CHARS):
                    described = Described(texts[start:end], setting)
                    for i in range(end - start):
                        counts.append(described.n_runs(i))
                        by_tier = described.anchors(i, counts[-1])
                        sizes.append(np.array([len(x) for x in by_tier], np.int32))
                        found.append(np.concatenate(by_tier).view(np.int64))
                digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
                columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(digests, pa.binary()), pa.array(counts, pa.int32()), lists(sizes, np.int32), lists(found, np.int64)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "digest", "n_runs", "sizes", "anchors"])

    chosen = df.select(df[f"`{key}`"].cast("long").alias("id"), df[f"`{text}`"].cast("string").alias("text"))
    return chosen.where("id IS NOT NULL AND text IS NOT NULL AND text <> ''").mapInArrow(run, schema)


def _candidates(space: Workspace, reps: DataFrame, setting: Setting) -> tuple[DataFrame, DataFrame | None]:
    """(a, b) of representatives that may be similar, a < b, and the (id) of those that follow a template, None if there are none."""
    t, blocks = setting.threshold, setting.block
    entries = reps.select("id", F.explode("anchors").alias("anchor"))
    # How often an anchor occurs: the frequent ones are told apart by the counts of hash cells, of which
    # only so many can be large; they are counted by aggregation, the others within their partition.
    cell = F.shiftrightunsigned("anchor", 50)  # 16,384 cells
    filled = reps.select(F.explode("anchors").alias("anchor")).groupBy(cell.alias("cell")).count()
    whole = filled.agg(F.sum("count")).first()[0] or 0
    limit = max(whole / 4096, float(setting.heavy))
    large = [r["cell"] for r in filled.where(F.col("count") > limit).select("cell").collect()]  # fewer than 4,096
    by_anchor = Window.partitionBy("anchor")
    if large:
        common, marked = F.col("cell").isin(large), entries.withColumn("cell", cell)
        few, many = marked.where(~common).drop("cell"), space.write(marked.where(common).drop("cell"), "many")
        counts = space.write(many.groupBy("anchor").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "counts")
        several = join_unique_skewed(many, counts, "anchor", F.col("df")).unionByName(few.withColumn("df", F.count(F.lit(1)).over(by_anchor)).where("df > 1"))
    else:
        several = entries.withColumn("df", F.count(F.lit(1)).over(by_anchor)).where("df > 1")
    # The most frequent anchors of a document are spared, in one order for all; ``least`` is what a pair has to share.
    tier = F.col("anchor").bitwiseAND(3)
    own_size = F.element_at("sizes", (tier + 1).cast("int"))
    spared = F.floor(own_size * setting.spare).cast("int")
    least = F.greatest(F.lit(1), F.floor(own_size * (setting.common - setting.spare)).cast("int"))
    place = F.row_number().over(Window.partitionBy("id", "tier").orderBy(F.col("df").desc(), "anchor"))
    sized = several.join(reps.select("id", "n_runs", "sizes"), "id").withColumn("tier", tier)
    kept = sized.withColumn("place", place).where(F.col("place") > spared)
    frequent = F.lit(False) if setting.frequent is None else F.col("df") > setting.frequent
    prefix = space.write(kept.select("anchor", "id", "n_runs", least.alias("least"), F.col("df").cast("int").alias("df"), frequent.alias("frequent")), "prefix")
    templated = space.write(prefix.where("frequent").select("id").distinct(), "templated") if setting.frequent is not None else None
    prefix = prefix.where("NOT frequent").drop("frequent")
    # Blocks: document lists longer than a block are cut, and every pair of blocks is one product.
    n_blocks = F.ceil(F.col("df") / F.lit(blocks)).cast("int")
    own = F.when(n_blocks > 1, F.pmod(F.xxhash64("id"), n_blocks)).otherwise(0).cast("int")
    cut = prefix.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), n_blocks - 1))})
    cells = cut.groupBy("anchor", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    product = cells.agg(F.collect_list(F.struct("id", "n_runs", "least", "own")).alias("docs")).where(F.size("docs") > 1)  # two blocks at most
    rows = product.select("anchor", "i", "j", "docs", F.explode("docs").alias("x"))
    x = F.col("x")

    def partner(y):
        sizes = F.least(x["n_runs"], y["n_runs"]) >= F.lit(t) * F.greatest(x["n_runs"], y["n_runs"])
        return (x["id"] < y["id"]) & sizes & ((F.col("i") == F.col("j")) | (x["own"] != y["own"]))

    pairs = rows.select("anchor", "x", F.explode(F.filter("docs", partner)).alias("y"))
    pairs = pairs.select("anchor", F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.least("x.least", "y.least").alias("least"))
    counted = pairs.groupBy("a", "b", F.col("anchor").bitwiseAND(3).alias("tier")).agg(F.count(F.lit(1)).alias("shared"), F.min("least").alias("least"))
    return counted.where("shared >= least").select("a", "b").distinct(), templated


def jaccard(a: str, b: str, width: int) -> float:
    """The Jaccard index of the sets of runs of two reduced texts."""
    x, y = np.unique(run_hashes(a, width)), np.unique(run_hashes(b, width))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def _verify(pairs: DataFrame, texts: DataFrame, setting: Setting) -> DataFrame:
    """The pairs (a, b, similarity) whose whole texts reach the threshold.

    The text of ``b`` travels to each of its pairs, that of ``a`` once to all of them: the rows
    of one ``a`` are sorted behind its text. A text of many pairs is a hot key on either side,
    so its pairs are spread over as many salts as they need, and its text goes to each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            rows, scores = [], []
            others, values = batch.column(1).to_pylist(), batch.column(2)
            for i, b in enumerate(others):
                found = np.unique(run_hashes(reduce_text(values[i].as_py()), setting.width))
                if b is None:
                    own = found
                    continue
                both = len(np.intersect1d(own, found, assume_unique=True))
                score = both / max(len(own) + len(found) - both, 1)
                if score >= setting.threshold:
                    rows.append(i)
                    scores.append(score)
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(scores, pa.float64())], names=["a", "b", "similarity"])

    salts = F.ceil(F.col("n") / F.lit(PAIRS_OF_A_SALT)).cast("int")
    by_b = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select("b", salts.alias("salts_b"))
    by_a = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", salts.alias("salts_a"))
    spread = lambda other, n: F.pmod(F.xxhash64(other), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("salt")
    salted = pairs.join(by_b, "b").join(by_a, "a").select("a", "b", spread("b", "salts_a").alias("salt_a"), spread("a", "salts_b").alias("salt"))
    to_b = texts.withColumnRenamed("id", "b").join(by_b, "b").select("b", "text", each("salts_b"))
    to_a = texts.withColumnRenamed("id", "a").join(by_a, "a").select("a", F.lit(None).cast("long").alias("b"), "text", each("salts_a"))
    rows = salted.join(to_b, ["b", "salt"]).select("a", "b", "text", F.col("salt_a").alias("salt")).unionByName(to_a)
    placed = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return placed.select("a", "b", "text").mapInArrow(run, "a BIGINT, b BIGINT, similarity DOUBLE")


def near_duplicates(spark: SparkSession, df: DataFrame, key: str, text: str, setting: Setting | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the texts of ``df``, whose ``key`` is a unique BIGINT.

    ``members`` (id, class_id): every text of at least ``width`` reduced characters with the
    smallest key of its class of texts that are equal after reduction. ``links`` (a, b,
    similarity): pairs of class representatives, a < b, whose similarity reaches the
    threshold; copies are not expanded into pairs. Null, empty and shorter texts have no
    row, rows without a key none either. Other columns of ``df`` are neither read nor kept.
    """
    setting = setting or Setting()
    space = Workspace(spark, "near")
    described = space.write(_describe(df, key, text, setting), "described")
    classes = space.write(described.groupBy("digest").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n")).where("n > 1"), "classes")
    copied = join_unique_skewed(described.select("id", "digest"), classes, "digest", F.col("n")).where("id <> class_id").select("id", "class_id")
    copies = space.write(copied, "copies")
    n_copies = copies.count()
    gone = copies.select("id")
    if n_copies <= COPIES_BROADCAST:
        gone = F.broadcast(gone)
    reps = described.join(gone, "id", "left_anti")
    ids = space.write(described.select("id"), "ids")
    source = df.select(df[f"`{key}`"].cast("long").alias("id"), df[f"`{text}`"].cast("string").alias("text"))
    found, templated = _candidates(space, reps, setting)
    pairs = space.write(found, "candidates")
    if templated is not None and templated.limit(1).count():
        exact, inner = Setting.exact(setting.width, setting.threshold), Workspace(spark, "near-templates")
        own = inner.write(_describe(source.join(templated, "id", "left_semi"), "id", "text", exact), "described")
        more, _ = _candidates(inner, own, exact)
        pairs = space.write(pairs.union(more).distinct(), "all-candidates")
        inner.clear()
    space.drop("prefix")  # what follows reads the written ids, copies and candidates only
    space.drop("described")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    links = _verify(pairs, source.join(wanted, "id", "left_semi"), setting)
    members = ids.join(copies, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))
    return members, links


def similar_pairs(members: DataFrame, links: DataFrame, block: int = 512) -> DataFrame:
    """All pairs (a, b), a < b, of similar texts, copies among each other and each copy's links included.

    ``members`` and ``links`` are those of :func:`near_duplicates`. A class of n copies gives
    n (n - 1) / 2 pairs and a link as many as the product of its classes, so the rows grow with
    the square of a class; where a class may hold a large share of all rows, ``members`` and
    ``links`` say the same in one row a text and one a pair of classes. Classes are cut into
    blocks of about ``block`` members and every pair of blocks is joined apart, so no class is
    ever gathered by one task. Empty inputs give no pairs.
    """
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = sizes.select("class_id", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks"))
    part = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("part")
    several = members.join(sizes, "class_id").select("class_id", "id", part)
    within = sizes.select(F.col("class_id").alias("a"), F.col("class_id").alias("b"))
    count = lambda side: sizes.select(F.col("class_id").alias(side), F.col("blocks").alias(f"blocks_{side}"))
    numbered = links.select("a", "b").unionByName(within).join(count("a"), "a", "left").join(count("b"), "b", "left")
    for side in ("a", "b"):  # a class of one member is its block -1
        last = F.col(f"blocks_{side}") - 1
        numbered = numbered.withColumn(f"part_{side}", F.explode(F.when(last.isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), last))))
    cells = numbered.where("a <> b OR part_a <= part_b").select("a", "b", "part_a", "part_b")
    for side in ("a", "b"):
        mine = several.select(F.col("class_id").alias(side), F.col("part").alias(f"part_{side}"), F.col("id").alias(f"id_{side}"))
        cells = cells.join(mine, [side, f"part_{side}"], "left").withColumn(f"id_{side}", F.when(F.col(f"part_{side}") < 0, F.col(side)).otherwise(F.col(f"id_{side}")))
    met = cells.where("id_a IS NOT NULL AND id_b IS NOT NULL AND (a <> b OR part_a < part_b OR id_a < id_b)")
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


#: Keys of copies are broadcast up to so many, 16 bytes each; beyond, they are joined by a shuffle.
COPIES_BROADCAST = 500_000
#: Texts are hashed jointly in groups of about so many characters.
GROUP_CHARS = 200_000
#: Pairs of one text that share a salt when they are verified.
PAIRS_OF_A_SALT = 1_000
