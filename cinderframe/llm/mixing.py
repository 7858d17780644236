"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Targets. Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words; a
target stops at ``max_repeat`` times its source's words and the excess is reshared by weight.
That water level has a closed form over the sources sorted by ``cap / weight``.

Copies. A source with target t and words s first takes ``floor(t / s)`` whole copies of each
document. The remaining words r are a sample without replacement whose inclusion probability is
proportional to the document's words: ``p = min(1, c * size)``, with c such that the expected words
are r. Pareto order sampling ranks documents by ``u/(1-u) / (p/(1-p))`` and takes the first ones
until r words are reached (the one that crosses r goes in if that is nearer). u is a hash of seed and
the row's key, itself a hash of doc_id and text, so reruns agree and rows without a doc_id differ.

Scale. No task holds a source: words are counted once into a slim table; the level, c and the
cut-off come from aggregated histograms (per source: distinct sizes, then ``BINS`` rank bins, then
``BINS`` more within the bin that holds the cut-off), and only the last bin, about one row in
``BINS`` squared, is ranked row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read_table, small, written

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BINS = 4096
SEED = 42
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in text; null has none."""
    parts = F.split(text, "[\\x20\\x09-\\x0D]+")
    blank_first = F.when(text.rlike("^[\\x20\\x09-\\x0D]"), 1).otherwise(0)
    blank_last = F.when(text.rlike("[\\x20\\x09-\\x0D]\\z"), 1).otherwise(0)
    only_blank = F.coalesce(text, F.lit("")).rlike("^[\\x20\\x09-\\x0D]*\\z")
    return F.when(only_blank, 0).otherwise(F.size(parts) - blank_first - blank_last).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat=MAX_REPEAT) -> DataFrame:
    """(src, source_size, target) from rows (src, size): one row per source.

    A source without words gets target 0. Sources are a small aggregate, so one window orders them.
    """
    by = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("src").asc_nulls_last())
    n = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    by = by.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    level = W.orderBy(F.col("cap") / F.col("w"), F.col("src").asc_nulls_last())
    below = level.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    by = (
        by.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(below), F.lit(0.0)))
        .withColumn("share", (F.col("total") - F.col("capped")) / F.col("w_left"))
        .withColumn("open", F.col("cap") / F.col("w") > F.col("share"))
    )
    water = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("share")))).over(everything)["share"]
    target = F.when(F.col("open"), F.col("w") * water).otherwise(F.col("cap"))
    return by.select("src", "source_size", F.least(target, F.col("cap")).alias("target"))


def uniform(seed: int, key: Column) -> Column:
    """A uniform number in (0, 1) from a hash of seed and key."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 12)
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def pareto_rank(size: Column, c: Column, key: Column, seed: int) -> Column:
    """Random odds over inclusion odds; 0 for a certain document, null for one without words."""
    u = uniform(seed, key)
    p = c * size
    return F.when(size <= 0, None).when(p >= 1, 0.0).otherwise((u / (1 - u)) / (p / (1 - p)))


def sampling_plan(sizes: DataFrame, weights=WEIGHTS, max_repeat=MAX_REPEAT, seed=SEED, bins=BINS) -> DataFrame:
    """One row per source: src, source_size, target, whole, c, q_cut, key_cut.

    ``sizes``: written rows (key, src, size). A document is sampled if its (rank, key) is at most
    (q_cut, key_cut); q_cut is null where nothing is sampled.
    """
    t = written(source_targets(sizes, weights, max_repeat), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    t = t.withColumn("whole", F.floor(ratio + 1e-12).cast("long"))
    t = t.withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))

    # c: the largest documents are certain until the next one's c * size stays below 1
    distinct = sizes.where("size > 0").groupBy("src", "size").agg(F.count("*").alias("n"))
    down = W.partitionBy("src").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("src")
    n, s = F.col("n"), F.col("size").cast("double")
    cuts = (
        distinct.withColumn("s1", F.coalesce(F.sum(n * s).over(down), F.lit(0.0)))
        .withColumn("s2", F.sum(n * s * s).over(whole) - F.coalesce(F.sum(n * s * s).over(down), F.lit(0.0)))
    )
    cuts = null_safe(cuts, t.where("rest > 0").select("src", "rest"))
    c = (F.col("rest") - F.col("s1")) / F.col("s2")
    ok = c * s < 1
    cs = cuts.where(ok).groupBy("src").agg(F.max_by(c, "size").alias("c"))
    t = written(null_safe(t, cs, "left"), "mix-c")

    # the rank at which the words run out: first its bin, then its bin in there, then its row
    ranked = null_safe(sizes.where("size > 0"), t.where("rest > 0 and c is not null").select("src", "c", "rest"))
    ranked = ranked.withColumn("q", pareto_rank(F.col("size"), F.col("c"), F.col("key"), seed)).withColumn("before", F.lit(0))
    place = F.col("q") / (1 + F.col("q")) * bins
    # certain documents are a bin of their own, below the others
    coarse = F.when(F.col("q") == 0, -1).otherwise(F.least(F.floor(place), F.lit(bins - 1)))
    fine = F.when(F.col("q") == 0, -1).otherwise(F.least(F.floor((place - F.floor(place)) * bins), F.lit(bins - 1)))
    for bin_ in (coarse, fine):
        first = written(cut_bin(ranked.withColumn("bin", bin_)), "mix-bin")
        ranked = null_safe(ranked.drop("before").withColumn("bin", bin_), first.withColumnRenamed("bin", "cut_bin")).where("bin = cut_bin").drop("bin", "cut_bin")
    along = W.partitionBy("src").orderBy("q", "key").rowsBetween(W.unboundedPreceding, 0)
    inside = ranked.withColumn("upto", F.col("before") + F.sum("size").over(along))
    takes = F.col("upto") - F.col("rest") <= F.col("rest") - (F.col("upto") - F.col("size"))
    cuts = inside.groupBy("src").agg(F.max(F.when(takes, F.struct("q", "key"))).alias("cut"), F.min("q").alias("q_first"))
    # where not even the first row of the bin is taken, all before it are
    cut = cuts.select("src", F.coalesce(F.col("cut.q"), F.col("q_first")).alias("q_cut"), F.coalesce(F.col("cut.key"), F.lit(None).cast("long")).alias("key_cut"))
    # a source whose sample runs to its end (rounding) takes all of it
    out = null_safe(t, cut, "left")
    q_cut = F.coalesce(F.col("q_cut"), F.when((F.col("rest") > 0) & F.col("c").isNotNull(), F.lit(float("inf"))))
    out = out.select("src", "source_size", "target", "whole", "c", q_cut.alias("q_cut"), "key_cut")
    return written(out, "mix-plan")


def cut_bin(ranked: DataFrame) -> DataFrame:
    """(src, bin, before): the bin in which a source's words run out, and the words before it."""
    up = W.partitionBy("src").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    by = ranked.groupBy("src", "bin").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"), F.max("before").alias("before"))
    by = by.withColumn("upto", F.col("before") + F.sum("words").over(up)).where("upto >= rest")
    return by.groupBy("src").agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("words")).alias("before")), "bin").alias("b")).select("src", "b.bin", "b.before")


def null_safe(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on ``src`` where null equals null; the source tables are small and checked before a broadcast."""
    right = right.withColumnRenamed("src", "src_r")
    return left.join(right, left["src"].eqNullSafe(right["src_r"]), how).drop("src_r")


def copies(size: Column, key: Column, seed: int = SEED) -> Column:
    """How often the mix holds a row that carries its source's plan."""
    q = pareto_rank(size, F.col("c"), key, seed)
    first = (q < F.col("q_cut")) | ((q == F.col("q_cut")) & (key <= F.coalesce("key_cut", F.lit(-(2**63)))))
    return F.when(size > 0, F.col("whole") + F.when(first, 1).otherwise(0)).otherwise(F.lit(0)).cast("long")


def slim_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, key, src, size) per row; key is never null."""
    return docs.select("doc_id", row_key().alias("key"), F.col("source").alias("src"), word_count(F.col("text")).alias("size"))


def row_key() -> Column:
    """What ranks a row: a hash of doc_id and text, so that rows without a doc_id differ too."""
    return F.xxhash64("doc_id", "text")


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    return null_safe(rows, F.broadcast(plan) if small(plan, BROADCAST_SOURCES) else plan, "left")


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat=MAX_REPEAT, seed=SEED) -> DataFrame:
    """``docs`` (doc_id, text, source, any other columns) with each row repeated as the mix takes it.

    Rows without words (null, empty or blank text) are in no mix and go. Null source is a source of
    its own, last in order; a null doc_id is hashed and ranked like any other. Rows that repeat both
    doc_id and text share a rank and are taken or left together. An empty table gives an empty table.
    """
    plan = sampling_plan(written(slim_sizes(docs), "mix-sizes"), weights, max_repeat, seed)
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row"), row_key().alias("key"), F.col("source").alias("src"), word_count(F.col("text")).alias("size"))
    rows = with_plan(rows, plan).withColumn("k", copies(F.col("size"), F.col("key"), seed)).where("k > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("nth")).select("row.*")


def op9_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of documents."""
    docs = read_table(spark, sf_dir, "documents")
    sizes = written(slim_sizes(docs), "mix-sizes")
    rows = with_plan(sizes, sampling_plan(sizes))
    taken = F.col("size") * copies(F.col("size"), F.col("key"))
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
