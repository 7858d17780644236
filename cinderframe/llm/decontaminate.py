"""Benchmark decontamination by a prefix-filtered set join.

A window is ``width`` consecutive words of an item (all words of a shorter item). A document holds
a window if it holds its words in order, so it holds all the window's shingles (three words, or
what a shorter window has). Shingles are ordered by rarity in the documents; for full containment
the necessary prefix of a window is its single rarest shingle. Documents are scanned for prefix
shingles only; each hit joins the windows of that shingle, and the shingle's place in the window
gives the one possible start. Positional and length bounds drop starts before the document or past
its end; what remains is compared word by word with the document's words around the hit.

The prefix shingles are a set of the benchmark's size: it is broadcast to the scan in blocks of at
most ``BLOCK`` entries, one scan a block, so a benchmark of any size is searched whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_small, read_table, short_batches, written

WIDTH = 10
SHINGLE = 3
BLOCK = 1_000_000
BROADCAST_WINDOWS = 1_000_000

#: Bytes that end a word, after A-Z became a-z: all ASCII but digits and a-z.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingles_of(words: list[bytes], k: int) -> list[bytes]:
    """Runs of k words, joined by spaces."""
    if k == 1:
        return words
    return list(map(b" ".join, zip(*(words[i:] for i in range(k)))))


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(window, n, words, item_id): distinct windows by content, a row for each item that has it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for item, text in zip(b["item_id"], b["text"]):
                w = words_of(text)
                n = min(width, len(w))
                texts = {b" ".join(w[i : i + n]).decode("utf-8", "surrogatepass") for i in range(len(w) - n + 1)} if n else ()
                out += [(item, x, n) for x in texts]
            yield pd.DataFrame(out, columns=["item_id", "window", "n"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return items.mapInPandas(run, "item_id string, window string, n int").distinct()


def scan(docs: DataFrame, wanted: dict[int, frozenset], reach: int, count: bool) -> DataFrame:
    """Hits of wanted shingles (by their number of words) in whole texts.

    count: (shingle, n) summed by batch; else (rid, doc_id, n_words, pos, shingle, before, after) with up
    to ``reach`` words to either side, for exact comparison.
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = shared.value
        for b in batches:
            total, out = Counter(), []
            for rid, text in zip(b["rid"], b["text"]):
                w = words_of(text)
                for k, want in sets.items():
                    at = [i for i, s in enumerate(shingles_of(w, k)) if s in want] if len(w) >= k else ()
                    for i in at:
                        s = b" ".join(w[i : i + k]).decode("utf-8", "surrogatepass")
                        if count:
                            total[s] += 1
                        else:
                            near = b" ".join(w[max(0, i - reach) : i + k + reach]).decode("utf-8", "surrogatepass")
                            out.append((rid, len(w), i, s, near))
            if count:
                yield pd.DataFrame(list(total.items()), columns=["shingle", "n"])
            else:
                yield pd.DataFrame(out, columns=["rid", "n_words", "pos", "shingle", "near"])

    schema = "shingle string, n long" if count else "rid string, n_words int, pos int, shingle string, near string"
    return docs.select("rid", "text").mapInPandas(run, schema)


def blocks(keys: DataFrame, column: str, block: int) -> Iterator[dict[int, frozenset]]:
    """The distinct keys in sets of at most ``block``, grouped by their number of words."""
    n = max(1, -(-keys.count() // block))
    for i in range(n):
        part = keys.where(F.pmod(F.xxhash64(column), F.lit(n)) == i).select(column).toLocalIterator()
        sets: dict[int, set] = {}
        for (s,) in part:
            raw = s.encode("utf-8", "surrogatepass")
            sets.setdefault(raw.count(b" ") + 1, set()).add(raw)
        yield {k: frozenset(v) for k, v in sets.items()}


def occurrences(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(rid, start, n, item_id): where each item's windows occur in docs (rid string, text)."""
    windows = written(item_windows(benchmark, width), "windows")
    texts = windows.select("window", "n").distinct()
    split = F.split("window", " ")
    k = F.least(F.col("n"), F.lit(shingle))
    texts = texts.select("window", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n") - k + 1), lambda i: F.array_join(F.slice(split, i, k), " "))).alias("at", "shingle"))
    texts = written(texts, "window-shingles")
    keys = written(texts.select("shingle").distinct(), "shingle-keys")
    counts = None
    for want in blocks(keys, "shingle", block):
        part = scan(docs, want, 0, True).groupBy("shingle").agg(F.sum("n").alias("seen"))
        counts = part if counts is None else counts.unionByName(part)
    counts = written(counts, "shingle-counts")
    # the rarest shingle of each window, ties to the first; one that no document holds ends the window
    order = W.partitionBy("window").orderBy("seen", "at")
    prefix = texts.join(counts, "shingle", "left").fillna(0, ["seen"]).withColumn("r", F.row_number().over(order))
    prefix = written(prefix.where("r = 1 and seen > 0").select("window", "n", "at", "shingle"), "window-prefix")
    found = None
    for want in blocks(prefix.select("shingle").distinct(), "shingle", block):
        part = scan(docs, want, width, False)
        found = part if found is None else found.unionByName(part)
    hits = join_small(found, prefix, "shingle", "inner", BROADCAST_WINDOWS)
    start = F.col("pos") - F.col("at")
    hits = hits.where((start >= 0) & (start + F.col("n") <= F.col("n_words")))
    near = F.split("near", " ")
    own = F.array_join(F.slice(near, F.least(F.col("pos"), F.lit(width)) - F.col("at") + 1, F.col("n")), " ")
    hits = written(hits.where(own == F.col("window")).select("rid", start.alias("start"), "n", "window"), "window-hits")
    return join_small(hits, windows.select("window", "item_id"), "window", "inner", BROADCAST_WINDOWS).drop("window")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs' columns with n_words, n_hit, n_items, items_sha256, contaminated, for every row.

    Null, empty and wordless texts have no words and no hits (the hash of nothing). Repeated and
    null doc_ids keep rows of their own; null or wordless items have no
    window; an empty benchmark hits nothing. Overlapping occurrences count a word once.
    """
    names = [c for c in docs.columns if c != "text"]
    rows = docs.select(row_key().alias("rid"), F.struct(*names).alias("doc") if names else F.lit(None).alias("doc"), "text")
    hits = written(occurrences(rows, benchmark, width), "hits")
    spans = hits.select("rid", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    before = W.partitionBy("rid").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    seen = F.coalesce(F.max("end").over(before), F.lit(0))
    new = F.greatest(F.col("end") - F.greatest(F.col("start"), seen), F.lit(0))
    n_hit = spans.withColumn("new", new).groupBy("rid").agg(F.sum("new").cast("long").alias("n_hit"))
    items = hits.select("rid", "item_id").distinct().groupBy("rid").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    found = written(n_hit.join(items, "rid"), "hit-documents")
    out = rows.select("rid", "doc", count_words().alias("n_words"))
    out = join_small(out, found, "rid", "left", BROADCAST_WINDOWS)
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc.*", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def row_key():
    """A key of 128 bits that any scan gives a row again; rows that share it have equal doc_id and text."""
    return F.concat(*[F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "text", "doc_id"))])


def count_words():
    """Number of words of ``text``, as words_of() cuts them; the letters' case doesn't matter."""
    parts = F.split(F.coalesce("text", F.lit("")), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    ends = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - ends).cast("long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; same columns."""
    rows = docs.withColumn("__rid", row_key())
    hits = occurrences(rows.select(F.col("__rid").alias("rid"), "text"), benchmark, width)
    bad = written(hits.select(F.col("rid").alias("__rid")).distinct(), "contaminated")
    return join_small(rows, bad, "__rid", "left_anti", BROADCAST_WINDOWS).select(*docs.columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of documents."""
    docs, items = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return contamination(docs.select("doc_id", "text"), items)
