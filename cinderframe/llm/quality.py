"""Quality classifier: an interpolated modified Kneser-Ney model over characters.

Trusted text (labelled of quality, not toxic) trains one model of order ``ORDER`` per language.
Characters, rather than words, keep the n-gram types few however large the corpus gets, so types
are counted, joined and scored once each instead of once per occurrence.

An n-gram is one long: ``BITS`` bits per character, numbered by frequency in the language's trusted
text (rare characters share a number; 0 pads a text's start). One scan gives each type of the whole
corpus with its count in trusted text. The model is a chain of count joins sharded by (language,
n-gram): lower orders count distinct left neighbours, each order has its discounts from its counts
of counts, each context its back-off weight, and

    P(w | c) = max(count - D(count), 0) / total(c) + backoff(c) * P(w | c without its first)

down to the uniform distribution. That gives every type of the corpus its log-probability. The most
frequent types, at most ``BROADCAST_TYPES`` of 12 bytes each, go to the tasks; a text's sum over its
other types, all rare ones, is joined from the sharded table, so no join key is frequent. A language's
threshold is a quantile of the perplexity of trusted texts that were held out of training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_small, nullable, read_table, short_batches, whole_ids, written

ORDER, BITS = 4, 12
HELD_OUT = 5
QUANTILE = 0.99
BROADCAST_TYPES = 4_000_000
BROADCAST_LABELS = 2_000_000
CHARS = 2_000_000
PAD, RARE = 0, 1
MASK = [(1 << (BITS * k)) - 1 for k in range(ORDER + 1)]


def groups(b: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame]]:
    """Parts of a batch of one language and about CHARS characters, one long text being a part."""
    for lang, part in b.groupby("lang", sort=False):
        size = part["text"].str.len().to_numpy().cumsum() // CHARS
        for _, piece in part.groupby(size, sort=False):
            yield lang, piece


def grams(texts: list[str], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams in order, number per text): one n-gram ends at each character."""
    pad = "\x00" * (ORDER - 1)
    joined = pad + pad.join(t.replace("\x00", "\x01") for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    s = numbers[codes].astype(np.int64)
    g = s[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        g |= s[ORDER - 1 - k : len(s) - k] << (BITS * k)
    return g[codes[ORDER - 1 :] != 0], np.fromiter(map(len, texts), np.int64, len(texts))


def numbering(chars: list[int]) -> np.ndarray:
    table = np.full(0x110000, RARE, np.uint16)
    table[0] = PAD
    table[chars] = np.arange(2, 2 + len(chars))
    return table


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, text, trust): 2 trusted and for training, 1 trusted and held out, 0 others."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    good = written(good.where("q = 1 and t = 0").select(F.col("doc_id").alias("l_id")), "trusted")
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    rows = join_small(rows, good, F.col("doc_id") == F.col("l_id"), "left", BROADCAST_LABELS)
    held = F.crc32(F.col("doc_id").cast("string")) % HELD_OUT == 0
    return rows.select("doc_id", "lang", "text", F.when(F.col("l_id").isNull(), 0).when(held, 1).otherwise(2).alias("trust"))


def alphabets(rows: DataFrame) -> dict[str, list[int]]:
    """The commonest characters of each language's training text, commonest first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, part in groups(b):
                codes = np.frombuffer("".join(part["text"]).encode("utf-32-le", "surrogatepass"), "<u4")
                seen, n = np.unique(codes, return_counts=True)
                yield pd.DataFrame({"lang": lang, "code": seen.astype(np.int64), "n": n})

    counts = rows.where("trust = 2 and text <> ''").select("lang", "text").mapInPandas(run, "lang string, code long, n long")
    counts = counts.where("code > 1").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # at most one row per character and language reaches the sort, at most 2^BITS of them the driver
    top = counts.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "code")), asc=False), 1, (1 << BITS) - 3).alias("top"))
    return {r["lang"]: [x["code"] for x in r["top"]] for r in top.collect()}


def count_types(rows: DataFrame, chars: dict[str, list[int]]) -> DataFrame:
    """(lang, g, c, n): every n-gram type of all rows, its count in training text (0 if none) and in all."""
    shared = rows.sparkSession.sparkContext.broadcast(chars)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = {lang: numbering(c) for lang, c in shared.value.items()}
        for b in batches:
            for train, half in b.groupby(b["trust"] == 2):
                for lang, part in groups(half):
                    if lang not in tables:
                        continue
                    g, n = np.unique(grams(list(part["text"]), tables[lang])[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "g": g, "c": n if train else 0, "n": n})

    types = rows.where("text <> ''").select("lang", "text", "trust").mapInPandas(run, "lang string, g long, c long, n long")
    return types.groupBy("lang", "g").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def log_probabilities(types: DataFrame) -> DataFrame:
    """(lang, g, logp) of every type, by count joins from the lowest order up."""
    seen = {ORDER: types.where("c > 0").select("lang", "g", "c")}
    for k in range(ORDER - 1, 0, -1):
        low = F.col("g").bitwiseAND(F.lit(MASK[k])).alias("g")
        seen[k] = written(seen[k + 1].select("lang", low).groupBy("lang", "g").agg(F.count("*").alias("c")), f"ngrams-{k}")
    wanted = {ORDER: types.select("lang", "g")}
    for k in range(ORDER - 1, 0, -1):
        low = F.col("g").bitwiseAND(F.lit(MASK[k])).alias("g")
        wanted[k] = written(wanted[k + 1].select("lang", low).distinct(), f"wanted-{k}")
    below = None
    for k in range(1, ORDER + 1):
        counts = seen[k]
        n = [F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]
        d = counts.groupBy("lang").agg(*n, F.count("*").alias("v"))  # a row a language
        y = "n1 / nullif(n1 + 2 * n2, 0)"
        d = d.selectExpr(
            "lang", "v",
            f"greatest(0D, least(1D, coalesce(1 - 2 * {y} * n2 / nullif(n1, 0), 0.5D))) as d1",
            f"greatest(0D, least(2D, coalesce(2 - 3 * {y} * n3 / nullif(n2, 0), 1D))) as d2",
            f"greatest(0D, least(3D, coalesce(3 - 4 * {y} * n4 / nullif(n3, 0), 1.5D))) as d3",
        )
        d = F.broadcast(d)
        context = F.shiftright("g", BITS)
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        counts = counts.join(d, "lang").select("lang", "g", context.alias("x"), "c", "v", off.alias("off"))
        total = counts.groupBy("lang", "x").agg(F.sum("c").alias("total"), (F.sum("off") / F.sum("c")).alias("backoff"), F.max("v").alias("v"))
        own = counts.select("lang", "g", (F.col("c") - F.col("off")).alias("top"))
        p = wanted[k].select("lang", "g", context.alias("x")).join(own, ["lang", "g"], "left").join(total, ["lang", "x"], "left")
        backoff = F.coalesce("backoff", F.lit(1.0))
        direct = F.coalesce(F.col("top") / F.col("total"), F.lit(0.0))
        if k == 1:
            below = p.select("lang", "g", (direct + backoff / (F.col("v") + 1)).alias("p"))
        else:
            low = below.withColumnRenamed("g", "low").withColumnRenamed("p", "p_low")
            p = p.withColumn("low", F.col("g").bitwiseAND(F.lit(MASK[k - 1]))).join(low, ["lang", "low"])
            below = p.select("lang", "g", (direct + backoff * F.col("p_low")).alias("p"))
        below = written(below, f"probabilities-{k}")
    return below.select("lang", "g", F.log("p").cast("float").alias("logp"))


def frequent(types: DataFrame, most: int) -> int:
    """The least count n such that at most ``most`` types are that frequent; 0 if all types may be.

    From counts by powers of two, so the bound may take fewer than it could.
    """
    by = types.groupBy(F.length(F.bin("n")).alias("size")).count().collect()  # at most 64 rows
    total, least = 0, 2**62
    for r in sorted(by, key=lambda r: -r["size"]):
        total += r["count"]
        if total > most:
            return least
        least = 2 ** (r["size"] - 1)
    return 0


def text_sums(rows: DataFrame, chars: dict[str, list[int]], often: DataFrame) -> DataFrame:
    """(rid, doc_id, lang, trust, n, logp, rest) per row: the sum over ``often`` types, and the other types.

    rid is a row's own number, fixed once this is written; rest is an array of (g, m), m times g.
    """
    models = {}
    for lang in chars:  # numbers only, and one language at a time, to keep the driver small
        part = often.where(F.col("lang") == lang).select("g", "logp").toArrow()
        keys, logp = part["g"].to_numpy(), part["logp"].to_numpy()
        at = np.argsort(keys)
        models[lang] = (keys[at], logp[at])
    shared = rows.sparkSession.sparkContext.broadcast((chars, models))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        alphabet, model = shared.value
        tables = {lang: numbering(c) for lang, c in alphabet.items()}
        rid = TaskContext.get().partitionId() << 40
        for b in batches:
            for lang, part in groups(b):
                n, total = part["text"].str.len().to_numpy(np.int64), np.full(len(part), np.nan)
                rest = [[]] * len(part)
                if lang in tables and n.sum():
                    keys, logp = model[lang]
                    g, _ = grams(list(part["text"]), tables[lang])
                    at = np.minimum(np.searchsorted(keys, g), max(len(keys) - 1, 0))
                    known = keys[at] == g if len(keys) else np.zeros(len(g), bool)
                    end = np.cumsum(n)
                    value = np.where(known, logp[at], 0.0) if len(keys) else np.zeros(len(g))
                    sums = np.concatenate(([0.0], np.cumsum(value, dtype=float)))
                    total = sums[end] - sums[end - n]
                    if not known.all():
                        rest = []
                        for i, j in zip((end - n).tolist(), end.tolist()):
                            own, m = np.unique(g[i:j][~known[i:j]], return_counts=True)
                            rest.append([{"g": x, "m": y} for x, y in zip(own.tolist(), m.tolist())])
                yield pd.DataFrame({"rid": np.arange(rid, rid + len(part)), "doc_id": nullable(part["doc_id"], part["no_id"]), "lang": lang, "trust": part["trust"], "n": n, "logp": total, "rest": rest})
                rid += len(part)

    return rows.select(*whole_ids(), "lang", "text", "trust").mapInPandas(run, "rid long, doc_id long, lang string, trust int, n long, logp double, rest array<struct<g:long,m:long>>")


def perplexities(docs: DataFrame, labels: DataFrame, broadcast_types: int = BROADCAST_TYPES) -> DataFrame:
    """(doc_id, lang, trust, n, perplexity) per row of docs, written."""
    short_batches(docs.sparkSession)
    rows = with_trust(docs, labels)
    chars = alphabets(rows)
    types = written(count_types(rows, chars), "types")
    scores = log_probabilities(types)
    least = frequent(types, broadcast_types)
    if least:
        often = scores.join(types.where(F.col("n") >= least).select("lang", "g"), ["lang", "g"], "left_semi")
        found = written(text_sums(rows, chars, often), "text-sums")
        rare = scores.join(types.where(F.col("n") < least).select("lang", "g"), ["lang", "g"], "left_semi")
        own = found.select("rid", "lang", F.inline("rest")).join(rare, ["lang", "g"])
        sums = own.groupBy("rid").agg(F.sum(F.col("m") * F.col("logp")).alias("more"))
        found = found.join(sums, "rid", "left").withColumn("logp", F.col("logp") + F.coalesce("more", F.lit(0.0)))
    else:
        found = text_sums(rows, chars, scores)
    ppl = F.when((F.col("n") > 0) & ~F.isnan("logp"), F.exp(-F.col("logp") / F.col("n")))
    return written(found.select("doc_id", "lang", "trust", "n", ppl.alias("perplexity")), "perplexity")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, broadcast_types: int = BROADCAST_TYPES) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity, threshold, keep) per row of ``docs`` (doc_id, text, lang).

    keep: perplexity at most the ``quantile`` of its language's held-out trusted texts (of all trusted
    ones where none is held out); equal to it is kept. Null, empty texts and languages without
    trusted text have no perplexity or threshold and are kept, there being no evidence against them.
    A null lang is a language of its own. Repeated rows and null doc_ids keep rows of their own;
    labels that repeat a doc_id count by their maximum; extra columns are not read.
    """
    rows = perplexities(docs, labels, broadcast_types)
    at = lambda c: F.percentile_approx(F.when(c, F.col("perplexity")), quantile, 10_000)
    limits = rows.groupBy("lang").agg(F.coalesce(at(F.col("trust") == 1), at(F.col("trust") == 2)).alias("limit"))
    out = rows.join(F.broadcast(limits), "lang", "left")  # a row a language
    threshold = F.col("limit")
    keep = F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return out.select("doc_id", F.expr("nullif(lang, '')").alias("lang"), F.col("n").alias("n_chars"), "perplexity", threshold.alias("threshold"), keep.alias("keep"))


def op1_quality_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict for every row of documents."""
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
