"""Substring dedup: passages of ``window`` words that stand earlier in the corpus, by FM-indexes.

Shards. All windows of equal words share the smallest hash of their five-word shingles, so runs of
windows with the same smallest hash (an anchor) travel together as a segment of at most ``SPAN``
windows, and equal windows meet in one shard whatever documents they are in. A first scan emits
anchors alone; only segments whose anchor occurs again anywhere are cut from the texts.

Index. Copies of a segment meet in Spark's partial sums and leave their earliest place (a copy that
isn't the earliest has nothing new). Each shard, a bounded share of the corpus, indexes its distinct
segments in a compressed FM-index (``fm_index``) and streams them through it: matching statistics
give for every place the longest match and its rows in the suffix array, and where that reaches
``window`` words, the earliest place among those rows says whether the window is new.

Hot anchors. An anchor with more than ``HOT`` distinct segments (a passage in very many documents,
with all that stands around it) is dealt out window by window instead, so no shard grows with it.

Nothing is sampled or capped: hashes only route, words decide (a segment's key is its words).
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary import mix64
from .common import join_small, read_table, short_batches, written
from .fm_index import FMIndex

WINDOW, ANCHOR, SPAN = 20, 5, 16
#: Characters of text a shard, distinct segments of an anchor that stay together, bytes handled at once.
SHARD_CHARS, HOT, CHUNK = 2_000_000, 1_024, 1_000_000
#: Hot anchors that may be broadcast; more are joined.
BROADCAST_HOT = 1_000_000
#: Random odd multipliers of the hashes, and the 64-bit value of each byte.
P_BYTE, P_WORD = np.uint64(0x9E3779B97F4A7C55), np.uint64(0xC2B2AE3D27D4EB4F)
BYTE = mix64(np.arange(256, dtype=np.uint64), 1)
POWERS = np.cumprod(np.full(4096, P_BYTE, np.uint64), dtype=np.uint64)


def chunks(texts, most: int = CHUNK):
    """Normal texts (words joined by one space) of a batch, in lists of about ``most`` bytes: (first number, list)."""
    first, part, size = 0, [], 0
    for i, text in enumerate(texts):
        part.append(b" ".join((text or "").encode("utf-8", "surrogatepass").split()))
        size += len(part[-1])
        if size >= most:
            yield first, part
            first, part, size = i + 1, [], 0
    if part:
        yield first, part


class Segments:
    """Words of some normal texts, and their segments.

    words: (begin, end) in ``data``, ``text_of`` and ``first`` (its text's first word); segments:
    ``at`` (first word), ``n`` (windows), ``anchor`` and ``times`` (places of it in the segment).
    """

    def __init__(self, texts: list[bytes], window: int = WINDOW, anchor: int = ANCHOR, span: int = SPAN):
        self.data = b" ".join(texts)
        counts = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
        raw = np.frombuffer(self.data, np.uint8)
        space = raw == 32
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
        self.begin, self.end = edge[::2], edge[1::2]
        self.counts, self.text_of = counts, np.repeat(np.arange(len(texts)), counts)
        self.first = np.repeat(np.cumsum(counts) - counts, counts)
        words = len(self.begin)
        self.at = self.n = self.times = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        if words < window:
            return
        size = self.end - self.begin
        letters = raw[~space]
        offset = np.cumsum(size) - size
        inner = np.arange(len(letters)) - np.repeat(offset, size)
        word = mix64(np.add.reduceat(BYTE[letters] * POWERS[inner % len(POWERS)], offset), 2)
        shingle = np.zeros(words - anchor + 1, np.uint64)
        factor = np.uint64(1)
        for j in range(anchor):
            shingle += word[j : words - anchor + 1 + j] * factor
            factor = np.uint64(int(factor) * int(P_WORD) & (2**64 - 1))
        shingle = mix64(shingle, 3)
        least, width = shingle, 1
        while width < window - anchor + 1:
            step = min(width, window - anchor + 1 - width)
            least, width = np.minimum(least[:-step], least[step:]), width + step
        whole = np.flatnonzero(self.text_of[: len(least)] == self.text_of[window - 1 :])
        if not len(whole):
            return
        least, owner = least[whole], self.text_of[whole]
        new = np.concatenate(([True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])))
        place = np.arange(len(whole))
        new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % span == 0
        starts = np.flatnonzero(new)
        self.at, self.n = whole[starts], np.diff(np.concatenate((starts, [len(whole)])))
        self.anchor = least[starts]
        self.times = np.zeros(len(starts), np.int64)
        for j in range(span + window - anchor):
            inside = j < self.n + window - anchor
            self.times += inside & (shingle[np.minimum(self.at + j, len(shingle) - 1)] == self.anchor)


def anchors(docs: DataFrame) -> DataFrame:
    """(anchor, rid, n): each text's distinct anchors, and how often its segments have them."""

    def run(batches):
        for b in batches:
            rid = b["rid"].to_numpy()
            for first, texts in chunks(b["text"]):
                s = Segments(texts)
                seen = pd.DataFrame({"anchor": s.anchor.view(np.int64), "rid": rid[first + s.text_of[s.at]], "n": s.times})
                yield seen.groupby(["anchor", "rid"], sort=False, as_index=False)["n"].sum()

    return docs.select("rid", "text").mapInPandas(run, "anchor long, rid long, n long")


def repeated(segment: np.ndarray, lists) -> np.ndarray:
    """Which anchors are in any of the lists; being repeated is a matter of the anchor alone."""
    known = [np.asarray(x, np.int64) for x in lists if x is not None and len(x)]
    return np.isin(segment.view(np.int64), np.concatenate(known)) if known else np.zeros(len(segment), bool)


def segments(docs: DataFrame) -> DataFrame:
    """(rid, d, th, anchor, at, words) of the segments of docs (rid, d, th, text, anchors) with those anchors."""

    def run(batches):
        for b in batches:
            keys = {c: b[c].to_numpy() for c in ("rid", "d", "th")}
            for first, texts in chunks(b["text"]):
                s = Segments(texts)
                pick = np.flatnonzero(repeated(s.anchor, b["anchors"].iloc[first : first + len(texts)]))
                at, last = s.at[pick], s.at[pick] + s.n[pick] + WINDOW - 2
                words = [s.data[x:y].decode("utf-8", "surrogatepass") for x, y in zip(s.begin[at].tolist(), s.end[last].tolist())]
                owner = first + s.text_of[at]
                out = {c: v[owner] for c, v in keys.items()} | {"anchor": s.anchor[pick].view(np.int64), "at": at - s.first[at], "words": words}
                yield pd.DataFrame(out, columns=["rid", "d", "th", "anchor", "at", "words"])

    return docs.mapInPandas(run, "rid long, d long, th long, anchor long, at long, words string")


def new_windows(shard: pd.DataFrame, window: int = WINDOW, span: int = SPAN) -> pd.DataFrame:
    """(rid, d, th, kept): for each segment of a shard with new windows, its place and a bit for each of them.

    ``kept`` holds the place times 2^span, plus bit i if the window i words on stands nowhere earlier.
    """
    listed = [w.split(" ") for w in shard["words"]]
    sizes = np.array([len(w) for w in listed], np.int64)
    ids, distinct = pd.factorize(pd.Series([w for words in listed for w in words], dtype=object))
    ids = ids.astype(np.int64) + 1
    ends = np.cumsum(sizes)
    index = FMIndex(np.split(ids, ends[:-1]), len(distinct), window)
    # places in corpus order: the document's rank, then the word
    d, th, at = (shard[c].to_numpy() for c in ("d", "th", "at"))
    order = np.lexsort((th, d))
    changed = np.concatenate(([False], (d[order][1:] != d[order][:-1]) | (th[order][1:] != th[order][:-1])))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(changed)
    base = rank * (int(at.max()) + span + window + 2) + at
    place = np.full(index.n, np.iinfo(np.int64).max)
    flat = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.arange(len(ids)) - np.repeat(ends - sizes, sizes)
    place[index.starts[flat] + inner] = base[flat] + inner
    first, _ = index.blocks(window)
    heads = np.flatnonzero(index.common[:-1] < window)
    earliest = np.minimum.reduceat(place[index.sa], heads)
    length, row = index.matching_statistics(ids, ends - sizes, ends)
    match = np.flatnonzero(length >= window)
    new = earliest[np.searchsorted(heads, first[row[match]])] == base[flat[match]] + inner[match]
    bits = np.zeros(len(sizes), np.int64)
    np.bitwise_or.at(bits, flat[match[new]], np.int64(1) << inner[match[new]])
    has = bits > 0
    out = {c: shard[c].to_numpy()[has] for c in ("rid", "d", "th")} | {"kept": at[has] * (1 << span) + bits[has]}
    return pd.DataFrame(out)


def without_repeats(texts: pd.Series, anchors: pd.Series, kept: pd.Series, window: int = WINDOW, span: int = SPAN) -> pd.DataFrame:
    """(n_words, n_removed, kept_text) of each text, given its repeated anchors and its new windows."""
    out = []
    for first, part in chunks(texts):
        s = Segments(part)
        rows = range(first, first + len(part))
        pick = np.flatnonzero(repeated(s.anchor, [anchors.iloc[i] for i in rows]))
        edge = np.zeros(len(s.begin) + 1, np.int64)
        many = s.n[pick]
        gone = np.repeat(s.at[pick], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        window_gone = np.zeros(len(s.begin), bool)
        window_gone[gone] = True
        for i, begin in zip(rows, (np.cumsum(s.counts) - s.counts).tolist()):
            if kept.iloc[i] is not None and len(kept.iloc[i]):
                codes = np.asarray(kept.iloc[i], np.int64)
                for bit in range(span):
                    window_gone[begin + (codes[(codes >> bit) & 1 == 1] >> span) + bit] = False
        at = np.flatnonzero(window_gone)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        stays = np.cumsum(edge)[:-1] == 0
        begin = 0
        for text, n in zip(part, s.counts.tolist()):
            own = stays[begin : begin + n]
            left = int(own.sum())
            whole = text if left == n else b" ".join(compress(text.split(b" "), own.tolist()))
            out.append((n, n - left, whole.decode("utf-8", "surrogatepass")))
            begin += n
    return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text"])


def place_columns() -> list[Column]:
    """rid (routes only), d and th (a document's place in the corpus: doc_id, then a hash of the text)."""
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    return [F.xxhash64("doc_id", "text").alias("rid"), number.alias("d"), F.xxhash64("text").alias("th")]


def remove_repeats(docs: DataFrame, shard_chars: int = SHARD_CHARS, hot: int = HOT) -> DataFrame:
    """docs' columns with n_words, n_removed and kept_text, for every row.

    A window is ``WINDOW`` consecutive words; every word of a window that also starts earlier (smaller
    doc_id, or same document and earlier) goes, judged on the input. Null doc_ids count as the largest
    number; rows that share a doc_id but not their text come in the order of a hash of it; rows that
    repeat both are one document and get the same result. Null, empty and short texts have no window
    and lose nothing. Any extra columns are kept as they are.
    """
    short_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "text"]
    rows = docs.select(*place_columns(), "text", F.struct(*names).alias("doc") if names else F.lit(None).cast("struct<x:int>").alias("doc"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-chars // shard_chars))
    again = anchors(rows).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    own = anchors(rows).select("anchor", "rid").join(again, "anchor").groupBy("rid").agg(F.collect_list("anchor").alias("anchors"))
    own = written(own, "repeated-anchors")
    cut = segments(rows.select("rid", "d", "th", "text").join(own, "rid"))
    distinct = written(cut.groupBy("anchor", "words").agg(F.min(F.struct("d", "th", "at", "rid")).alias("p")), "segments")
    many = distinct.groupBy("anchor").count().where(F.col("count") > hot).select("anchor", F.lit(True).alias("hot"))
    distinct = join_small(distinct, written(many, "hot-anchors"), "anchor", "left", BROADCAST_HOT)
    split = F.split("words", " ")
    starts = F.sequence(F.lit(0), F.size(split) - WINDOW)
    windows = distinct.where("hot").select("p", F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice(split, i + 1, WINDOW), " "))).alias("i", "words"))
    moved = F.struct("p.d", "p.th", (F.col("p.at") + F.col("i")).alias("at"), "p.rid")
    windows = windows.groupBy("words").agg(F.min(moved).alias("p")).withColumn("anchor", F.xxhash64("words"))
    shared = distinct.where("hot is null").select("anchor", "words", "p").unionByName(windows)
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int")
    dealt = shared.select(shard.alias("shard"), "p.rid", "p.d", "p.th", "p.at", "words")
    new = dealt.groupBy("shard").applyInPandas(lambda b: new_windows(b), "rid long, d long, th long, kept long")
    new = new.groupBy("rid", "d", "th").agg(F.collect_list("kept").alias("kept"))
    same = rows.join(own, "rid", "left").join(new, ["rid", "d", "th"], "left")
    result = F.pandas_udf(without_repeats_of, "n_words long, n_removed long, kept_text string")("text", "anchors", "kept")
    out = same.select("doc", "text", result.alias("r"))
    return out.select(*[F.col(f"doc.`{c}`") if c != "text" else F.col("text") for c in docs.columns], "r.n_words", "r.n_removed", "r.kept_text")


#: The contract in SQL: every window's first start, then the words that no later start covers.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
listed AS (SELECT doc_id, list_transform(generate_series(1, len(w) - 19), lambda i: array_to_string(w[i:i + 19], ' ')) AS t FROM d WHERE len(w) >= 20),
places AS (SELECT doc_id, unnest(t) AS t, unnest(generate_series(1, len(t))) AS i FROM listed),
windows AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS r FROM places),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS i FROM windows WHERE r > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def without_repeats_of(texts: pd.Series, anchors: pd.Series, kept: pd.Series) -> pd.DataFrame:
    """without_repeats() with the operator's own window."""
    return without_repeats(texts, anchors, kept)


def op11_fm_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of documents."""
    out = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
