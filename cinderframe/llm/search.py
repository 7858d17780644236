"""Ranked lexical search with dual-sorted wavelet trees.

Index. A shard holds a bounded number of documents, numbered in ascending order. Its postings stand
term by term, and within a term by falling impact (a term's weight apart, what one occurrence list
adds to a document's score). That sequence of document numbers is kept as a wavelet tree: a node is
a range of documents, its sequence a stable split of its parent's, so in every node each term's
postings still fall by impact and are one interval. The list is thus sorted both ways: by impact
within a node, by document through the tree.

Search. A query starts with its terms' intervals at the root. The first posting of an interval is
the term's largest impact in the node, so the sum of those, weighted, bounds every document below.
Nodes are taken best bound first, many at a time, and split: intervals of all terms move to the
children by rank alone. A leaf's bound is its document's score. Nodes whose bound is below the kth
score so far can hold nothing, and when none is left the k best are exact.

Layout. One scan counts terms per document (of the queries' terms: no other can score), a second
job deals documents into shards and searches them, and each query's best of every shard are ranked.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import nullable, read_table, short_batches, whole_ids, written
from .fm_index import Bits

K = 50
#: Documents and postings of a shard, terms of the queries that a scan looks for, queries of a task, nodes split at once.
SHARD_DOCS, SHARD_POSTINGS, TERMS, QUERIES, NODES = 16_384, 1_048_576, 1_000_000, 512, 128
#: Bytes that end a term, and the letters that are lower-cased.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a text, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""

    def run(batches):
        for b in batches:
            out = [(i, t.decode("utf-8", "surrogatepass")) for i, text in zip(b["item"], b["text"]) for t in set(terms_of(text))]
            yield pd.DataFrame(out, columns=["item", "term"])

    return items.mapInPandas(run, "item long, term string").distinct()


def count_terms(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, key, n, terms, tfs) of each row of docs (doc_id, no_id, key, text) with a term.

    n counts all terms with repeats; terms and tfs are the wanted ones it holds and how often.
    """
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches):
        find = shared.value.get
        for b in batches:
            out = []
            for text in b["text"]:
                words = terms_of(text)
                tf = Counter(t for t in map(find, words) if t is not None)
                out.append((len(words), list(tf.keys()), list(tf.values())))
            found = pd.DataFrame(out, columns=["n", "terms", "tfs"])
            found.insert(0, "doc_id", nullable(b["doc_id"], b["no_id"]))
            found.insert(1, "key", b["key"].to_numpy())
            yield found[found["n"] > 0]

    return docs.mapInPandas(run, "doc_id long, key long, n long, terms array<int>, tfs array<int>")


class DualSorted:
    """Postings (term, doc, impact) of a shard as a wavelet tree over documents 0..docs-1.

    A level keeps, for every node from left to right, whether each posting goes right; ``tops`` holds the
    impacts in each level's order.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int):
        order = np.lexsort((doc, -impact, term))
        term, doc, impact = term[order], doc[order], impact[order]
        self.terms, self.starts = np.unique(term, return_index=True)
        self.ends = np.append(self.starts[1:], len(term))
        self.levels = max(0, int(docs - 1).bit_length())
        self.bits: list[Bits] = []
        self.tops = [impact]
        for level in range(self.levels):
            one = (doc >> (self.levels - 1 - level)) & 1 == 1
            self.bits.append(Bits(one))
            # all nodes' left parts keep their order in front of the right ones, level by level as a matrix
            turn = np.concatenate((np.flatnonzero(~one), np.flatnonzero(one)))
            doc, impact = doc[turn], impact[turn]
            self.tops.append(impact)
        self.zeros = [int(len(term) - b.ones(np.array([len(term)]))[0]) for b in self.bits]

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of the terms are here, start, end) at the root."""
        at = np.searchsorted(self.terms, terms)
        here = np.flatnonzero((at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)) if len(self.terms) else np.zeros(0, int)
        return here, self.starts[at[here]], self.ends[at[here]]

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int = 0, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
        """(doc, score) of the k best with score above ``floor``, best first and then by number; ties at the end all stay."""
        here, low, high = self.find(terms)
        if not len(here):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        weights = weights[here]
        bound = int((weights * self.tops[0][low]).sum())
        # one frontier a level: bounds, node numbers and intervals (nodes x terms)
        front = [[] for _ in range(self.levels + 1)]
        front[0].append((np.array([bound]), np.zeros(1, np.int64), low[None, :], high[None, :]))
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = floor + 1
        while True:
            best, level = max(((max(int(f[0].max()) for f in fs), i) for i, fs in enumerate(front) if fs), default=(0, -1))
            if level < 0 or best < least:
                break
            parts = front[level]
            bound, node, low, high = (np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]
            fits = bound >= least
            bound, node, low, high = bound[fits], node[fits], low[fits], high[fits]
            front[level] = []
            if level == self.levels:
                docs, scores = np.concatenate((docs, node)), np.concatenate((scores, bound))
                if len(scores) > k:
                    least = max(least, int(np.partition(scores, -k)[-k]))
                    keep = scores >= least
                    docs, scores = docs[keep], scores[keep]
                elif len(scores) == k:
                    least = max(least, int(scores.min()))
                continue
            if len(bound) > nodes:
                turn = np.argpartition(-bound, nodes)
                now, later = turn[:nodes], turn[nodes:]
                front[level].append((bound[later], node[later], low[later], high[later]))
                node, low, high = node[now], low[now], high[now]
            bits, zeros, tops = self.bits[level], self.zeros[level], self.tops[level + 1]
            ones_low, ones_high = bits.ones(low), bits.ones(high)
            for child, (a, z) in enumerate(((low - ones_low, high - ones_high), (zeros + ones_low, zeros + ones_high))):
                has = a < z
                value = np.where(has, tops[np.minimum(a, len(tops) - 1)], 0) @ weights
                fits = (value >= least) & has.any(axis=1)
                if fits.any():
                    front[level + 1].append((value[fits], node[fits] * 2 + child, a[fits], z[fits]))
        order = np.lexsort((docs, -scores))
        return docs[order], scores[order]


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What a term of weight 1 with tf occurrences adds to the score of a document of n terms."""
    m = 100 - 50 + (50 * n * docs) // max(1, terms)
    return (1_000_000_000 * tf) // (1_000 * tf + 20 * m)


def search_shard(shard: pd.DataFrame, queries: list, docs: int, terms: int, k: int) -> pd.DataFrame:
    """(item, doc_id, key, score): each query's k best documents of a shard, ties at the end included."""
    shard = shard.sort_values(["no_id", "doc_id", "key"], kind="stable").reset_index(drop=True)
    sizes = np.array([len(t) for t in shard["terms"]], np.int64)
    flat = lambda c: np.concatenate(shard[c].tolist()).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
    n = np.repeat(shard["n"].to_numpy(), sizes)
    tree = DualSorted(flat("terms"), np.repeat(np.arange(len(shard)), sizes), impacts(flat("tfs"), n, docs, terms), len(shard))
    ids, no_id, key = (shard[c].to_numpy() for c in ("doc_id", "no_id", "key"))
    out = []
    for item, wanted, weights in queries:
        found, scores = tree.top(wanted, weights, k)
        found, scores = found[:k], scores[:k]
        out.append(pd.DataFrame({"item": item, "doc_id": nullable(pd.Series(ids[found]), pd.Series(no_id[found])), "key": key[found], "score": scores}))
    return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("item", "doc_id", "key", "score")})


def shard_searcher(queries, docs: int, terms: int, k: int):
    """search_shard() of broadcast queries, as a function of a shard alone."""
    return lambda shard: search_shard(shard, queries.value, docs, terms, k)


def search(docs: DataFrame, items: DataFrame, k: int = K, shard_docs: int = SHARD_DOCS, terms_a_scan: int = TERMS, queries_a_task: int = QUERIES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0, best first.

    Equal scores go by ascending doc_id, null last, then by a hash of the text; repeated rows are
    documents of their own. Null and termless texts match nothing and don't count in the statistics;
    so do items without terms, and a null item_id is no item; items that share an id are one query. An
    empty side gives no rows. Items stay as (item_id, term) rows in blocks of ``terms_a_scan`` terms
    and ``queries_a_task`` queries, so neither side is bounded.
    """
    spark = docs.sparkSession
    short_batches(spark)
    items = items.select(F.col("item_id").cast("long").alias("item"), "text").where("item is not null")
    wanted = written(query_terms(items), "query-terms")
    vocabulary = wanted.select("term").distinct()
    rows = docs.select(*whole_ids(), F.xxhash64("text").alias("key"), "text")
    blocks = max(1, -(-vocabulary.count() // terms_a_scan))
    numbered = written(vocabulary.select("term", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("b")), "vocabulary")
    offset, found, tables = 0, None, []
    for b in range(blocks):
        part = [r["term"] for r in numbered.where(F.col("b") == b).select("term").collect()]  # about terms_a_scan
        numbers = {t.encode("utf-8", "surrogatepass"): offset + i for i, t in enumerate(sorted(part))}
        offset += len(part)
        tables.append(spark.createDataFrame([(t.decode("utf-8", "surrogatepass"), i) for t, i in numbers.items()], "term string, t int"))
        counted = written(count_terms(rows, numbers), "term-counts")
        found = counted if found is None else found.unionByName(counted)
        size = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first() if b == 0 else size
    n_docs, n_terms = size["docs"], size["terms"] or 0
    numbers = tables[0]
    for t in tables[1:]:
        numbers = numbers.unionByName(t)
    seen = found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    # in doubles, as the weight is defined
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("long").alias("w")
    weights = written(numbers.join(seen, "t").select("term", "t", weight).where("w != 0"), "term-weights")
    asked = wanted.join(weights, "term").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("t", "w"))).alias("q"))
    asked = written(asked.select("item", F.pmod(F.xxhash64("item"), F.lit(1 << 20)).alias("h"), "q"), "queries")
    postings = found.agg(F.sum(F.size("terms"))).first()[0] or 0
    shards = max(1, -(-n_docs // shard_docs), -(-postings // SHARD_POSTINGS))
    per_doc = found if blocks == 1 else found.groupBy("doc_id", "key", "n").agg(F.flatten(F.collect_list("terms")).alias("terms"), F.flatten(F.collect_list("tfs")).alias("tfs"))
    no_id, number = F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id")
    dealt = per_doc.select(F.pmod(F.xxhash64("doc_id", "key"), F.lit(shards)).cast("int").alias("shard"), number, no_id, "key", "n", "terms", "tfs")
    groups = max(1, -(-asked.count() // queries_a_task))
    best = None
    for g in range(groups):
        own = asked.where(F.pmod("h", F.lit(groups)) == g).orderBy("item").collect()  # about queries_a_task
        queries = [(r["item"], np.array([x["t"] for x in r["q"]], np.int64), np.array([x["w"] for x in r["q"]], np.int64)) for r in own]
        shared = spark.sparkContext.broadcast(queries)
        part = dealt.groupBy("shard").applyInPandas(shard_searcher(shared, n_docs, n_terms, k), "item long, doc_id long, key long, score long")
        best = part if best is None else best.unionByName(part)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "key")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the 50 best of all documents for every benchmark item."""
    return search(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))


#: The contract in SQL, scoring every document that shares a term with an item.
ORACLE_SQL = r"""
WITH lower_cased AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
listed AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM lower_cased WHERE t IS NOT NULL),
docs AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM listed WHERE len(w) > 0),
size AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM docs),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM docs) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * size.docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, size GROUP BY term, size.docs),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * size.docs) // size.terms)))))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN tf USING (term), size GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""
