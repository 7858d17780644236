"""SimHash near-duplicates, with vantage-point trees finding all fingerprint pairs within a radius.

Fingerprints. ASCII-lower-cased words, word shingles (repeats count), XXH64 with seed 42 per
shingle; a bit is 1 if set in over half of the shingle hashes.

Pairs. Work is on distinct fingerprints, so any number of exact copies is one point. A tree is
built from a bounded sample: a node holds a vantage point v and a radius m; a point within m of v
lives inside, else outside, and so ends in exactly one leaf (its shard). By the triangle inequality
a partner within r of x lies inside only if d(x, v) <= m + r and outside only if d(x, v) > m - r; a
point near the boundary therefore also visits the other side. Of a pair that a boundary splits, it
is enough that one visits the other: the outside one does. Each shard then searches its members
and visitors with a tree of its own, and emits a spanning forest of what it links, so the links
stay linear in the points however dense a cluster is. The sample only shapes the tree: no pair is
lost, whatever it held.

The pipeline takes these links first (``tree_links``): texts whose fingerprints the tree links are near-duplicates.
Near copies beyond that radius follow by the exact Jaccard similarity of their distinct shingles (``similar_pairs``):
candidates by a prefix join, but for pairs the tree has joined, thinned by a bound of their parity bits, then compared.

Components. Links of distinct fingerprints (few) go through the star contraction of
``operators.graph``, each round written to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinderframe.operators.graph import components

from .common import held, join_small, nullable, passing_tables, read_table, short_batches, small, whole_ids, written

SHINGLE = 3
RADIUS = 2
SAMPLE = 131_072
SHARD = 2_048
LEAF = 256
#: Sets that a group of one prefix shingle may have for all its pairs to be candidates, and rounds of new prefixes.
GROUP, ROUNDS = 32, 2
#: Sets of a larger group that all others are compared with first.
HUBS = 8
#: Words of 64 parity bits that are kept of a set; of one of so many shingles, for which those are too few, more are kept aside.
PARITY_WORDS, LONG, WIDE_WORDS = 16, 1_700, 256
#: Sets of a large group that are compared in one part, rows of slim tables that may be broadcast, and of tables with parity bits (some 200 bytes).
PART, BROADCAST_SETS, BROADCAST_PARITIES = 128, 2_000_000, 200_000
#: Fingerprints that one task routes through the tree.
ROUTED = 16_384


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text; 0 without words. Memory is bounded by the words of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        pieces = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        pieces = [joined[a:b] for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(x, 42) for x in pieces], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        bits = np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, h, fp) per row of docs (h: a hash of its text); null and wordless texts have fingerprint 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": nullable(b["doc_id"], b["no_id"]), "h": b["h"], "fp": found.view(np.int64)})

    short_batches(docs.sparkSession)
    return docs.select(*whole_ids(), F.xxhash64("text").alias("h"), "text").mapInPandas(run, "doc_id long, h long, fp long")


def build_tree(points: np.ndarray, leaf: int) -> tuple[list, int]:
    """A vantage-point tree over uint64 points: (nodes, number of leaves).

    nodes[i] is (v, m, inside, outside); a child c >= 0 is a node, -1 - c a leaf number.
    """
    nodes: list = []
    todo, leaves = [(points, None, 0)], 0
    while todo:
        pts, parent, side = todo.pop()
        me, split = None, None
        if len(pts) > leaf:
            v = pts[len(pts) // 2]
            d = np.bitwise_count(pts ^ v)
            m = int(np.median(d))
            if (d <= m).all():
                m = int(d.max()) - 1
            if m >= 0 and (d <= m).any() and (d > m).any():
                split = (v, m, pts[d <= m], pts[d > m])
        if split is None:
            me, leaves = -1 - leaves, leaves + 1
        else:
            me = len(nodes)
            nodes.append([split[0], split[1], None, None])
            todo += [(split[3], me, 3), (split[2], me, 2)]
        if parent is not None:
            nodes[parent][side] = me
    return nodes, leaves


def route(nodes: list, points: np.ndarray, member: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, indexes of points, True for members and False for visitors), by triangle bounds."""
    todo = [(0 if nodes else -1, np.arange(len(points)), member)]
    while todo:
        node, at, own = todo.pop()
        if not len(at):
            continue
        if node < 0:
            yield -1 - node, at, own
            continue
        v, m, inside, outside = nodes[node]
        d = np.bitwise_count(points[at] ^ v).astype(np.int64)
        near = d <= m
        go_in = near | (d <= m + radius)
        go_out = ~near | (~own & (d > m - radius))
        todo.append((inside, at[go_in], (own & near)[go_in]))
        todo.append((outside, at[go_out], own[go_out]))


def shard_links(fp: np.ndarray, member: np.ndarray, radius: int, leaf: int = LEAF) -> np.ndarray:
    """Spanning links (rows of two fingerprints) of all pairs within radius of one shard.

    Pairs of two members, or of a member and a visitor; two visitors meet where one is a member.
    """
    parent = np.arange(len(fp))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    nodes, _ = build_tree(fp[member], leaf)
    for _, at, own in route(nodes, fp, member, radius):
        home, other = at[own], at
        for i in range(0, len(home), 512):
            near = np.bitwise_count(fp[home[i : i + 512], None] ^ fp[other][None, :]) <= radius
            for a, b in zip(*np.nonzero(near)):
                x, y = int(home[i + a]), int(other[b])
                rx, ry = root(x), root(y)
                if rx != ry:
                    parent[ry] = rx
                    links.append((fp[x], fp[y]))
    return np.array(links, np.uint64).reshape(-1, 2)


def near_pairs(points: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """Spanning links (a, b) of all pairs of distinct fingerprints (fp long, written) within radius."""
    spark = points.sparkSession
    n = points.count()
    picked = points.orderBy(F.xxhash64("fp")).limit(min(sample, max(1, n // 8)))  # an eighth of the points at most
    seed = np.sort(np.array([r[0] for r in picked.collect()], np.int64).view(np.uint64))
    rng = np.random.default_rng(7)
    rng.shuffle(seed)
    nodes, leaves = build_tree(seed, max(4, int(shard * len(seed) / max(n, 1))))
    shared = spark.sparkContext.broadcast(nodes)  # at most sample / 2 nodes
    parts = max(spark.sparkContext.defaultParallelism, -(-n // ROUTED))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            for leaf, at, member in route(shared.value, fp.view(np.uint64), np.ones(len(fp), bool), radius):
                yield pd.DataFrame({"leaf": leaf, "fp": fp[at], "member": member})

    def search(g: pd.DataFrame) -> pd.DataFrame:
        fp, member = g["fp"].to_numpy(np.int64).view(np.uint64), g["member"].to_numpy(bool)
        found = shard_links(fp, member, radius).view(np.int64)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    routed = points.repartition(parts).mapInPandas(spread, "leaf int, fp long, member boolean")
    return routed.groupBy("leaf").applyInPandas(search, "a long, b long")


def shingles(text: str | None, shingle: int) -> set[bytes]:
    """The distinct word shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= shingle:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)}


def hashes(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    found = shingles(text, shingle)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in found), np.uint64, len(found)))


def common_shingles(docs: DataFrame, shingle: int, sample: int = 4_096, share: int = 6, least: int = 3, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, in how many texts of all each may be) of shingles common in a sample of distinct texts.

    The sample is one text of ``share``, so that shingles of more than ``GROUP`` texts are found whatever their
    number; the ``most`` commonest reach the driver. They only shape the order of shingles: any choice finds the same pairs.
    """
    texts = docs.select("text", F.xxhash64("text").alias("h")).where("text is not null")
    n = docs.count()
    part = min(1.0, max(sample / max(n, 1), 1 / share))
    if part < 1:
        texts = texts.where(F.col("h") < F.lit(int(-(2**63) + 2**64 * part)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"tok": np.concatenate([np.zeros(0, np.uint64), *(hashes(t, shingle) for t in b["text"])]).view(np.int64)})

    counts = written(texts.dropDuplicates(["h"]).select("text").mapInPandas(run, "tok long").groupBy("tok").count().where(F.col("count") >= least), "common-shingles")
    top = (counts if small(counts, most) else counts.orderBy(F.desc("count"), "tok").limit(most)).toArrow()  # 16 bytes a row
    tok, heat = top["tok"].to_numpy().view(np.uint64), top["count"].to_numpy().astype(float)
    at = np.argsort(tok)
    return tok[at], heat[at] / part


def parities(h: np.ndarray, words: int = PARITY_WORDS) -> np.ndarray:
    """Parity bits of a set of shingle hashes, as int64 words: bit i tells whether an odd number of them falls in bucket i.

    Two sets' bits differ at most in as many places as there are hashes in only one of the sets.
    """
    odd = np.bincount((h % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def wide_parities(h: np.ndarray) -> bytes | None:
    """The size of a large set and more of its parity bits; None of others."""
    return np.concatenate(([len(h)], parities(h, WIDE_WORDS))).astype("<i8").tobytes() if len(h) >= LONG else None


def prefix_of(h: np.ndarray, order: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first ``n - ceil(similarity * n) + 1`` of a set's hashes: those not in ``order`` by value, then the rest from rare to common."""
    known, heat = order
    n = len(h)
    at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
    often = known[at] == h if len(known) else np.zeros(n, bool)
    ordered = np.concatenate((h[~often], h[often][np.argsort(heat[at[often]], kind="stable")])) if often.any() else h
    return ordered[: n - math.ceil(similarity * n - 1e-9) + 1 if n else 0]


def shared_prefixes(docs: DataFrame, similarity: float, shingle: int, order: tuple[np.ndarray, np.ndarray], simhash: bool = True) -> DataFrame:
    """(doc_id, h, row, sim, fp, n, odd, wide, toks) per row of docs.

    h is a hash of the text, row a number of its own (fixed once this is written), sim its SimHash
    fingerprint, fp a hash of the shingle set, n its size, odd its parity bits (wide: of a large set) and toks its prefix. Two sets of that Jaccard
    similarity share a prefix shingle, whatever the order; rare ones first keeps those that share one few.
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held(None, dict)
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            sets = [hashes(t, shingle) for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": nullable(b["doc_id"], b["no_id"]), "h": b["h"], "row": np.arange(row, row + len(b)),
                "sim": np.array([fingerprint(t) if simhash else 0 for t in b["text"]], np.uint64).view(np.int64),
                "fp": [np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 42)).view(np.int64) for h in sets], "n": [len(h) for h in sets],
                "odd": [parities(h) for h in sets], "wide": [wide_parities(h) for h in sets], "toks": [prefix_of(h, shared.value, similarity).view(np.int64) for h in sets],
            })
            row += len(b)

    read = docs.select(*whole_ids(), F.xxhash64("text").alias("h"), "text")
    return read.mapInPandas(run, "doc_id long, h long, row long, sim long, fp long, n long, odd array<long>, wide binary, toks array<long>")


def new_prefixes(texts: DataFrame, similarity: float, shingle: int, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(fp, tok): the prefixes of texts (fp, text) under another order of shingles."""
    shared = texts.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            toks = [prefix_of(hashes(t, shingle), shared.value, similarity) for t in b["text"]]
            yield pd.DataFrame({"fp": b["fp"].repeat([len(t) for t in toks]).to_numpy(), "tok": np.concatenate([np.zeros(0, np.uint64), *toks]).view(np.int64)})

    return texts.select("fp", "text").mapInPandas(run, "fp long, tok long")


def texts_of(fps: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(fp, text): a text of each set (fps: fp, distinct and written), that of its least (doc_id, hash)."""
    few = join_small(rows.select("fp", "doc_id", "h"), fps, "fp", "left_semi", BROADCAST_SETS)
    by = few.groupBy("fp", "doc_id", "h").agg(F.count("*").alias("times"))
    one = by.groupBy("fp").agg(F.min(F.struct("doc_id", "h", "times")).alias("m"))
    one = written(one.select("fp", "m.*"), "set-keys")
    repeated = one.where("times > 1").limit(1).count()  # rows that repeat both doc_id and text
    own = one.select("fp", "h", F.col("doc_id").alias("own_id"))
    texts = join_small(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text"), own, "h", "inner", BROADCAST_SETS)
    texts = texts.where(F.col("doc_id").eqNullSafe(F.col("own_id"))).select("fp", "text")
    return texts.dropDuplicates(["fp"]) if repeated else texts


def in_parts(pairs: DataFrame, values: DataFrame, load, compare, result: str) -> DataFrame:
    """(a, b, part, result) of pairs (a, b, part; written): compare() of what load() makes of both values (fp, value).

    A part gets the value of each of its sets once, then its pairs, in one stream of rows; it holds a
    few hundred sets at most.
    """
    kind = dict(values.dtypes)["value"]
    need = pairs.select("part", F.explode(F.array("a", "b")).alias("fp")).distinct()
    none, zero = F.lit(None).cast(kind).alias("value"), F.lit(0).cast("long")
    held_values = need.join(values, "fp").select("part", F.lit(0).alias("kind"), F.col("fp").alias("a"), zero.alias("b"), "value")
    dealt = held_values.unionByName(pairs.select("part", F.lit(1).alias("kind"), "a", "b", none))
    dealt = dealt.repartition("part").sortWithinPartitions("part", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sets = None, {}
        for g in batches:
            a, b, parts, out = [], [], [], []
            for part, kind, x, y, value in zip(g["part"].tolist(), g["kind"].tolist(), g["a"].tolist(), g["b"].tolist(), g["value"]):
                if part != now:
                    now, sets = part, {}
                if kind == 0:
                    sets[x] = load(value)
                    continue
                a.append(x)
                b.append(y)
                parts.append(part)
                out.append(compare(sets[x], sets[y]))
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64), "part": np.array(parts, np.int64), "j": np.array(out, float)})

    return dealt.mapInPandas(run, f"a long, b long, part long, {result} double")


def exact_jaccard(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(a, b, j) of distinct pairs (a, b, part; written): the Jaccard similarity of their texts' (fp, text) shingle sets."""

    def compare(one: frozenset, two: frozenset) -> float:
        both = len(one & two)
        return both / max(1, len(one) + len(two) - both)

    return in_parts(pairs, texts.withColumnRenamed("text", "value"), lambda t: frozenset(hashes(t, shingle).tolist()), compare, "j").select("a", "b", "j")


def likely_long(pairs: DataFrame, wide: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, part; written) of large sets that may be that similar by their wide parity bits (fp, wide), as likely() says it of others."""

    def compare(one: np.ndarray, two: np.ndarray) -> float:
        most = (int(one[0]) + int(two[0])) * ((1 - similarity) / (1 + similarity)) + 1e-6
        return float(np.bitwise_count(one[1:] ^ two[1:]).sum(dtype=np.int64) <= most)

    found = in_parts(pairs, wide.withColumnRenamed("wide", "value"), lambda v: np.frombuffer(v, "<u8"), compare, "j")
    return found.where("j > 0").select("a", "b", "part")


def prefix_groups(deal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, members), written: (tok, n, fp) of the n sets of each group, and (shingle, tok, n) of the groups' shingles.

    Sets that share a prefix shingle are a group. Shingles of one passage have the same sets: those
    that do, by their number and two digests of 64 bits, are one group, tok. deal: (fp, tok), distinct.
    """
    by = W.partitionBy("tok")
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "fp")).over(by).alias(f"x{i}") for i in (1, 2)]
    shared = deal.select("tok", "fp", F.count("*").over(by).alias("n"), *marks).where("n > 1")
    shared = written(shared.select(F.col("tok").alias("shingle"), F.xxhash64("n", "x1", "x2").alias("tok"), "n", "fp"), "prefix-members")
    return written(shared.select("tok", "n", "fp").distinct(), "prefix-groups"), shared


def candidate_pairs(groups: DataFrame, seed: int) -> DataFrame:
    """Distinct (a, b, part), a < b, of the sets of a group; part is where a pair is compared.

    All pairs of a group of at most ``GROUP`` sets; of a larger one each member with ``HUBS`` of them,
    which ``seed`` picks. A small group is a part, of a larger one about ``PART`` members with the hubs.
    """
    few, large = (groups.where(c) for c in (f"n <= {GROUP}", f"n > {GROUP}"))
    hubs = [F.min(F.struct(F.xxhash64(F.lit(seed * HUBS + i), "fp").alias("h"), "fp"))["fp"].alias(f"hub{i}") for i in range(HUBS)]
    many = large.groupBy("tok").agg(*hubs)
    listed = few.groupBy("tok").agg(F.sort_array(F.collect_list("fp")).alias("s"))  # at most GROUP of them
    of = F.explode(F.expr("flatten(transform(s, (x, i) -> transform(slice(s, i + 2, size(s)), y -> struct(x as a, y as b))))")).alias("p")
    salt = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / PART))
    star = large.join(many, "tok").select("fp", F.xxhash64("tok", salt).alias("part"), F.explode(F.array(*[f"hub{i}" for i in range(HUBS)])).alias("hub")).where("fp <> hub")
    star = star.select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b"), "part")
    both = listed.select(F.col("tok").alias("part"), of).select("p.*", "part").unionByName(star)
    return both.groupBy("a", "b").agg(F.min("part").alias("part"))


def likely(a: str, b: str, similarity: float) -> Column:
    """Whether two sets (structs n, w0, w1, ...) may be that similar, by their sizes and parity bits; True of all that are.

    A Jaccard similarity s of sets of n and m shingles leaves at most (n + m)(1 - s)/(1 + s) in only one of
    them, and no more parity bits can differ. Sets of many times more shingles than bits nearly always pass.
    """
    def of(c: str) -> tuple[Column, Column]:
        return F.col(f"{a}.{c}"), F.col(f"{b}.{c}")

    bits = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in (of(f"w{i}") for i in range(PARITY_WORDS))), F.lit(0))
    n, m = of("n")
    size = F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9
    return size & (bits <= (n + m) * ((1 - similarity) / (1 + similarity)) + 1e-6)


def likely_pairs(pairs: DataFrame, slim: DataFrame, similarity: float) -> DataFrame:
    """(a, b, part, long) of the pairs (a, b, part) that likely() lets pass and the tree has not joined; slim: (fp, s, root)."""
    one, two = (slim.select(F.col("fp").alias(k), F.col("s").alias(f"s_{k}"), F.col("root").alias(f"r_{k}")) for k in ("a", "b"))
    both = join_small(join_small(pairs, one, "a", "inner", BROADCAST_PARITIES), two, "b", "inner", BROADCAST_PARITIES)
    both = both.where((F.col("r_a") != F.col("r_b")) & likely("s_a", "s_b", similarity))
    return both.select("a", "b", "part", (F.least("s_a.n", "s_b.n") >= LONG).alias("long"))


def tree_links(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, root), written: the root of each set (rows: fp, sim; written) whose text's SimHash fingerprint is another text's or within radius of it.

    Fingerprints meet in the vantage-point tree's shards. Sets of one fingerprint are linked to the
    least of them, linked fingerprints by their least sets.
    """
    both = written(rows.select("fp", "sim").distinct(), "simhash-sets")
    least = written(both.groupBy("sim").agg(F.min("fp").alias("low")), "simhash-lows")
    near = near_pairs(written(least.select(F.col("sim").alias("fp")), "simhash-points"), radius)
    one, two = (least.select(F.col("sim").alias(k), F.col("low").alias(f"low_{k}")) for k in ("a", "b"))
    near = near.join(one, "a").join(two, "b").select(F.col("low_a").alias("a"), F.col("low_b").alias("b"))
    own = both.join(least, "sim").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    links = written(near.unionByName(own).where("a <> b"), "simhash-links")
    return written(components(links).select(F.col("node").alias("fp"), "root"), "simhash-joined")


def similar_pairs(rows: DataFrame, docs: DataFrame, similarity: float, shingle: int, order: tuple[np.ndarray, np.ndarray], joined: DataFrame | None = None) -> DataFrame:
    """Links (a, b) of docs' shingle sets (rows: their shared_prefixes(); written) of at least that similarity, and those of joined.

    Every pair of that similarity is linked or has both ends in one component, and every link is checked on
    the texts, but for those given: joined (tree_links()) are sets of one root, whose pairs are not compared. Sets that share a prefix shingle are a group. In a small group all
    pairs are candidates. In a large one each member first meets a few: near copies are then one
    component, and such a group is done. Where a large group still has several components, its shingle
    is a common one: its members get new prefixes that take such shingles last, in which similar sets
    share one again, and are grouped anew. A pair of which only one is a member shares a shingle of a
    group that is done, so the others need no new prefix. Sets that are common shingles all over come
    to the last round, where members outside a group's largest component are compared with all others.
    """
    firsts = written(rows.where("n > 0").groupBy("fp").agg(F.min("row").alias("row")), "set-rows")
    sets = join_small(rows, firsts.select("row"), "row", "left_semi", BROADCAST_SETS)
    slim = sets.select("fp", F.struct("n", *[F.col("odd")[i].alias(f"w{i}") for i in range(PARITY_WORDS)]).alias("s"))
    if joined is None:
        slim = slim.withColumn("root", F.col("fp"))
    else:
        slim = join_small(slim, joined, "fp", "left", BROADCAST_SETS).withColumn("root", F.coalesce("root", "fp"))
    slim = written(slim, "set-parities")
    wide = written(sets.where("wide is not null").select("fp", "wide"), "wide-parities")
    links = None if joined is None else joined.where("fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b"))
    deal, done = sets.select("fp", F.explode("toks").alias("tok")), None
    for round_ in range(ROUNDS):
        groups, shared = prefix_groups(deal)
        pairs = candidate_pairs(groups, round_)
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        found = checked(pairs, slim, wide, rows, docs, similarity, shingle)
        done = found.select("a", "b") if done is None else written(done.unionByName(found.select("a", "b")), "pairs-done")
        new = found.where(F.col("j") >= similarity).select("a", "b")
        links = new if links is None else written(links.unionByName(new), "similar-pairs")
        mixed = mixed_groups(groups.where(f"n > {GROUP}").select("tok", "fp"), links)
        hot = join_small(shared.where(f"n > {GROUP}").select(F.col("shingle"), "tok", "n").distinct(), mixed.select("tok").distinct(), "tok", "left_semi", BROADCAST_SETS)
        hot = written(hot.select(F.col("shingle").alias("tok"), "n"), "hot-shingles")
        if not hot.limit(1).count():
            return links
        if round_ < ROUNDS - 1:
            order = later(order, hot)
            met = written(mixed.select("fp").distinct(), "mixed-sets")
            deal = written(new_prefixes(texts_of(met, rows, docs), similarity, shingle, order), "new-prefixes")
    # of two members of different components, one is outside the group's largest
    by = mixed.groupBy("tok", "root").count().groupBy("tok").agg(F.max(F.struct("count", "root"))["root"].alias("most"), F.sum("count").alias("n"))
    coded = join_small(mixed, slim.select("fp", "s"), "fp", "inner", BROADCAST_PARITIES).join(by, "tok")
    coded = written(coded.withColumn("block", F.pmod(F.xxhash64("fp"), F.ceil(2 * F.col("n") / PART))), "mixed-parities")
    x = coded.where("root <> most").select(F.col("tok").alias("t_x"), F.col("fp").alias("x"), F.col("root").alias("r_x"), F.col("s").alias("s_x"), F.col("block").alias("b_x"))
    y = coded.select("tok", F.col("fp").alias("y"), F.col("root").alias("r_y"), F.col("s").alias("s_y"), F.col("block").alias("b_y"))
    rest = x.join(y, (F.col("t_x") == F.col("tok")) & (F.col("r_x") != F.col("r_y")) & likely("s_x", "s_y", similarity))
    rest = rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.xxhash64("tok", F.least("b_x", "b_y"), F.greatest("b_x", "b_y")).alias("part"))
    rest = rest.groupBy("a", "b").agg(F.min("part").alias("part")).join(done, ["a", "b"], "left_anti")
    found = checked(rest, slim, wide, rows, docs, similarity, shingle)
    return written(links.unionByName(found.where(F.col("j") >= similarity).select("a", "b")), "similar-pairs")


def mixed_groups(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(tok, fp, root), written: the groups (tok, fp) whose members are in several components of the links."""
    roots = components(links).select(F.col("node").alias("fp"), "root")
    rooted = written(groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted-groups")
    mixed = rooted.groupBy("tok").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("tok")
    return written(rooted.join(mixed, "tok", "left_semi"), "mixed-groups")


def later(order: tuple[np.ndarray, np.ndarray], hot: DataFrame, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """The order with shingles ``hot`` (tok, n: so many sets, more than GROUP) moved to their place by n.

    Only later, never earlier. Beyond ``most`` they are left where they are: any order finds the same pairs.
    """
    top = (hot.orderBy(F.desc("n"), "tok").limit(most) if not small(hot, most) else hot).select("tok", "n").toArrow()  # 16 bytes a row
    tok, heat = top["tok"].to_numpy().view(np.uint64), top["n"].to_numpy().astype(float)
    both, at = np.unique(np.concatenate((order[0], tok)), return_inverse=True)
    out = np.zeros(len(both))
    np.maximum.at(out, at, np.concatenate((order[1], heat)))
    return both, out


def checked(pairs: DataFrame, slim: DataFrame, wide: DataFrame, rows: DataFrame, docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(a, b, j), written: the exact similarity of those pairs (a, b) that may be similar."""
    may = written(likely_pairs(pairs, slim, similarity), "likely-pairs")
    if may.where("long").limit(1).count():
        may = written(may.where("not long").select("a", "b", "part").unionByName(likely_long(may.where("long"), wide, similarity)), "likelier-pairs")
    met = written(may.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "pair-sets")
    texts = written(texts_of(met, rows, docs), "set-texts")
    return written(exact_jaccard(may, texts, shingle), "pair-similarities")


def labelled(docs: DataFrame, shingle: int, radius: int, similarity: float | None, tree: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, roots), both written: (doc_id, h, fp) per row of docs (h: a hash of its text), and each fp's root.

    With ``tree`` texts also link by their fingerprints where a similarity is given.
    """
    if similarity is None:
        rows = written(fingerprints(docs, shingle), "simhash")
        links = near_pairs(written(rows.select("fp").distinct(), "simhash-points"), radius)
    else:
        order = common_shingles(docs, shingle)
        rows = written(shared_prefixes(docs, similarity, shingle, order, tree), "shingle-sets")
        links = similar_pairs(rows, docs, similarity, shingle, order, tree_links(rows, radius) if tree else None)
    return rows.select("doc_id", "h", "fp"), written(components(links).select(F.col("node").alias("fp"), "root"), "simhash-roots")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs`` (doc_id, text; other columns are not read).

    component_id is the smallest doc_id reachable over links. Without ``similarity`` texts link if
    their 64-bit fingerprints differ in at most ``radius`` bits; with it, if their sets of distinct
    shingles have that Jaccard similarity, exactly (fp is then a key of the set). Null, empty and
    wordless texts share one fp and are linked like any other; repeated rows and exact copies share
    one. A very long text is one row of its batch. A row with a null doc_id takes part and gets its
    component's smallest non-null doc_id (null if there is none). Empty tables give no rows.
    """
    with passing_tables(docs.sparkSession) as stays:
        rows, roots = labelled(docs, shingle, radius, similarity)
        points = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
        rooted = points.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
        least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
        ids = written(rooted.join(least, "root").select("fp", "component_id"), "simhash-ids")
        return stays(rows.join(ids, "fp").select("doc_id", "fp", "component_id"), "simhash-components")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates; same columns.

    Texts are near-duplicates if their SimHash fingerprints (as in near_duplicates()) differ in at most
    ``radius`` bits, by the vantage-point tree, or if their distinct shingles have that Jaccard similarity.

    The row with the smallest doc_id stays (null is last; of several texts of one doc_id, one by
    hash), and of rows that repeat it only one. Rows of one doc_id with unlike texts are of different
    groups, so each stays.
    """
    with passing_tables(docs.sparkSession) as stays:
        rows, roots = labelled(docs, shingle, radius, similarity, True)
        rows = rows.join(roots, "fp", "left").select("doc_id", "h", F.coalesce("root", "fp").alias("root"), F.struct(F.col("doc_id").isNull(), "doc_id", "h").alias("key"))
        least = rows.groupBy("root").agg(F.min("key").alias("least"))
        # null-safe: a key may hold a null doc_id
        rows = written(rows.join(least, "root").select("doc_id", "h", F.col("key").eqNullSafe(F.col("least")).alias("stays")), "duplicate-rows")
        gone = stays(rows.where("not stays").select(F.col("doc_id").alias("g_id"), F.col("h").alias("g_h")).distinct(), "duplicates-gone")
        repeated = rows.where("stays").groupBy("doc_id", "h").count().where("count > 1").select(F.col("doc_id").alias("g_id"), F.col("h").alias("g_h"))
        repeated = stays(repeated, "rows-repeated")
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")).alias("__key")
    keyed = docs.select(F.struct(*docs.columns).alias("__row"), key)
    same = F.col("__key.doc_id").eqNullSafe(F.col("g_id")) & (F.col("__key.h") == F.col("g_h"))
    kept = join_small(keyed, gone, same, "left_anti", BROADCAST_SETS)
    if repeated.limit(1).count():
        again = join_small(kept, repeated, same, "left_semi", BROADCAST_SETS).dropDuplicates(["__key"])
        kept = join_small(kept, repeated, same, "left_anti", BROADCAST_SETS).unionByName(again)
    return kept.select("__row.*")


def op3_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of documents."""
    rows = near_duplicates(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
