"""The training-data operators against brute force on small tables, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderframe.llm import decontaminate, mixing, quality, simhash, token_counts
from cinderframe.llm.common import written
from cinderframe.llm.tokens import ChunkEncoder, tokenizer_path

from .conftest import DOC, prose

def components_of(n, linked):
    root = list(range(n))
    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


# -- 1 quality ---------------------------------------------------------------


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] is not None and r[0] < 60] + [(None, 1, 0), (7, 0, None)], "doc_id long, quality int, toxic int")


def test_quality_sorts_noise_from_prose_and_all_paths_agree(spark, docs, labels, none):
    rng = random.Random(5)
    noise = spark.createDataFrame([(900 + i, "".join(rng.choices("QZXJ#%&0987", k=200)), "en", "s", 200, "b", "r", "w", 1) for i in range(5)], DOC)
    both = docs.unionByName(noise)
    a = {tuple(r) for r in quality.classify(both, labels).collect()}
    b = {tuple(r) for r in quality.classify(both, labels, broadcast_types=0).collect()}
    c = {tuple(r) for r in quality.classify(both, labels, broadcast_types=900).collect()}
    key = lambda s: sorted((str(x[0]), x[1] or "", x[2], None if x[3] is None else round(x[3], 4), x[5]) for x in s)
    assert key(a) == key(b) == key(c)
    for lang in ("en", "fr"):
        held = sorted(r[3] for r in a if r[1] == lang and r[0] is not None and r[0] < 60 and zlib.crc32(str(r[0]).encode()) % quality.HELD_OUT == 0)
        assert {r[4] for r in a if r[1] == lang} == {held[math.ceil(quality.QUANTILE * len(held)) - 1]}
        assert all(r[5] == (r[3] is None or r[3] <= r[4]) for r in a if r[1] == lang)
    keep = {r[0]: r[5] for r in a}
    assert all(not keep[900 + i] for i in range(5)) and all(keep[i] for i in range(60)) and keep[102] and keep[103]
    assert quality.classify(none, labels).count() == 0
    assert all(r["keep"] and r["perplexity"] is None for r in quality.classify(docs, labels.limit(0)).collect())


def test_quality_probabilities_match_a_direct_model(spark):
    texts = ["abracadabra abra", "cadabra abracad", "banana bandana"]
    chars = sorted({c for t in texts for c in t})
    table = quality.numbering([ord(c) for c in chars])
    counts: dict = {}
    for t in texts:
        for g in quality.grams([t], table)[0].tolist():
            counts[g] = counts.get(g, 0) + 1
    types = spark.createDataFrame([("x", g, c) for g, c in counts.items()] + [("x", 123, 0)], "lang string, g long, c long")
    got = {r["g"]: r["logp"] for r in quality.log_probabilities(types).collect()}
    levels = {quality.ORDER: counts}
    for k in range(quality.ORDER - 1, 0, -1):
        low: dict = {}
        for g in levels[k + 1]:
            low[g & quality.MASK[k]] = low.get(g & quality.MASK[k], 0) + 1
        levels[k] = low

    def p(g, k):
        if k == 0:
            return 1 / (len(levels[1]) + 1)
        c = levels[k]
        n = [sum(v == i for v in c.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        d = [0.0] * 4
        for i, default in ((1, 0.5), (2, 1.0), (3, 1.5)):
            more = n[i + 1] if i < 4 else 0
            d[i] = default if y is None or not n[i] else min(float(i), max(0.0, i - (i + 1) * y * more / n[i]))
        mine = {h: v for h, v in c.items() if h >> quality.BITS == g >> quality.BITS}
        low = p(g & quality.MASK[k - 1], k - 1)
        if not mine:
            return low
        total, off = sum(mine.values()), sum(d[min(v, 3)] for v in mine.values())
        return (mine[g] - d[min(mine[g], 3)] if g in mine else 0) / total + off / total * low

    for g in [*counts, 123]:
        assert math.isclose(got[g], math.log(p(g, quality.ORDER)), rel_tol=1e-5), g


# -- 2 token counts ----------------------------------------------------------


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_match_token_by_token(spark, docs, rows, rule, none):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path())
    text = "ab cd\n\nef gh日本\n\n\nxyz"
    cut = [(0, 4), (4, 9), (12, 20)]
    d = spark.createDataFrame([(1, text, [{"start": a, "end": b} for a, b in cut]), (2, None, None), (3, "word", [])], "doc_id long, text string, s array<struct<start:long,end:long>>")
    got = {(r["doc_id"], r["section"]): r["n_tokens"] for r in token_counts.attribute_tokens(d, sections="s", rule=rule).collect()}
    want: dict = {(1, i): 0 for i in range(3)}
    for a, b in tk.encode(text, add_special_tokens=False).offsets:
        over = [max(0, min(b, y) - max(a, x)) for x, y in cut]
        at = {"largest": int(np.argmax(over)) if max(over) else -1, "start": next((i for i, (x, y) in enumerate(cut) if x <= a < y), -1), "end": next((i for i, (x, y) in enumerate(cut) if x < b <= y), -1)}[rule]
        want[1, at] = want.get((1, at), 0) + 1
    want[3, -1] = 1
    assert got == want
    lines = token_counts.attribute_tokens(docs, rule=rule)
    total = {}
    for r in lines.collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
    for r in rows:
        if r[0] not in (None, 7) and r[1]:
            assert total[r[0]] == len(tk.encode(r[1], add_special_tokens=False).ids)
    assert token_counts.attribute_tokens(none).count() == 0


def test_chunk_encoder_equals_the_library():
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path())
    ids, spans = ChunkEncoder(tokenizer_path()), ChunkEncoder(tokenizer_path(), spans=True)
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice([" ", "\n", "a", "é", "'s", "1", "!", "\t", " ", "日", "<|endoftext|>", "\r", " b", "\x85"]) for _ in range(rng.randint(0, 12)))
        e = tk.encode(t, add_special_tokens=False)
        assert np.frombuffer(ids.ids(t), ids.dtype).tolist() == e.ids and spans.offsets(t).tolist() == [list(p) for p in e.offsets], repr(t)


def test_lines_begin_words_of_their_own():
    from tokenizers import Tokenizer

    tk, enc = Tokenizer.from_file(tokenizer_path()), ChunkEncoder(tokenizer_path())
    rng = random.Random(2)
    parts = ["the", "Le", "é", "an's", "'s", "x&&&", "a.b", "12", "%$", "'", "don't!!", "ñó.", "_", "\t", "\n", "日本"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) + rng.choice([" ", "\n", "\n", ""]) for _ in range(rng.randint(1, 9)))
        assert np.frombuffer(enc.ids(t), enc.dtype).tolist() == tk.encode(t, add_special_tokens=False).ids, repr(t)
    enc.ids("one two.\nThen more")
    assert {"two.", "\nThen"} <= enc.known.new.keys() and "two.\nThen" not in enc.known.new


# -- 3 near-duplicates ---------------------------------------------------------


def test_simhash_components_match_all_pairs(spark, docs, rows, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fp = [simhash.fingerprint(r[1]) for r in rows]
    root = components_of(len(rows), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    low = {}
    for r, c in zip(rows, root):
        if r[0] is not None:
            low[c] = min(low.get(c, 1 << 60), r[0])
    want = sorted((str(r[0]), f, low.get(c)) for r, f, c in zip(rows, fp, root))
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64, r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0


def test_vantage_point_shards_lose_no_pair(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 400, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 4), replace=False))) for b in base.repeat(5)]
    fp = np.unique(np.concatenate((base, np.array(near, np.uint64))))
    points = written(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long"), "t")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.near_pairs(points, 2, sample=500, shard=64)).collect()}
    want = components_of(len(fp), lambda a, b: int(fp[a] ^ fp[b]).bit_count() <= 2)
    got = [roots.get(int(x), int(x)) for x in fp.view(np.int64)]
    assert len({*zip(want, got)}) == len(set(want)) == len(set(got))


def test_similar_texts_go_and_repeated_rows_count_once(spark, docs, rows):
    rng = random.Random(9)
    words = prose(rng, 400).split()
    other = words[:]
    other[200] = "changed"
    more = spark.createDataFrame([(500, " ".join(words), "en", "s", 1, "b", "r", "w", 1), (501, " ".join(other), "en", "s", 1, "b", "r", "w", 1)], DOC)
    kept = simhash.drop_near_duplicates(docs.unionByName(more))
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and 500 in ids and 501 not in ids and 5 in ids and 100 not in ids
    assert ids.count(7) == 1 and ids.count(None) == 1 and [102 in ids, 103 in ids, 104 in ids].count(True) == 1


def test_similar_texts_are_exactly_those_of_the_jaccard_limit(spark):
    rng = random.Random(11)
    texts, common = [], prose(rng, 40)
    for i in range(24):
        words = prose(rng, rng.randint(12, 160)).split()
        for _ in range(8):  # around the limit, on either side
            other = words[:]
            for at in rng.sample(range(len(words)), rng.randint(0, max(1, len(words) // 25))):
                other[at] = prose(rng, 1)
            texts.append(" ".join(other[: rng.randint(len(words) * 4 // 5, len(words))]))
        texts.append(f"{common} {' '.join(words)}")
    sets = [simhash.shingles(t, 5) for t in texts]
    want = components_of(len(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(d, 5, similarity=0.8).collect()}
    assert [got[i] for i in range(len(texts))] == want and 24 < len(set(want)) < len(texts)


def test_near_copies_make_pairs_in_proportion_and_few_points_reach_the_driver(spark, monkeypatch):
    rng, seen, tree = random.Random(4), [], []
    words = prose(rng, 60).split()
    texts = [" ".join([*words[:i], "x" * (1 + k), *words[i + 1 :]]) for k in range(4) for i in (*range(2), *range(57, 60))]
    texts += [" ".join([*words, f"end{k}"]) for k in range(180)] + [prose(rng, 60) for _ in range(200)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    exact = simhash.exact_jaccard
    monkeypatch.setattr(simhash, "exact_jaccard", lambda pairs, *a: seen.append(pairs.count()) or exact(pairs, *a))
    got = simhash.near_duplicates(d, 5, similarity=0.8).collect()
    assert {r["component_id"] for r in got if r["doc_id"] < 200} == {0} and len({r["component_id"] for r in got}) == 201
    assert sum(seen) < 20 * len(texts)
    build = simhash.build_tree
    monkeypatch.setattr(simhash, "build_tree", lambda points, leaf: tree.append(len(points)) or build(points, leaf))
    points = written(spark.range(2000).selectExpr("xxhash64(id) as fp"), "t")
    simhash.near_pairs(points, 2)
    assert tree and tree[0] <= 250


def test_a_text_and_its_doubled_text_are_near_duplicates(spark):
    rng = random.Random(5)
    text, other = prose(rng, 120), prose(rng, 120)
    d = spark.createDataFrame([(1, text), (2, f"{text} {text}"), (3, f"{text} {text} {text}"), (4, other)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(d).collect()) == [1, 4]


def test_the_pipeline_drops_what_the_tree_links_beside_the_jaccard_limit(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    refrain = " ".join([prose(rng, 40)] * 30)  # repeats rule the fingerprint, distinct shingles don't
    texts = [f"{refrain} {prose(rng, 12)}" for _ in range(6)] + [prose(rng, 80) for _ in range(6)]
    words = texts[6].split()
    texts += [" ".join([*words[:-6], *prose(rng, 6).split()])]  # alike by shingles, apart by fingerprints
    fp, sets = [simhash.fingerprint(t) for t in texts], [simhash.shingles(t, 5) for t in texts]
    near = lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2
    like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert any(near(a, b) and not like(a, b) for a in range(6) for b in range(a)) and like(6, 12) and not near(6, 12)
    want = components_of(len(texts), lambda a, b: near(a, b) or like(a, b))
    rows = [(i, t, "en", "s", len(t), "b", "r", "w", 1) for i, t in enumerate(texts)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOC), str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(want))


def test_long_sets_are_thinned_by_more_parity_bits_and_lose_no_pair(spark):
    rng, words = np.random.default_rng(8), []
    for n in (2_000, 4_000, 16_000, 30_000):
        whole = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        words += [(whole[:n], whole[: n * 9 // 10]), (whole[:n], np.concatenate((whole[: n * 89 // 100], whole[n : n + n * 11 // 100]))), (whole[:n], whole[n:])]
    wide = [(2 * i + k, bytearray(simhash.wide_parities(h))) for i, pair in enumerate(words) for k, h in enumerate(pair)]
    pairs = written(spark.createDataFrame([(2 * i, 2 * i + 1, i % 3) for i in range(len(words))], "a long, b long, part long"), "t")
    got = {r["a"] // 2 for r in simhash.likely_long(pairs, spark.createDataFrame(wide, "fp long, wide binary"), 0.8).collect()}
    alike = {i for i, (a, b) in enumerate(words) if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))}
    assert alike <= got and len(alike) == 8 and not {2, 5, 8, 11} & got and simhash.wide_parities(words[0][0][: simhash.LONG - 1]) is None


# -- 6 decontamination -------------------------------------------------------------


def test_contamination_matches_windows_one_by_one(spark, docs, rows, none):
    rng = random.Random(12)
    long = prose(rng, 40).split()
    items = [(1, " ".join(long)), (2, "Only Three words"), (3, None), (4, " .,! "), (5, "rare"), (10, rows[8][1]), (11, "the the the the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    extra = [(700, "x " + " ".join(long[5:17]).upper() + ". y"), (701, "only  three, WORDS only three words"), (702, " ".join(long[:9])), (703, "the the the the the"), (704, "É rare-É"), (701, "only three words")]
    more = spark.createDataFrame([(i, t, "en", "s", 1, "b", "r", "w", 1) for i, t in extra], DOC)
    both = docs.unionByName(more)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    windows: dict = {}
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    want = []
    for r in both.collect():
        w, hit, found = split(r["text"]), set(), set()
        for x, ids in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    found |= ids
        want.append((str(r["doc_id"]), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    for block in (1_000_000, 5):
        got = decontaminate.contamination(both, bench)
        assert set(docs.columns) - {"text"} < set(got.columns)
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got.collect()) == sorted(want)
    clean = decontaminate.drop_contaminated(both, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not x[5] for x in want)
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_benchmark_blocks_change_nothing(spark, docs, rows):
    bench = spark.createDataFrame([(i, rows[i][1]) for i in range(10)], "item_id long, text string")
    d = docs.select(decontaminate.row_key().alias("rid"), "text")
    a = decontaminate.occurrences(d, bench).distinct().collect()
    b = decontaminate.occurrences(d, bench, block=7).distinct().collect()
    assert {tuple(x) for x in a} == {tuple(x) for x in b} and a


# -- 9 mixing ---------------------------------------------------------------------------


def water(sizes, weights=(5, 2, 1), cap=3):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: float(weights[i % 3]) for i, s in enumerate(order)}
    left, target, free = float(sum(sizes.values())), {}, set(order)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level >= cap * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in free}
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        free -= over
    return target


def test_targets_and_takes(spark, docs, rows, none):
    rng = random.Random(8)
    many = [(i, " ".join("w" * 1 for _ in range(rng.randint(1, 30))), "en", rng.choice(["a", "a", "a", "b", "c", "é", None]), 1, "b", "r", "w", 1) for i in range(2000)]
    for data in (rows, many):
        d = spark.createDataFrame(data, DOC)
        sizes = written(mixing.slim_sizes(d), "s")
        plan = {r["src"]: r for r in mixing.sampling_plan(sizes).collect()}
        by: dict = {}
        for r in data:
            by[r[3]] = by.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        want = water(by)
        assert {s: r["source_size"] for s, r in plan.items()} == by
        assert all(math.isclose(plan[s]["target"], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in by)
        rows_out = mixing.with_plan(sizes, spark.createDataFrame(list(plan.values()), "src string, source_size long, target double, whole long, c double, q_cut double, key_cut long"))
        taken: dict = {}
        for r in rows_out.select("src", "size", mixing.copies(F.col("size"), F.col("key")).alias("k")).collect():
            assert 0 <= r["k"] <= 3
            taken[r["src"]] = taken.get(r["src"], 0) + r["k"] * r["size"]
        most = max(len(re.findall(r"\S+", r[1] or "")) for r in data)
        assert all(abs(taken[s] - want[s]) <= 2 * most for s in by)
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.where("trim(text) = '' or text is null").count() == 0
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix(docs.orderBy(F.rand())).collect()))
    assert mixing.mix(none).count() == 0


def test_takes_are_those_of_a_plain_ranking_and_null_ids_count(spark):
    rng = random.Random(18)
    data = [(None if i % 3 else i, " ".join(["w", str(i), *"v" * rng.randint(0, 40)]), rng.choice("aaab")) for i in range(900)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string")
    sizes = written(mixing.slim_sizes(d), "s")
    for bins in (4096, 3):
        plan = written(mixing.sampling_plan(sizes, bins=bins), "p")
        u = mixing.uniform(mixing.SEED, F.col("key"))
        rows = mixing.with_plan(sizes, plan).select("src", "key", "size", "target", "source_size", "whole", "c", u.alias("u"), mixing.copies(F.col("size"), F.col("key")).alias("k")).collect()
        for src in "ab":
            mine = [r for r in rows if r["src"] == src]
            rest = mine[0]["target"] - mine[0]["whole"] * mine[0]["source_size"]
            if rest <= 0:
                assert all(r["k"] == r["whole"] for r in mine)
                continue
            odds = lambda r: 0.0 if r["c"] * r["size"] >= 1 else r["u"] / (1 - r["u"]) / (r["c"] * r["size"] / (1 - r["c"] * r["size"]))
            total, want = 0, set()
            for r in sorted(mine, key=lambda r: (odds(r), r["key"])):
                if total + r["size"] - rest > rest - total:
                    break
                total += r["size"]
                want.add(r["key"])
            assert {r["key"] for r in mine if r["k"] > r["whole"]} == want and want
            assert abs(total - rest) <= 42


def test_word_count_cuts_at_ascii_blanks_only(spark):
    texts = [None, "", " ", "a", " a ", "a b c", "\ta\x0bb\x0c\n", "a  b", "\n"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", mixing.word_count(F.col("t")).alias("n"))
    assert {r["i"]: r["n"] for r in d.collect()} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
