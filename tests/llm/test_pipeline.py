"""The corpus pipeline from end to end against a brute-force chain of its stages."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from cinderframe.llm import mixing, simhash
from cinderframe.llm.tokens import tokenizer_path

from .conftest import DOC, prose


def one_of_each_group(rows, hashes):
    """Rows by the exact similarity of their shingles, one of each component."""
    sets = [simhash.shingles(r[1], 5) for r in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    best: dict = {}
    for r, c in zip(rows, root):
        key = (r[0] is None, r[0] or 0, hashes[r[1]])
        if c not in best or key < best[c][0]:
            best[c] = (key, r)
    return [r for _, r in best.values()]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({i: i + 32 for i in range(65, 91)}))


def clean_of(rows, items):
    """Rows that hold no run of ten words, or all words, of an item."""
    windows = set()
    for t in items:
        w = words(t or "")
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    lengths = {len(x) for x in windows}
    out = []
    for r in rows:
        w = words(r[1])
        if not any(tuple(w[i : i + n]) in windows for n in lengths for i in range(len(w) - n + 1)):
            out.append(r)
    return out


def mixed(rows, u):
    """Rows as often as a plain Pareto sample of each source takes them; u: key's uniform by row."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows]
    by: dict = {}
    for r, n in zip(rows, size):
        by.setdefault(r[3], []).append((r, n))
    order = sorted((s for s in by if s is not None)) + [s for s in by if s is None]
    weight = {s: float(mixing.WEIGHTS[i % 3]) for i, s in enumerate(order)}
    total = {s: sum(n for _, n in x) for s, x in by.items()}
    left, target, free = float(sum(size)), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 3 * total[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
        free -= over
    out = []
    for s, mine in by.items():
        whole = int(target[s] / total[s] + 1e-12)
        rest, have, extra = target[s] - whole * total[s], 0, set()
        sizes = sorted((n for _, n in mine), reverse=True)
        for k in range(len(sizes)):
            s2 = sum(float(x) * x for x in sizes[k:])
            c = (rest - sum(float(x) for x in sizes[:k])) / s2
            if c * sizes[k] < 1:
                break
        p = [min(1.0, c * n) for _, n in mine]
        odds = [0.0 if q >= 1 else u[r] / (1 - u[r]) / (q / (1 - q)) if q > 0 else float("inf") for (r, _), q in zip(mine, p)]
        if rest > 1e-9:
            for i in sorted(range(len(mine)), key=lambda i: odds[i]):
                if have + mine[i][1] - rest > rest - have:
                    break
                have += mine[i][1]
                extra.add(i)
        for i, (r, _) in enumerate(mine):
            out += [r] * (whole + (i in extra))
    return out


def test_pipeline_is_its_stages_one_by_one(spark, rows, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = random.Random(13)
    long = prose(rng, 300).split()
    more = [(200 + i, " ".join(long[: 300 - i] + prose(rng, i + 1).split()), "en", "s1") for i in (0, 3, 20, 60, 150)]
    more += [(300, "intro " + " ".join(rows[11][1].split()[:30]) + " outro " + prose(rng, 60), "en", "s2"), (None, prose(rng, 70), "en", "s9"), (7, prose(rng, 50), "en", "s3")]
    data = [*rows, *[(*r, len(r[1]), "b", "r", "w", 1) for r in more]]
    docs = spark.createDataFrame(data, DOC)
    items = [" ".join(rows[11][1].split()[:14]), rows[10][1], None]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    u = {(r["doc_id"], r["text"]): r["u"] for r in docs.select("doc_id", "text", mixing.uniform(mixing.SEED, mixing.row_key()).alias("u")).collect()}
    kept = [r for r in data if r[1] and any(c.isalpha() for c in r[1])]
    kept = one_of_each_group(kept, hashes)
    kept = clean_of(kept, items)
    keyed = {r: u[r[0], r[1]] for r in kept}
    kept = mixed(kept, keyed)
    tk = Tokenizer.from_file(tokenizer_path())
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]], r[1]))
    want, at = [], 0
    for r in kept:
        ids = np.array([*tk.encode(r[1], add_special_tokens=False).ids, 2], "<u4")
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want and want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mix_sources", "token_ids"]


def test_parity_bits_let_every_similar_pair_pass(spark):
    """Pairs at and around the limit, of sets with fewer and many more shingles than bits."""
    rng = np.random.default_rng(5)
    data, alike = [], []
    for n in (1, 2, 5, 9, 40, 200, 900, 5000, 60000):
        for share in (0.0, 0.3, 0.6, 0.75, 0.79, 0.8, 0.801, 0.85, 0.95, 1.0):
            for _ in range(4):
                whole = np.unique(rng.integers(0, 2**63, 2 * n + 4, dtype=np.uint64))
                both = round(share * n)
                only = n - both if rng.random() < 0.5 else 2 * (n - both)
                a = whole[:n]
                b = np.concatenate((whole[:both], whole[n : n + only])) if rng.random() < 0.5 else whole[: max(1, both)]
                j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
                alike.append(j)
                data.append((len(alike) - 1, *[(len(h), *map(int, simhash.parities(h))) for h in (a, b)]))
    of = "struct<n: long, " + ", ".join(f"w{i}: long" for i in range(simhash.PARITY_WORDS)) + ">"
    pairs = spark.createDataFrame(data, f"i int, a {of}, b {of}")
    passed = {r["i"] for r in pairs.where(simhash.likely("a", "b", 0.8)).select("i").collect()}
    assert {i for i, j in enumerate(alike) if j >= 0.8} <= passed
    far = [i for i, j in enumerate(alike) if j < 0.65 and 9 <= data[i][1][0] <= 900]
    assert len(far) > 50 and not passed & set(far)


def test_stages_take_empty_tables_and_keep_columns(spark, none, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0 and (name == "token_ids" or out.columns == docs.columns), name
