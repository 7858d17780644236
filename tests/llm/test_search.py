"""Ranked search against scoring every document, and the wavelet tree's bounds."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

from cinderframe.llm import search
from cinderframe.llm.search import DualSorted

from .conftest import DOC

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, tf, _ in held for t in tf)
    out = {}
    for item, text in items:
        found = []
        for d, tf, size in held:
            m = 50 + 50 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1_000 * tf[t] + 20 * m)) for t in set(terms(text)) if tf[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out[item] = [(None if x[1] else x[2], -x[0]) for x in sorted(found)[:k]]
    return out


def test_search_equals_scoring_every_document(spark, rows, docs):
    items = [(i, r[1]) for i, r in enumerate(rows[:6])] + [(50, "The THE and, é1"), (51, None), (52, " ... "), (53, "zzzzzz"), (None, "the")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute([r[:2] for r in rows], [x for x in items if x[0] is not None], 7)
    for kw in ({}, {"shard_docs": 5}, {"terms_a_scan": 20, "queries_a_task": 2}):
        got = search.search(docs, table, 7, **kw).collect()
        assert {i: [(r["doc_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["item_id"] == i] for i, _ in items if i is not None} == want
        assert all(sorted(r["rank"] for r in got if r["item_id"] == i) == list(range(1, len(w) + 1)) for i, w in want.items())


def test_search_of_empty_sides_and_equal_rows(spark, docs, none):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.search(none, items).count() == 0 and search.search(docs, items.limit(0)).count() == 0
    same = spark.createDataFrame([(5, "a b"), (5, "a b"), (4, "a b"), (9, "c"), (None, "a b")], "doc_id long, text string")
    assert [r["doc_id"] for r in search.search(same, items).orderBy("rank").collect()] == [4, 5, 5, None]
    many = spark.createDataFrame([(i, "c" if i > 4 else "a b") for i in range(20)] + [(None, "a b"), (3, "a b")], "doc_id long, text string")
    assert [r["doc_id"] for r in search.search(many, items).orderBy("rank").collect()] == [0, 1, 2, 3, 3, 4, None]


def test_top_of_the_tree_is_exact_and_visits_few_nodes(monkeypatch):
    rng = np.random.default_rng(2)
    docs, n = 3_000, 60_000
    at = rng.choice(40 * docs, n, replace=False)
    term, doc = at // docs, at % docs
    impact = rng.integers(1, 1_000, n)
    tree = DualSorted(term, doc, impact, docs)
    visited = []
    for k in (1, 10, 5_000):
        wanted, weights = np.array([3, 7, 39, 77]), np.array([900, 10, 40, 5])
        score = np.zeros(docs, np.int64)
        for t, w in zip(wanted, weights):
            np.add.at(score, doc[term == t], w * impact[term == t])
        count = [0]
        kept = search.Bits.ones
        monkeypatch.setattr(search.Bits, "ones", lambda self, upto, c=count: (c.__setitem__(0, c[0] + upto.size), kept(self, upto))[1])
        found, scores = tree.top(wanted, weights, k, nodes=16)
        monkeypatch.setattr(search.Bits, "ones", kept)
        visited.append(count[0])
        order = sorted(np.flatnonzero(score > 0), key=lambda d: (-score[d], d))[:k]
        assert list(zip(found[:k].tolist(), scores[:k].tolist())) == [(d, score[d]) for d in order]
    assert visited[0] < visited[1] < visited[2] / 4
