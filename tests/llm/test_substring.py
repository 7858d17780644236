"""Substring dedup and its FM-index against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from cinderframe.llm import substring
from cinderframe.llm.fm_index import FMIndex, WaveletMatrix

from .conftest import DOC, prose


def test_wavelet_matrix_counts_values_before_a_position():
    rng = np.random.default_rng(4)
    for n in (0, 1, 63, 64, 65, 1000):
        sequence = rng.integers(0, 37, n)
        w = WaveletMatrix(sequence, 6)
        values, upto = rng.integers(0, 37, 50), rng.integers(0, n + 1, 50)
        got = w.places(values, upto) - w.places(values, np.zeros(50, np.int64))
        assert got.tolist() == [int((sequence[:p] == v).sum()) for v, p in zip(values, upto)]


def test_matching_statistics_equal_a_direct_search():
    rng = np.random.default_rng(1)
    for _ in range(8):
        segments = [rng.integers(1, 4, rng.integers(1, 40)) for _ in range(15)]
        index = FMIndex(segments, 5, 7)
        patterns = [rng.integers(0, 6, rng.integers(0, 50)) for _ in range(8)] + segments[:2]
        ends = np.cumsum([len(p) for p in patterns])
        starts = ends - np.array([len(p) for p in patterns])
        length, row = index.matching_statistics(np.concatenate(patterns), starts, ends)
        for p, s in zip(patterns, starts):
            for i in range(len(p)):
                held = [k for g in segments for j in range(len(g)) for k in range(8) if p[i : i + k].tolist() == g[j : j + k].tolist()[:k] and len(p[i : i + k]) == k]
                assert length[s + i] == max(held)
                at = index.sa[row[s + i]]
                assert (index.text[at : at + max(held)] == p[i : i + max(held)]).all()


def brute(rows, window=substring.WINDOW):
    """{(doc_id, text): (n_words, n_removed, kept text)} by comparing every window with all earlier ones."""
    order = sorted({(r[0], r[1]) for r in rows}, key=lambda x: (x[0] is None, x[0] or 0))
    first, out = {}, {}
    for key in order:
        words = (key[1] or "").encode().split()
        for j in range(len(words) - window + 1):
            first.setdefault(b" ".join(words[j : j + window]), (key, j))
        gone = set()
        for j in range(len(words) - window + 1):
            if first[b" ".join(words[j : j + window])] != (key, j):
                gone.update(range(j, j + window))
        out[key] = (len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode())
    return out


@pytest.fixture(scope="module")
def repeating(rows):
    rng = random.Random(8)
    passage, line = prose(rng, 70), prose(rng, 12)
    out = [r[:2] for r in rows]
    out += [(200 + i, f"{prose(rng, rng.randint(0, 40))} {passage}\t{prose(rng, rng.randint(0, 30))}") for i in range(25)]
    out += [(300, f"{line}\n" * 9), (301, "la " * 200), (302, passage), (303, "x" * 50_000 + " " + passage), (-5, passage[: len(passage) // 2])]
    out += [(304, "Qué  é " * 30), (305, prose(rng, 19)), (305, prose(rng, 19)), (306, passage), (306, passage)]
    return [(*r, None, "s", None, "b", "r", "w", 1) for r in out]


@pytest.mark.parametrize(("shard_chars", "hot"), [(2_000_000, 1_024), (3_000, 4)])
def test_repeats_equal_brute_force_for_any_shards(spark, repeating, shard_chars, hot):
    docs = spark.createDataFrame(repeating, DOC)
    got = substring.remove_repeats(docs, shard_chars, hot)
    assert got.columns == [*docs.columns, "n_words", "n_removed", "kept_text"]
    found = got.collect()
    want = brute(repeating)
    assert len(found) == len(repeating)
    assert all(tuple(r[-3:]) == want[r["doc_id"], r["text"]] and (r["base"], r["k"]) == ("b", 1) for r in found)
    assert sum(r["n_removed"] for r in found) > 1_000


def test_repeats_of_nothing_and_of_nulls(spark, none):
    assert substring.remove_repeats(none).count() == 0
    rows = [(None, "a b c " * 20), (1, None), (2, "a b c " * 20), (3, "")]
    found = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in found} == {None: (60, 60), 1: (0, 0), 2: (60, 57), 3: (0, 0)}
