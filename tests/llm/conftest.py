"""Small documents with the usual odd cases: nulls, empty and long texts, copies, repeated rows."""

from __future__ import annotations

import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, base string, row string, window string, k int"
SYL = {"en": "th he in er an re on at nd st".split(), "fr": "le ou ai eu qu eau ion ment é ç".split()}


def prose(rng, n, lang="en"):
    return " ".join("".join(rng.choices(SYL[lang], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(60):
        lang = "fr" if i % 3 == 0 else "en"
        out.append((i, prose(rng, rng.randint(1, 120), lang), lang, f"s{i % 4}" if i % 7 else None))
    out += [(100, out[5][1], "en", "s1"), (101, out[5][1] + " x", "en", "s1"), (7, out[7][1], out[7][2], out[7][3])]
    out += [(102, None, "en", "s0"), (103, "", None, "s0"), (104, " \n\t ", "en", None), (105, "é" * 30, "fr", "s2"), (None, "the and of", "en", "s9")]
    out += [(106, prose(rng, 4000), "en", "s0"), (107, "123 456 !!", "en", "s0")]
    return [(*r, len(r[1] or ""), "b", "r", "w", 1) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)
