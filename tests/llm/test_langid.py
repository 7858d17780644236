"""Language ID: phrases and verdicts against a plain search, what is learned, and odd rows."""

from __future__ import annotations

import math
import random
import zlib

import pytest

from cinderframe.llm import langid

from .conftest import SYL, prose


def phrases_by_search(text, train):
    n = 0
    while text:
        k = next((k for k in range(1, len(text) + 1) if text[:k] not in train), len(text) + 1) - 1
        n, text = n + 1, text[max(1, k) :]
    return n


def mapped(m, codes):
    return "".join(chr(m.symbol[x]) for x in codes)


@pytest.mark.parametrize("segment,lanes", [(3, 8192), (17, 16), (50, 8192), (2048, 8192)])
def test_phrases_equal_a_search_whatever_the_segment(monkeypatch, segment, lanes):
    monkeypatch.setattr(langid, "SEGMENT", segment)
    monkeypatch.setattr(langid, "LANES", lanes)
    rng = random.Random(6)
    train = {k: prose(rng, 150, k) for k in SYL}
    m = langid.Model(train)
    texts = [prose(rng, n, k) for n in (0, 1, 3, 40, 90, 200) for k in SYL] + ["zzz日本zz", train["en"][:400] * 2, "zq" * 100]
    codes = [langid.folded(t) for t in texts]
    got = m.phrases(codes)
    for i, c in enumerate(codes):
        for j, lang in enumerate(m.langs):
            assert got[i, j] == phrases_by_search(mapped(m, c), mapped(m, map(ord, train[lang]))), (texts[i], lang)


def test_least_normalised_phrases_win():
    rng = random.Random(7)
    train = {"fr": prose(rng, 200, "fr"), "en": prose(rng, 90, "en")}
    m = langid.Model(train)
    texts = [prose(rng, n, k) for n in (1, 2, 5, 30) for k in SYL for _ in range(4)] + [None, "", "12 !", "q"]
    for t, (lang, score) in zip(texts, m.predict(texts)):
        c = langid.folded(t)
        if not len(c):
            assert (lang, score) == ("und", 0.0)
            continue
        need = {k: phrases_by_search(mapped(m, c), mapped(m, map(ord, v))) * math.log2(len(v)) for k, v in train.items()}
        best = min(sorted(need), key=need.get)
        assert lang == best and math.isclose(score, 1 - need[best] / max(need.values()), abs_tol=1e-12)


def test_language_id_predicts_held_out_rows(docs, none):
    texts = langid.training_texts(docs)
    assert {k for k, _ in texts} == {"en", "fr"}
    got = langid.identify(docs, texts).collect()
    rows = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 60 and len(r["text"]) > 30]
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.95 * len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (102, 103, 104, 107)) and all(0 <= r["score"] <= 1 for r in got)
    kept = langid.drop_unidentified(docs)
    assert kept.columns == docs.columns and kept.count() == len(got) - 4
    assert langid.identify(none, langid.training_texts(none)).count() == 0 and langid.training_texts(none) == ()
    unlabelled = docs.withColumn("lang", langid.F.lit(None).cast("string"))
    assert langid.drop_unidentified(unlabelled).count() == len(got) - 4


def test_sample_is_full_in_order_of_hash_and_cut_at_the_bound(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.choice([1, 1, 2, 60])), "en") for i in range(3000)]
    rows += [(5000 + i, "1234567890 " * 40 + "eau", "fr") for i in range(40)] + [(9000, prose(rng, 9000), "de"), (9001, "x", None), (None, "yy", "zz"), (9003, None, "en"), (9004, "12", "num")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learn = [(i, t, k) for i, t, k in rows if None not in (i, t, k) and zlib.crc32(str(i).encode()) % 3 != 1]
    hashes = {r["doc_id"]: r["h"] % 2**64 for r in d.selectExpr("doc_id", "xxhash64(doc_id) as h").collect()}
    got = dict(langid.training_texts(d, 2000))
    for lang in {k for _, _, k in learn} - {"num"}:
        mine = sorted((hashes[i], i, t) for i, t, k in learn if k == lang)
        want = "".join("".join(map(chr, langid.folded(t)[:2000])) for _, _, t in mine)[:2000]
        assert got[lang] == want, lang
    assert set(got) == {k for _, _, k in learn} - {"num"} and len(got["en"]) == 2000


def test_query_gives_booleans_for_null_ids_and_own_columns_win(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = langid.op5_language_id(spark, str(tmp_path)).collect()
    want = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in (r["doc_id"] for r in got) if i is not None}
    assert all(r["held_out"] is want.get(r["doc_id"], False) for r in got)
    odd = docs.selectExpr("doc_id", "text", "'x' as lang_pred", "1 as score")
    out = langid.identify(odd, langid.training_texts(docs))
    assert sorted(out.columns) == sorted(odd.columns) and out.where("lang_pred = 'x'").count() == 0
