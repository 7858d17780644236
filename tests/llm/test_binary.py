"""Token-ID output: round trip, keyed access, and the index that both go through."""

from __future__ import annotations

import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderframe.llm import binary
from cinderframe.llm.tokens import tokenizer_path
from cinderframe.sources.scratch import SHUFFLES_GO


def test_shards_round_trip_and_keyed_access(spark, docs, rows, none):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path())
    from cinderframe.llm.common import fresh_path

    folder = fresh_path(spark, "ids")
    manifest = binary.write_shards(docs, folder, tokenizer_path(), shard_rows=13)
    got = binary.read_shards(manifest, folder, block=500).orderBy("start").collect()
    ids = {}
    for r in rows:
        ids.setdefault(r[0], []).append([*tk.encode(r[1] or "", add_special_tokens=False).ids, 2])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0)) and manifest.count() > 2
    at = 0
    for r in got:
        assert r["start"] == at and r["ids_crc32"] in {zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids[r["doc_id"]]}
        at += r["n_tokens"]
    keys = spark.createDataFrame([(i,) for i in (0, 7, 59, 106, 5000, -4)] + [(None,)], "doc_id long")
    found = sorted((r["doc_id"], tuple(r["ids"])) for r in binary.lookup(manifest, folder, keys).collect())
    assert found == sorted((i, tuple(x)) for i in (0, 7, 59, 106) for x in ids[i])
    assert found == sorted((r["doc_id"], tuple(r["ids"])) for r in binary.lookup(manifest, folder, keys, bounds=2).collect())
    assert binary.token_output(none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 5, 3000])
def test_hash_index_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    shift, slot, prints = binary.build_index(keys)
    assert sorted(slot.tolist()) == list(range(len(keys))) and len(prints) == len(keys)
    if n:
        assert (binary.find_slots(keys, shift, len(keys)) == slot).all()


def test_displacements_are_tried_together(monkeypatch):
    calls, mix = [], binary.mix64
    monkeypatch.setattr(binary, "mix64", lambda *a: calls.append(1) or mix(*a))
    keys = np.unique(np.random.default_rng(7).integers(0, 10**7, 3000))
    shift, slot, _ = binary.build_index(keys)
    assert len(calls) < 3 * len(shift), "one at a time they are hundreds a bucket"
    monkeypatch.undo()
    h1, h2 = mix(keys[:3].view(np.uint64), 1) % np.uint64(200), mix(keys[:3].view(np.uint64), 2) | np.uint64(1)
    taken = np.random.default_rng(1).random(200) < 0.9
    got, at = binary.free_displacement(h1, h2, taken)
    with np.errstate(over="ignore"):
        tried = [((h1 + mix(h2, d + 3)) % np.uint64(200)).astype(int).tolist() for d in range(got + 1)]
    fits = [len(set(x)) == 3 and not taken[x].any() for x in tried]
    assert fits == [False] * got + [True] and at.tolist() == tried[-1] and got > binary.TRIES[0]


def test_reading_back_goes_through_the_index(spark, docs):
    from cinderframe.llm.common import fresh_path

    folder = fresh_path(spark, "ids")
    manifest = binary.write_shards(docs.where("doc_id < 40"), folder, tokenizer_path())
    right = sorted(map(tuple, binary.read_shards(manifest, folder).collect()))
    path = Path(folder.removeprefix("file://")) / "shard-00000.idx"
    s = binary.Shard(folder, 0)
    raw = bytearray(path.read_bytes())
    first = 64 + s.shift.nbytes + s.prints.nbytes
    one, two = (bytes(raw[first + 4 * i : first + 4 * i + 4]) for i in (0, 1))
    raw[first : first + 8] = two + one  # two slots that name each other's record
    path.write_bytes(raw)
    wrong = sorted(map(tuple, binary.read_shards(manifest, folder).collect()))
    assert [r[0] for r in wrong] == [r[0] for r in right] and wrong != right
    raw[64 + s.shift.nbytes] ^= 255  # a fingerprint
    path.write_bytes(raw)
    with pytest.raises(Exception, match="hold all its keys"):
        binary.read_shards(manifest, folder).collect()


def test_passes_keep_order_and_leave_no_shuffle(spark, docs, none):
    """Three passes give what one does; each one's shuffle is gone when the next begins."""
    from cinderframe.llm.common import fresh_path

    one, three = fresh_path(spark, "ids"), fresh_path(spark, "ids")
    want = binary.read_shards(binary.write_shards(docs, one, tokenizer_path(), shard_rows=20, passes=1), one)
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffles() -> set:
        return {b for b in disk.getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}

    before = shuffles()
    manifest = binary.write_shards(docs, three, tokenizer_path(), shard_rows=20, passes=3)
    until = time.time() + 20
    while (left := shuffles() - before) and time.time() < until:
        time.sleep(0.1)
    assert not left
    got = binary.read_shards(manifest, three)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    spans = [(r["low"], r["high"]) for r in manifest.where("low is not null").orderBy("shard").collect()]
    assert len(spans) > 3 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    keys = docs.select("doc_id")
    assert binary.lookup(manifest, three, keys).count() == docs.where("doc_id is not null").count()
    assert spark.conf.get(SHUFFLES_GO) == "false"
    nulls = docs.withColumn("doc_id", F.lit(None).cast("long"))
    for d in (none, nulls, docs.withColumn("doc_id", F.lit(5).cast("long")), docs.withColumn("doc_id", F.col("doc_id").cast("int"))):
        folder = fresh_path(spark, "ids")
        assert binary.read_shards(binary.write_shards(d, folder, tokenizer_path(), passes=3), folder).count() == d.count()


def test_shards_follow_bytes_and_rows(spark, docs):
    assert binary.shards_for(docs, None) == 1 and binary.shards_for(docs, 10) == -(-docs.count() // 10) and binary.shards_for(docs.limit(0), None) == 1
