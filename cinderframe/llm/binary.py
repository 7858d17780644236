"""Token-ID output: raw id files with a minimal perfect hash index from document keys to offsets.

A shard is two files in a shared folder. ``shard-NNNNN.ids`` holds the ids alone, little-endian, in
the smallest unsigned type the vocabulary fits. ``shard-NNNNN.idx`` holds, as little-endian arrays
behind a header of eight 64-bit numbers (magic, version, bytes of an id, records, keys, buckets,
ids, 0): displacements (one int32 a bucket), fingerprints (one uint32 a slot), slot -> record
(one uint32 a slot), keys (one int64 a record), key is null (one byte a record), and offsets (one
uint64 a record, and the end). A key's slot comes from its bucket's displacement with no search, its
stored fingerprint tells foreign keys apart, and the slot names the first record of that key. Reading
back goes through it: every key is looked up, and its rows are those of the record its slot names.

Shards are ranges of (doc_id, text hash), so a repeated or null key spreads over shards too. Files
are written under an attempt's own name and renamed: a task that runs again replaces like by like.
Large tables are written in a few passes, each over a range of doc_ids, and a pass's shuffle is removed
as it ends, so the disk holds the ids and a pass's share of the texts (all, if they share one doc_id).
Work in a task is bounded by a batch and one document, besides the keys of its shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_path, passing_shuffles, read_table, short_batches, whole_ids, written
from .tokens import encoder, tokenizer_path

MAGIC, VERSION = 0x58444952, 1
END_ID = 2
#: A shard holds about a fourth of a core's share of the texts, between these bytes, and at most so many rows.
SHARD_BYTES = (16 << 20, 256 << 20)
SHARD_ROWS = 1_000_000
#: Passes over a table that has shards for every core in each of them; fewer over smaller ones.
PASSES = 3
#: Shard bounds that are sent to the tasks at once; more go in blocks.
BOUNDS = 1_000_000
M64 = (1 << 64) - 1
#: Displacements of a bucket that are tried at once: at first, and at most.
TRIES = (16, 2048)


def mix64(x: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 keys; seeds may be an int64 array that broadcasts against them."""
    with np.errstate(over="ignore"):
        if isinstance(seed, np.ndarray):
            x = x + np.uint64(0x9E3779B97F4A7C15) * (seed + 1).astype(np.uint64)
        else:
            x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & M64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(displacements, slot of each key, fingerprints by slot) for distinct int64 keys.

    Hash and displace: keys fall in buckets of about four; the largest buckets first search a
    displacement that puts all of theirs in free slots, single keys are given free slots outright.
    Displacements are tried in order, in arrays of ``TRIES`` and more: the last buckets, whose slots are
    nearly all taken, need thousands.
    """
    n = len(keys)
    k = keys.view(np.uint64) if n else np.zeros(0, np.uint64)
    buckets = max(1, n // 4)
    shift = np.zeros(buckets, np.int32)
    slot = np.full(n, -1, np.int64)
    if n:
        b = (mix64(k, 0) % np.uint64(buckets)).astype(np.int64)
        h1, h2 = mix64(k, 1) % np.uint64(n), mix64(k, 2) | np.uint64(1)
        order = np.argsort(b, kind="stable")
        start = np.searchsorted(b[order], np.arange(buckets + 1))
        size = np.diff(start)
        taken = np.zeros(n, bool)
        by_size = np.argsort(-size, kind="stable")
        for i in by_size[size[by_size] > 1].tolist():
            mine = order[start[i] : start[i + 1]]
            shift[i], slot[mine] = free_displacement(h1[mine], h2[mine], taken)
            taken[slot[mine]] = True
        alone = by_size[size[by_size] == 1]
        free = np.flatnonzero(~taken)
        slot[order[start[alone]]] = free
        shift[alone] = -1 - free
    prints = np.zeros(n, np.uint32)
    prints[slot] = (mix64(k, 9) >> np.uint64(32)).astype(np.uint32)
    return shift, slot, prints


def free_displacement(h1: np.ndarray, h2: np.ndarray, taken: np.ndarray) -> tuple[int, np.ndarray]:
    """The smallest displacement that puts a bucket's keys in free slots of their own, and those slots."""
    n, d, tries = np.uint64(len(taken)), 0, TRIES[0]
    while True:
        with np.errstate(over="ignore"):
            at = ((h1 + mix64(h2, np.arange(d + 3, d + tries + 3)[:, None])) % n).astype(np.int64)
        for r in np.flatnonzero(~taken[at].any(axis=1)).tolist():
            if len(set(at[r].tolist())) == len(h1):
                return d + r, at[r]
        d, tries = d + tries, min(2 * tries, TRIES[1])


def find_slots(keys: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    """The slot of each int64 key; of foreign keys, some slot."""
    k = keys.view(np.uint64)
    d = shift[(mix64(k, 0) % np.uint64(len(shift))).astype(np.int64)]
    out = (-1 - d).astype(np.int64)
    h1, h2 = mix64(k, 1) % np.uint64(n), mix64(k, 2) | np.uint64(1)
    for v in np.unique(d[d >= 0]):
        at = d == v
        with np.errstate(over="ignore"):
            out[at] = ((h1[at] + mix64(h2[at], int(v) + 3)) % np.uint64(n)).astype(np.int64)
    return out


def _fs(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class Shard:
    """One shard opened for reading; ids are read by range, never as a whole."""

    def __init__(self, folder: str, number: int):
        self.fs, base = _fs(folder)
        self.base = f"{base}/shard-{number:05d}"
        with self.fs.open_input_file(self.base + ".idx") as f:
            raw = f.read()
        head = np.frombuffer(raw, "<i8", 8)
        if head[0] != MAGIC or head[1] != VERSION:
            raise ValueError(f"{self.base}.idx is not a shard index")
        self.width, self.records, self.n_keys, buckets, self.n_ids = (int(x) for x in head[2:7])
        at = 64

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, kind, n, at)
            at += got.nbytes
            return got

        self.shift, self.prints, self.first = take("<i4", buckets), take("<u4", self.n_keys), take("<u4", self.n_keys)
        self.keys, self.null, self.offsets = take("<i8", self.records), take("u1", self.records), take("<u8", self.records + 1)

    def ids(self, start: int, end: int) -> np.ndarray:
        with self.fs.open_input_file(self.base + ".ids") as f:
            f.seek(int(start) * self.width)
            return np.frombuffer(f.read((int(end) - int(start)) * self.width), f"<u{self.width}")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first record of each key by slot and fingerprint, in constant time; -1 for keys that aren't here."""
        if not self.n_keys:
            return np.full(len(keys), -1)
        slot = find_slots(keys, self.shift, self.n_keys)
        known = self.prints[slot] == (mix64(keys.view(np.uint64), 9) >> np.uint64(32)).astype(np.uint32)
        return np.where(known, self.first[slot].astype(np.int64), -1)

    def located(self) -> np.ndarray:
        """The record that the index gives for each record's key; a repeated key's follow its first."""
        begins = key_begins(self.keys, self.null)
        found = self.find(np.ascontiguousarray(self.keys[begins]))
        if (found < 0).any() or len(begins) != self.n_keys:
            raise ValueError(f"{self.base}.idx doesn't hold all its keys")
        number = np.searchsorted(begins, np.arange(self.records), "right") - 1
        own = np.flatnonzero(self.null == 0)
        out = np.arange(self.records)
        out[own] = found[number[own]] + own - begins[number[own]]
        return out

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every record of a key; none for a key that isn't here."""
        r = int(self.find(np.array([key], np.int64))[0])
        if r < 0:
            return []
        out = []
        while r < self.records and self.keys[r] == key and not self.null[r]:
            out.append(self.ids(self.offsets[r], self.offsets[r + 1]))
            r += 1
        return out


def key_begins(keys: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Records that begin a key's run; null keys have none."""
    return np.flatnonzero((null == 0) & ((np.arange(len(keys)) == 0) | (keys != np.roll(keys, 1)) | (np.roll(null, 1) == 1)))


def shards_for(docs: DataFrame, shard_rows: int | None) -> int:
    """How many shards the texts need, by their bytes and rows."""
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    share = size // (4 * docs.sparkSession.sparkContext.defaultParallelism)
    most = max(SHARD_BYTES[0], min(SHARD_BYTES[1], share))
    return max(1, -(-size // most), -(-rows // (shard_rows or SHARD_ROWS)))


def pass_ranges(docs: DataFrame, passes: int) -> list[Column]:
    """Conditions on doc_id that part the rows into at most ``passes`` ranges of about as many rows, in order, null first.

    A doc_id is in one range, whatever its rows; where all are null there is one range.
    """
    key = F.col("doc_id").cast("long")
    cuts = docs.agg(F.percentile_approx(key, [i / passes for i in range(1, passes)])).first()[0] if passes > 1 else None
    cuts = sorted(set(cuts or ()))
    if not cuts:
        return [F.lit(True)]
    between = [(key > low) & (key <= high) for low, high in zip(cuts, cuts[1:])]
    return [key.isNull() | (key <= cuts[0]), *between, key > cuts[-1]]


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int | None = END_ID, shard_rows: int | None = None, passes: int | None = None) -> DataFrame:
    """Write docs (doc_id, text; other columns are not read) as shards; the manifest, one row each.

    Order: ascending doc_id (null first), then text hash. Null and empty texts give only the end id.
    Manifest: shard, n_records, n_ids, low, high (keys). No rows: no shards, an empty manifest.
    ``passes`` (by default by the size) read docs once each, for the rows of their range alone.
    """
    spark = docs.sparkSession
    short_batches(spark)
    with passing_shuffles(spark):
        n = shards_for(docs, shard_rows)
        ranges = pass_ranges(docs, passes or max(1, min(PASSES, n // spark.sparkContext.defaultParallelism)))
        each, manifests = -(-n // len(ranges)), []
        for i, wanted in enumerate(ranges):
            found = _write_range(docs.where(wanted), folder, path, end_id, each, i * each)
            manifests.append(written(found, "shard-manifest"))
    return reduce(DataFrame.unionByName, manifests)


def _write_range(docs: DataFrame, folder: str, path: str, end_id: int | None, n: int, first_number: int) -> DataFrame:
    """The manifest of ``docs`` in ``n`` shards from ``first_number`` on, which are written as it is read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select(*whole_ids(), "text")
    schema = "shard int, n_records long, n_ids long, low long, high long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, number = encoder(path), first_number + TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        fs, base = _fs(folder)
        own = f"{base}/shard-{number:05d}.{uuid.uuid4().hex}"
        keys, null, sizes, out = [], [], [], None
        for b in batches:
            if out is None and len(b):
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(own + ".ids")
            for text in b["text"]:
                ids = enc.ids(text) + end
                out.write(ids)
                sizes.append(len(ids) // enc.dtype.itemsize)
            null.append(b["no_id"].to_numpy(np.uint8))
            keys.append(b["doc_id"].to_numpy(np.int64))
        if out is None:
            return
        out.close()
        keys, null = np.concatenate(keys), np.concatenate(null)
        begins = key_begins(keys, null)
        shift, slot, prints = build_index(keys[begins])
        first = np.zeros(len(begins), "<u4")
        first[slot] = begins
        head = np.array([MAGIC, VERSION, enc.dtype.itemsize, len(keys), len(begins), len(shift), sum(sizes), 0], "<i8")
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype("<u8")
        with fs.open_output_stream(own + ".idx") as f:
            for part in (head, shift.astype("<i4"), prints.astype("<u4"), first, keys.astype("<i8"), null, offsets):
                f.write(part.tobytes())
        for kind in (".ids", ".idx"):
            fs.move(own + kind, f"{base}/shard-{number:05d}{kind}")
        real = keys[null == 0]
        low, high = (real[0], real[-1]) if len(real) else (None, None)
        yield pd.DataFrame({"shard": [number], "n_records": len(keys), "n_ids": int(sum(sizes)), "low": pd.array([low], "Int64"), "high": pd.array([high], "Int64")})

    return rows.mapInPandas(run, schema)


def read_shards(manifest: DataFrame, folder: str, block: int = 1 << 21) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, looked up by key and read from the files.

    Rows with a null doc_id have no key; they come first and are read in order.
    """
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row a shard
    bases = manifest.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    n = max(1, manifest.count())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for number, base in zip(b["shard"].tolist(), b["base"].tolist()):
                s = Shard(folder, number)
                at, off = s.located(), s.offsets.astype(np.int64)
                low, high = off[at], off[at + 1]
                size = np.cumsum(high - low)
                r = 0
                while r < s.records:
                    to = max(r + 1, int(np.searchsorted(size, (size[r - 1] if r else 0) + block, "right")))
                    begin, end = int(low[r:to].min()), int(high[r:to].max())
                    ids = s.ids(begin, end).astype("<u4")
                    crc = [zlib.crc32(ids[x:y]) for x, y in zip((low[r:to] - begin).tolist(), (high[r:to] - begin).tolist())]
                    doc = pd.array(s.keys[r:to].copy(), "Int64")
                    doc[s.null[r:to] == 1] = pd.NA
                    yield pd.DataFrame({"doc_id": doc, "start": low[r:to] + base, "n_tokens": high[r:to] - low[r:to], "ids_crc32": crc})
                    r = to

    return bases.repartitionByRange(n, "shard").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, folder: str, keys: DataFrame, bounds: int = BOUNDS) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>) for a DataFrame of keys (doc_id), by the hash index.

    Shards are ranges of keys: each distinct key goes to those whose range holds it (one, unless the
    key repeats), found by binary search in their bounds, ``bounds`` shards at a time. A shard is
    asked for at most as many keys as it has.
    """
    spark = manifest.sparkSession
    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    last = manifest.agg(F.max("shard")).first()[0]
    hit = None
    for begin in range(0, (-1 if last is None else last) + 1, bounds):
        part = manifest.where((F.col("shard") >= begin) & (F.col("shard") < begin + bounds) & F.col("low").isNotNull()).orderBy("shard")
        table = np.array([(r["shard"], r["low"], r["high"]) for r in part.select("shard", "low", "high").toLocalIterator()], np.int64).reshape(-1, 3)
        shared = spark.sparkContext.broadcast(table)

        def route(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            shard, low, high = shared.value.T
            for b in batches:
                k = b["doc_id"].to_numpy(np.int64)
                first, end = np.searchsorted(high, k, "left"), np.searchsorted(low, k, "right")
                times = np.maximum(end - first, 0)
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                yield pd.DataFrame({"shard": shard[np.repeat(first, times) + nth], "doc_id": np.repeat(k, times)})

        found = wanted.mapInPandas(route, "shard long, doc_id long")
        hit = found if hit is None else hit.unionByName(found)
    if hit is None:
        hit = wanted.select(F.lit(0).cast("long").alias("shard"), "doc_id").limit(0)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        s = Shard(folder, int(g["shard"].iloc[0]))
        found = [(k, len(ids), ids.astype(np.int64)) for k in g["doc_id"] for ids in s.get(int(k))]
        return pd.DataFrame(found, columns=["doc_id", "n_tokens", "ids"])

    return hit.groupBy("shard").applyInPandas(run, "doc_id long, n_tokens long, ids array<long>")


def token_output(docs: DataFrame, end_id: int | None = END_ID, shard_rows: int | None = None) -> DataFrame:
    """Write ``docs`` as id shards in the shared folder and return what reading them back gives.

    One row per row of docs, repeated and null doc_ids included.
    """
    folder = fresh_path(docs.sparkSession, "ids")
    manifest = write_shards(docs, folder, tokenizer_path(), end_id, shard_rows)
    return read_shards(manifest, folder)


def op8_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of documents, from the files."""
    return token_output(read_table(spark, sf_dir, "documents"))
