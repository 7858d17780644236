"""Language ID by cross-parsing entropy over suffix automata.

Per language a suffix automaton of labelled text is built. A text is cut greedily into the longest
pieces that occur in a language's text (a letter that doesn't occur is a piece); the number of
pieces c over n letters, normalised by the length N of the language's text, is the cross-parsing
entropy ``c * log2(N) / n``, and the language that needs least wins.

The labelled text is a bounded sample: of each language the documents with the smallest hash of
doc_id until ``letters`` symbols, ``letters`` being at most ``TOTAL_LETTERS`` over the number of
languages. It is small enough to ship to the tasks, which build the automata once per worker.

Texts are parsed whole. So that one long text doesn't run alone, its segments of ``SEGMENT`` symbols
are parsed side by side, each as if a piece began with it; then each is parsed again from where the
one before really ends, up to the first place where both parses begin a piece, from which on they
are the same. The pieces are those of one parse from the text's first letter, whatever ``SEGMENT`` is.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import held, read_table, short_batches

LETTERS = 40_960
TOTAL_LETTERS = 1_048_576
OWN_SYMBOLS, SHARED_SYMBOLS = 48, 16
SEGMENT = 512
LANES = 16_384
CHARS = 4_000_000
UND = "und"


@functools.cache
def fold_table() -> np.ndarray:
    """Code point -> its lower-cased letter, 0 for anything that is no letter."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def folded(text: str | None) -> np.ndarray:
    """Lower-cased letters of a text as code points, anything between them as one 0."""
    codes = fold_table()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")]
    letter = codes > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others
    return codes[keep] if letter.any() else codes[:0]


class Automaton:
    """A suffix automaton as one dense table: state + symbol -> next state, 0 for none.

    States are numbered by ``width``: 0 is dead and ``width`` the start, so ``step`` needs no test for
    missing edges.
    """

    def __init__(self, symbols: np.ndarray, width: int):
        edges: list[dict] = [{}, {}]
        link, length, last = [0, 0], [0, 0], 1
        for c in symbols.tolist():
            cur = len(edges)
            edges.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p and c not in edges[p]:
                edges[p][c] = cur
                p = link[p]
            if not p:
                link[cur] = 1
            else:
                q = edges[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(edges)
                    edges.append(dict(edges[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p and edges[p].get(c) == q:
                        edges[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.table = np.zeros(len(edges) * width, np.int32)
        at = np.fromiter((s * width + c for s, e in enumerate(edges) for c in e), np.int64)
        self.table[at] = np.fromiter((t * width for e in edges for t in e.values()), np.int32) if len(at) else 0
        self.width, self.size = width, max(2, len(symbols))

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, whether a piece begins with the symbol): the start is between two pieces."""
        nxt = self.table.take(state + c)
        begins = nxt == 0  # the piece ended before this symbol, which begins the next, or is one if it never occurs
        dead = np.flatnonzero(begins)
        begins |= state == self.width
        if len(dead):
            again = self.table.take(self.width + c[dead])
            again[again == 0] = self.width
            nxt[dead] = again
        return nxt, begins

    def pieces(self, grid: np.ndarray, size: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Pieces that begin in each lane (a column of grid, ``size`` symbols, longest first).

        ``follows``: the lane that goes on where a lane ends, or -1.
        """
        n = len(size)
        marks = np.zeros(grid.shape, bool)
        state = np.full(n, self.width, np.int32)
        alive = np.searchsorted(-size, -np.arange(size[0]), "left")  # lanes longer than t
        for t, k in enumerate(alive.tolist()):
            state[:k], marks[t, :k] = self.step(state[:k], grid[t, :k])
        count, first = marks.sum(axis=0, dtype=np.int64), state.copy()
        alone = count.copy()
        todo = np.flatnonzero(follows >= 0)
        while len(todo):  # lanes whose end is known now: go on from it in the next one
            lane, at, alike = follows[todo], state[todo], np.zeros(len(todo), bool)
            found = np.zeros(len(todo), np.int64)
            on = np.arange(len(todo))
            for t in range(size[0]):
                on = on[size[lane[on]] > t]
                if not len(on):
                    break
                own = lane[on]
                at[on], begins = self.step(at[on], grid[t, own])
                found[on] += begins
                met = on[begins & marks[t, own]]
                if len(met):
                    alike[met] = True
                    found[met] += alone[lane[met]] - marks[: t + 1, lane[met]].sum(axis=0)
                    on = on[~alike[on]]
            count[lane] = found
            at = np.where(alike, first[lane], at)
            changed = at != state[lane]
            state[lane] = at
            todo = lane[changed & (follows[lane] >= 0)]
        return count


def lane_groups(seg: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Segments (text, begin, length) in groups of about LANES, a text's together, longest first."""
    i = 0
    while i < len(seg):
        j = min(len(seg), i + LANES)
        while j < len(seg) and seg[j][0] == seg[j - 1][0]:
            j += 1
        yield sorted(seg[i:j], key=lambda x: -x[2])
        i = j


class Model:
    """Automata of all languages over one alphabet: frequent letters apart, the rest in classes."""

    def __init__(self, texts: dict[str, str]):
        codes = {lang: np.fromiter(map(ord, t), np.uint32, len(t)) for lang, t in sorted(texts.items())}
        seen, n = np.unique(np.concatenate([np.zeros(0, np.uint32), *codes.values()]), return_counts=True)
        top = seen[np.argsort(-n, kind="stable")][:OWN_SYMBOLS]
        self.symbol = (np.arange(sys.maxunicode + 1) % SHARED_SYMBOLS + OWN_SYMBOLS).astype(np.uint8)
        self.symbol[top] = np.arange(len(top))
        self.langs = list(codes)
        self.automata = [Automaton(self.symbol[c], OWN_SYMBOLS + SHARED_SYMBOLS) for c in codes.values()]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Pieces of each folded text in each language (texts x languages)."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        seg = [(i, j, min(SEGMENT, len(t) - j)) for i, t in enumerate(texts) for j in range(0, len(t), SEGMENT)]
        for group in lane_groups(seg):
            number = {(x[0], x[1]): c for c, x in enumerate(group)}
            size = np.array([x[2] for x in group])
            grid = np.zeros((size[0], len(group)), np.uint8)
            for c, (i, j, n) in enumerate(group):
                grid[:n, c] = self.symbol[texts[i][j : j + n]]
            owner = np.array([x[0] for x in group])
            follows = np.array([number.get((i, j + SEGMENT), -1) for i, j, _ in group])
            for a, m in enumerate(self.automata):
                np.add.at(out[:, a], owner, m.pieces(grid, size, follows))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text: score is the winner's lead over the runner-up, 0 to 1."""
        codes = [folded(t) for t in texts]
        if not self.langs:
            return [(UND, 0.0)] * len(texts)
        need = self.phrases(codes) * np.log2([m.size for m in self.automata])[None, :]
        best = np.argmin(need, axis=1)
        low = need[np.arange(len(texts)), best]
        rest = need.copy()
        rest[np.arange(len(texts)), best] = np.inf
        second = rest.min(axis=1) if len(self.langs) > 1 else np.full(len(texts), np.inf)
        score = np.where(second > 0, 1 - low / np.maximum(second, 1e-9), 0.0)
        return [(self.langs[b], float(s)) if len(c) else (UND, 0.0) for b, s, c in zip(best, score, codes)]


def model_of(texts: tuple[tuple[str, str], ...]) -> Model:
    """The automata, built once per Python worker."""
    return held(("langid", texts), lambda: Model(dict(texts)))


def learnable() -> Column:
    """Rows that may be learned from: crc32 of doc_id's text mod 3 is not 1; none without a doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(False))


def training_texts(docs: DataFrame, letters: int = LETTERS) -> tuple[tuple[str, str], ...]:
    """(language, folded sample) from docs (doc_id, text, lang): at most TOTAL_LETTERS letters in all.

    Per language the documents are taken by ascending hash of doc_id until ``letters`` symbols, or to
    the language's end; ties go by doc_id, then text. One scan sums the characters by language and
    size of hash (64 rows a language); one more reads, for all languages, the documents below the
    bound that this gives. Only where their letters are few among other characters is it repeated
    with wider bounds.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & learnable())
    rows = rows.select("lang", "text", F.xxhash64("doc_id").alias("h"), F.col("doc_id").cast("long").alias("doc_id"))
    # the number of leading zeros of the hash: each level holds about half of the rows of the one before
    rows = rows.withColumn("level", F.when(F.col("h") < 0, 64).otherwise(F.length(F.bin("h"))).cast("int"))
    sums = rows.groupBy("lang", "level").agg(F.sum(F.length("text")).alias("chars")).collect()
    sizes: dict = {}
    for r in sums:
        sizes.setdefault(r["lang"], {})[r["level"]] = r["chars"]
    letters = max(1_024, min(letters, TOTAL_LETTERS // max(1, len(sizes))))
    found: dict[str, str] = {}
    todo, want = dict(sizes), 2 * letters
    while todo:
        bound = {}
        for lang, by in todo.items():
            total = 0
            for level in range(65):
                total += by.get(level, 0)
                if total >= want:
                    break
            bound[lang] = level
        done = sampled(rows, bound, letters)
        found |= done
        todo = {k: v for k, v in todo.items() if bound[k] < 64 and len(done.get(k, "")) < letters}
        want *= 4
    return tuple((k, t) for k, t in sorted(found.items()) if any(x != "\0" for x in t))


def sampled(rows: DataFrame, bound: dict[str, int], letters: int) -> dict[str, str]:
    """The first ``letters`` folded symbols of each language, of rows up to its level of hashes."""
    spark = rows.sparkSession
    limits = spark.createDataFrame(list(bound.items()), "lang string, most int")  # a row a language

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = ["".join(map(chr, folded(t)[:letters].tolist())) for t in b["text"]]
            yield pd.DataFrame({"lang": b["lang"], "h": b["h"], "doc_id": b["doc_id"], "text": texts})

    mine = rows.join(F.broadcast(limits), "lang").where("level <= most").select("lang", "h", "doc_id", "text")
    mine = mine.mapInPandas(run, "lang string, h long, doc_id long, text string").where("text <> ''")
    # unsigned order of hashes; texts that others of the language fill up before are not sent
    key = F.shiftrightunsigned("h", 1)
    before = W.partitionBy("lang").orderBy(key, "h", "doc_id", "text").rowsBetween(W.unboundedPreceding, -1)
    mine = mine.withColumn("before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where(F.col("before") < letters)
    out: dict[str, list] = {}
    for r in mine.select("lang", "before", "text").collect():  # at most 2 * letters symbols a language
        out.setdefault(r["lang"], []).append((r["before"], r["text"]))
    return {k: "".join(t for _, t in sorted(v))[:letters] for k, v in out.items()}


def identify(docs: DataFrame, texts: tuple[tuple[str, str], ...]) -> DataFrame:
    """docs' columns with lang_pred and score, from the whole text alone.

    Texts that are null or have no letter, and all texts if nothing was learned, are ``und`` with
    score 0. Ties go to the first language in order. Columns of docs named lang_pred or score are
    replaced.
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(texts)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = model_of(shared.value)
        for b in batches:
            out, group, size = [], [], 0
            for t in b:
                group.append(t)
                size += len(t or "")
                if size >= CHARS:
                    out += m.predict(group)
                    group, size = [], 0
            yield pd.DataFrame(out + m.predict(group), columns=["lang_pred", "score"])

    return docs.select(*keep, predict("text").alias("__p")).select(*keep, "__p.*")


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that language ID rejects (``und``); same columns.

    Where nothing could be learned (no labelled text), only null and letterless texts go.
    """
    texts = training_texts(docs)
    if not texts:
        return docs.where(F.col("text").rlike("\\p{L}"))
    found = identify(docs.select(F.struct(*docs.columns).alias("doc"), "text"), texts)
    return found.where(F.col("lang_pred") != UND).select("doc.*")


def held_out() -> Column:
    """Remainder 1; a row without a doc_id is neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of documents."""
    docs = read_table(spark, sf_dir, "documents")
    rows = identify(docs.select("doc_id", "text"), training_texts(docs))
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
