"""Token counts per section by offset-mapped attribution.

Each whole document is encoded once; a section's tokens are never counted by encoding the section
alone, which would cut tokens at its edges. The tokens' character spans are interval-joined to the
sections, both in order, by binary search. A token that crosses a boundary goes by ``rule``:
``largest`` to the section with most of its characters (ties to the earlier), ``start`` to the
section of its first character, ``end`` to that of its last. Tokens of characters that no section
holds are counted as outside; a token without characters of its own (the later bytes of a split
character) has that character's span and goes with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import nullable, read_table, short_batches, whole_ids
from .tokens import encoder, tokenizer_path

RULES = ("largest", "start", "end")
OUT = "section int, start long, end long, n_tokens long, n_crossing long"


def allocate(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token or -1, token crosses a section's edge) for ordered, disjoint sections."""
    a, b = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)
    n = len(starts)
    if not n:
        return np.full(len(a), -1), np.zeros(len(a), bool)
    first = np.searchsorted(ends, a, "right")  # the first section that ends after the token's start
    last = np.searchsorted(starts, b, "left") - 1  # the last one that starts before its end
    own = np.where(first <= last, first if rule != "end" else last, -1)
    edge = (own >= 0) & ((starts[np.maximum(own, 0)] > a) | (ends[np.maximum(own, 0)] < b))
    if rule == "largest":
        for t in np.flatnonzero(last > first):
            s = np.arange(first[t], last[t] + 1)
            own[t] = s[np.argmax(np.minimum(ends[s], b[t]) - np.maximum(starts[s], a[t]))]
    elif rule == "start":
        own[(own >= 0) & (starts[np.maximum(own, 0)] > a)] = -1
    else:
        own[(own >= 0) & (ends[np.maximum(own, 0)] < b)] = -1
    return own, edge


def attribute_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", sections: str | None = None, rule: str = "largest") -> DataFrame:
    """(key, section, start, end, n_tokens, n_crossing): a row per section, and one for what is outside.

    ``sections``: a column array<struct<start, end>> of ordered, disjoint character spans, end
    exclusive; without it each line with its line feed is a section. Section -1 (start 0, end the
    text's length) holds tokens outside every section and is there only if it has some. Null and
    empty texts, and texts without sections, give no section rows. Other columns are not read, so
    their names can't clash; repeated rows and null keys give rows of their own.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    short_batches(docs.sparkSession)
    path, kind = tokenizer_path(), docs.schema[key].dataType.simpleString()
    own = F.col(sections).alias("s") if sections else F.lit(None).cast("array<struct<start:long,end:long>>").alias("s")
    whole = kind in ("bigint", "int", "smallint", "tinyint")
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), own).where("length(t) > 0")
    rows = rows.select(*whole_ids("k") if whole else ("k", F.lit(False).alias("no_id")), "t", "s")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, True)
        for b in batches:
            out = []
            for t, s in zip(b["t"], b["s"]):
                if s is None and sections is None:
                    cut = np.flatnonzero(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") == 10) + 1
                    starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(t)]))
                    if len(cut) and cut[-1] == len(t):
                        starts, ends = starts[:-1], ends[:-1]
                else:
                    s = [] if s is None else s
                    starts = np.fromiter((x["start"] for x in s), np.int64, len(s))
                    ends = np.fromiter((x["end"] for x in s), np.int64, len(s))
                where, edge = allocate(enc.offsets(t), starts, ends, rule)
                n = np.bincount(where + 1, minlength=len(starts) + 1)
                cross = np.bincount(where[edge] + 1, minlength=len(starts) + 1)
                i = np.arange(-1, len(starts))
                rows = np.stack((i, np.concatenate(([0], starts)), np.concatenate(([len(t)], ends)), n, cross), 1)
                out.append(rows if n[0] else rows[1:])
            size = [len(x) for x in out]
            frame = pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 5), np.int64), columns=["section", "start", "end", "n_tokens", "n_crossing"])
            k, none = b["k"].repeat(size), b["no_id"].repeat(size)
            frame.insert(0, "k", nullable(k, none) if whole else k.to_numpy())
            yield frame

    return rows.mapInPandas(run, f"k {kind}, {OUT}").withColumnRenamed("k", key)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, from one encoding of each whole text."""
    return attribute_tokens(read_table(spark, sf_dir, "documents"))
