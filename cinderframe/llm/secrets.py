"""Secret scans: fixed patterns, and a battery of randomness tests for anything else.

Fixed patterns (``assign``, ``access``, ``hex``) are always reported. Beside them every run of
``[A-Za-z0-9+/=_-]`` of MIN_RUN characters or more that overlaps none of them is a candidate. Its
encoding is the narrowest alphabet that holds it, and three tests ask whether it could be uniform
random symbols: chi-squared uniformity over the alphabet, runs above and below its middle, and lag-1
serial correlation. Fisher's method joins them; a candidate that it rejects at ALPHA is no secret.

A discovery is a candidate reported as ``random``, so the null hypothesis is "text-like": words,
paths, identifiers and rulers. Chi-squared is the number of pairs of equal symbols in other units; in
text that number is higher than in random symbols, and the more so the longer the string. Under the
null its mean and variance follow from the chance s2 that two symbols are equal and s3 that three
are. Both, and how much strings spread beyond that variance, are calibrated per encoding over the
whole corpus from the candidates of LONG symbols or more that the battery rejected below FAR (a level
that random strings don't reach however many there are; of shorter strings it passes much text, so
what it rejects would be no fair sample). Every string has one vote, a prior has PRIOR, and s2 has a
floor halfway from uniform symbols to the prior. The p-value is the lower tail (1 for what the battery
rejected), so a short string can't be told from text and is not reported.

The Benjamini-Hochberg rule at level Q runs per encoding and length class over all candidates of the
corpus, so among what is reported in a class at most an expected share Q is text-like. Decimal digits
alone are never candidates.

The texts are scanned once; calibration and cut-offs come from aggregates of the candidates of at
most encodings x length classes x BINS rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read_table, short_batches, written

KINDS = ("assign", "access", "hex", "random")
MIN_RUN = 20
ALPHA = 0.001
#: Below this p-value a string is text for certain, and may calibrate the null.
FAR = 1e-9
Q = 0.05
BINS = 400
#: Strings that the prior of an encoding's null distribution is worth.
PRIOR = 20
#: Strings that calibrate: so long that the battery misses little text, and of so many symbols that they are no rulers.
LONG, VARIED = 64, 8

_KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ANY_CASE = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
_ASSIGN = re.compile(rf"""({_ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets from narrow to wide, each in its order of values.
ENCODINGS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "lower": _LOWER,
    "lower36": _DIGITS + _LOWER,
    "upper36": _DIGITS + _UPPER,
    "letters": _UPPER + _LOWER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
    "mixed": _UPPER + _LOWER + _DIGITS + "+/-_=",
}


def _mask(chars: str) -> np.ndarray:
    t = np.zeros(256, np.int8)
    t[np.frombuffer(chars.encode(), np.uint8)] = 1
    return t


_RUN, _HEX = _mask(ENCODINGS["mixed"]), _mask(ENCODINGS["hex"])


def runs_of(raw: np.ndarray, mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of at least ``least`` masked bytes."""
    edges = np.flatnonzero(np.diff(mask[raw], prepend=np.int8(0), append=np.int8(0)))
    a, b = edges[::2], edges[1::2]
    at = np.flatnonzero(b - a >= least)
    return list(zip(a[at].tolist(), b[at].tolist()))


#: Share of each lower-case letter in English prose, in percent: fixed values of the prior.
LETTER_SHARES = {
    "a": 8.2, "b": 1.5, "c": 2.8, "d": 4.3, "e": 12.7, "f": 2.2, "g": 2.0, "h": 6.1, "i": 7.0, "j": 0.15, "k": 0.77, "l": 4.0, "m": 2.4,
    "n": 6.7, "o": 7.5, "p": 1.9, "q": 0.095, "r": 6.0, "s": 6.3, "t": 9.1, "u": 2.8, "v": 0.98, "w": 2.4, "x": 0.15, "y": 2.0, "z": 0.074,
}


def prior_shares(name: str) -> list[float]:
    """Text-like symbol shares of an encoding: letters as in prose, one in ten a capital, and one symbol in ten another."""
    alphabet = ENCODINGS[name]
    other = [c for c in alphabet if not c.isalpha()]
    both = any(c in _UPPER for c in alphabet) and any(c in _LOWER for c in alphabet)
    case = {c: (0.1 if c.isupper() else 0.9) if both else 1.0 for c in alphabet if c.isalpha()}
    w = {c: LETTER_SHARES[c.lower()] * k for c, k in case.items()}
    total, rest = sum(w.values()), 0.1 if other and w else 0.0
    return [v / total * (1 - rest) for v in w.values()] + [rest / len(other) for _ in other if rest]


#: (s2, s3) of the prior: chances that two and three symbols of text are equal.
_PRIOR = {n: (sum(q**2 for q in prior_shares(n)), sum(q**3 for q in prior_shares(n))) for n in ENCODINGS}
_ORDER = {name: {c: i for i, c in enumerate(a)} for name, a in ENCODINGS.items()}
_SETS = {name: frozenset(a) for name, a in ENCODINGS.items()}


def encoding_of(token: str) -> str:
    """The narrowest alphabet that holds the token's characters, padding aside."""
    have = set(token.rstrip("="))
    return next((n for n, s in _SETS.items() if have <= s), "mixed")


def randomness(token: str, name: str) -> float:
    """Fisher's p-value that the token is uniform random symbols of the encoding."""
    order = _ORDER[name]
    v = np.array([order[c] for c in (token.rstrip("=") if name != "mixed" else token)], float)
    n, k = len(v), len(order)
    if n < 8:
        return 0.0
    counts = np.bincount(v.astype(int), minlength=k)
    chi = float(((counts - n / k) ** 2).sum() * k / n)
    z = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    p = [0.5 * math.erfc(z / math.sqrt(2))]
    up = v >= k / 2
    n1, n2 = int(up.sum()), int(n - up.sum())
    if n1 and n2:
        mean = 1 + 2 * n1 * n2 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        z = (1 + int((up[1:] != up[:-1]).sum()) - mean) / math.sqrt(var) if var > 0 else 0.0
        p.append(math.erfc(abs(z) / math.sqrt(2)))
    else:
        p.append(2.0 ** (1 - n))
    d = v - v.mean()
    s = float((d * d).sum())
    p.append(math.erfc(abs(float((d[1:] * d[:-1]).sum()) / s) * math.sqrt(n / 2)) if s else 0.0)
    x = -sum(math.log(max(q, 1e-300)) for q in p)
    return math.exp(-x) * (1 + x + x * x / 2)


def equal_symbols(token: str, name: str) -> tuple[int, int, int, int]:
    """(symbols, different ones, pairs and triples of equal symbols) of a token, padding aside."""
    symbols = (token.rstrip("=") if name != "mixed" else token).encode()
    c = np.bincount(np.frombuffer(symbols, np.uint8)) if symbols else np.zeros(1, np.int64)
    return len(symbols), int((c > 0).sum()), int((c * (c - 1) // 2).sum()), int((c * (c - 1) * (c - 2) // 6).sum())


def scan_text(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple]]:
    """Base spans (start, kind, end) and candidates (start, end, encoding, length class, symbols, different ones, pairs, triples, passes, far).

    Work follows the text's length and its candidates.
    """
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    low, base, more = raw.lower(), [], []
    if any(k.encode() in low for k in _KEYWORDS):
        base += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    u = np.frombuffer(raw, np.uint8)
    found = runs_of(u, _RUN, MIN_RUN)
    at = None if len(raw) == len(text) or not found else np.cumsum((u & 0xC0) != 0x80) - 1  # byte -> code point
    places = [(a if at is None else int(at[a]), raw[a:b], u[a:b]) for a, b in found]
    for i, _, part in places:
        base += [(i + x, 2, i + y) for x, y in runs_of(part, _HEX, 24)]
    base.sort()
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    for i, part, _ in places:
        token, end = part.decode(), i + len(part)
        k = bisect_left(starts, end)
        if k and reach[k - 1] > i:
            continue
        name = encoding_of(token)
        if name != "decimal":
            p = randomness(token, name)
            more.append((i, end, name, len(token).bit_length(), *equal_symbols(token, name), p >= ALPHA, p < FAR))
    return base, more


def scan_secrets(docs: DataFrame, q: float = Q) -> DataFrame:
    """docs' columns (but text) with ``base`` and ``spans``: arrays of (start, kind, end).

    kind numbers KINDS; positions are code points, end exclusive; ordered by start, then kind. Null
    and empty texts have none; a very long text takes time in proportion; candidates of equal p-value
    are reported or left together; repeated rows and null ids keep rows of their own; docs' columns
    keep their names inside a struct until the end, so ``base`` and ``spans`` there are replaced. An
    empty table gives no rows.
    """
    span = "array<struct<start:long,kind:int,end:long>>"
    fields = ("start", "end", "encoding", "length", "n", "kinds", "pairs", "triples", "passes", "far")

    @F.pandas_udf(f"base {span}, more array<struct<start:long,end:long,encoding:string,length:int,n:long,kinds:int,pairs:long,triples:long,passes:boolean,far:boolean>>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        found = [scan_text(t) for t in texts]
        base = [[{"start": s, "kind": k, "end": e} for s, k, e in b] for b, _ in found]
        more = [[dict(zip(fields, x)) for x in m] for _, m in found]
        return pd.DataFrame({"base": base, "more": more})

    short_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("text", "base", "spans")]
    doc = F.struct(*keep) if keep else F.struct(F.lit(0).alias("none"))
    rows = written(docs.select(doc.alias("doc"), scan("text").alias("x")), "secret-scan")
    candidates = rows.select(F.explode("x.more").alias("c")).select("c.*")
    null = null_model(candidates)
    cut = cutoffs(candidates.select("encoding", "length", p_bin(candidates, null).alias("bin")), q)

    def kept(c: Column) -> Column:
        key = F.concat_ws(":", c["encoding"], c["length"].cast("string"))
        return p_bin(c, null) >= F.coalesce(F.element_at(cut, key), F.lit(BINS + 1))

    random = F.transform(F.filter("x.more", kept), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return rows.select(*[F.col("doc")[c].alias(c) for c in keep], F.col("x.base").alias("base"), F.array_sort(F.concat("x.base", random)).alias("spans"))


def expected(n, s2, s3):
    """(mean, variance) of the pairs of equal symbols among n drawn with those chances; columns or numbers."""
    c2 = n * (n - 1) / 2
    return c2 * s2, c2 * ((s2 - s2 * s2) + 2 * (n - 2) * (s3 - s2 * s2))


def null_model(candidates: DataFrame) -> Column:
    """A literal map encoding -> (s2, s3, spread) of text-like strings.

    From the candidates that the battery rejected far out, each string one vote, and the prior's PRIOR
    votes; a row an encoding each time. s2 stays above the middle between uniform symbols and the prior,
    so no number of random strings among them can turn the null into randomness.
    """
    sample = candidates.where(F.col("far") & (F.col("n") >= LONG) & (F.col("kinds") >= VARIED))
    n = F.col("n").cast("double")
    share2, share3 = F.col("pairs") / (n * (n - 1) / 2), F.col("triples") / (n * (n - 1) * (n - 2) / 6)
    by = sample.groupBy("encoding").agg(F.sum(share2).alias("s2"), F.sum(share3).alias("s3"), F.count("*").alias("k"))
    sums = {r["encoding"]: r for r in by.collect()}
    model = {name: text_like(name, *(sums[name][c] if name in sums else 0 for c in ("s2", "s3", "k"))) for name in _PRIOR}
    mean, var = expected(n, *(literal_map({k: v[i] for k, v in model.items()}, F.col("encoding")) for i in (0, 1)))
    off = F.least(F.pow(F.col("pairs") - mean, 2) / var, F.lit(9.0))  # one odd string counts as three deviations at most
    spread = {r["encoding"]: (r["off"] + PRIOR) / (r["n"] + PRIOR) for r in sample.groupBy("encoding").agg(F.sum(off).alias("off"), F.count("*").alias("n")).collect()}
    return F.create_map(*[x for k, (s2, s3) in model.items() for x in (F.lit(k), F.array(F.lit(float(s2)), F.lit(float(s3)), F.lit(float(max(1.0, spread.get(k, 1.0))))))])


def text_like(name: str, s2: float, s3: float, k: int) -> tuple[float, float]:
    """(s2, s3) of an encoding from the sums over k strings, the prior and the floor."""
    p2, p3 = _PRIOR[name]
    s2, s3 = (s2 + PRIOR * p2) / (k + PRIOR), (s3 + PRIOR * p3) / (k + PRIOR)
    s2 = max(s2, (p2 + 1 / len(ENCODINGS[name])) / 2)
    return s2, max(s3, s2 * s2)


def literal_map(values: dict[str, float], key: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))]), key)


def p_bin(c, null: Column) -> Column:
    """floor(-10 log10 p) of a candidate under the null, at most BINS; 0 for what the battery rejected.

    p is the lower tail of the normal distribution, by the lesser of its bounds exp(-z^2 / 2) / 2 and
    density(z) / -z for z < 0.
    """
    n, m = c["n"].cast("double"), F.element_at(null, c["encoding"])
    mean, var = expected(n, m[0], m[1])
    z = (c["pairs"] - mean) / F.sqrt(var * m[2])
    log_p = z * z / 2 + F.greatest(F.lit(math.log(2)), F.log(-z * math.sqrt(2 * math.pi)))
    tens = F.least(F.floor(10 * log_p / math.log(10)), F.lit(BINS)).cast("int")
    return F.when(c["passes"] & (z < 0), tens).otherwise(F.lit(0))


def cutoffs(candidates: DataFrame, q: float) -> Column:
    """A literal map "encoding:length class" -> lowest bin reported, by Benjamini-Hochberg.

    A bin holds p-values up to 10^(-bin/10); its own upper end stands for all of them.
    """
    by = candidates.groupBy("encoding", "length", "bin").count()
    stratum = W.partitionBy("encoding", "length")
    upto = F.sum("count").over(stratum.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0))
    ranked = by.select("encoding", "length", "bin", upto.alias("k"), F.sum("count").over(stratum).alias("m"))
    reported = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 10) <= q * F.col("k") / F.col("m"))
    rows = reported.groupBy("encoding", "length").agg(F.min("bin").alias("bin")).collect()  # encodings x length classes
    pairs = [F.lit(x) for r in rows for x in (f"{r['encoding']}:{r['length']}", int(r["bin"]))] or [F.lit(""), F.lit(0)]
    return F.create_map(*pairs)


def joined(spans: Column) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of documents."""
    rows = scan_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    n = [count(k) for k in range(3)]
    return rows.select("doc_id", *n, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
