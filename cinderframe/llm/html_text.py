"""HTML extraction by a maximum-scoring subsequence.

A page is a sequence of tags and words. A word scores by its context (the enclosing block with its
class, whether it is in a link, and any menu-like ancestor), a tag always scores below zero. The
weights come from labelled pages, those that mark their article with ``<article>`` or ``<main>``: a
word in a context that is in articles with share s scores ``2 s - 1`` (so words of content score
positive), a tag that is outside with share o scores ``-TAG * o - TINY``. Contexts and tags that no
labelled page has get a prior from their names. One linear scan finds the contiguous region of
largest score (of equal ones the first). A region that lies in an ``<article>`` or ``<main>`` is
widened to all of it, so that a table or a list between two paragraphs can't split the text. Its
blocks are the text, without scripts, styles, comments, forms and menu-like parts inside it. A part is an
element like ``nav`` or one whose class, id or role says no more than that (``names_part``): its words score
nothing, its tags as their weights say.

Pages are read in one pass of bounded work a character, however deep or broken the markup is. The
weights are fitted on a sample of about ``SAMPLE`` labelled pages chosen by hash.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, short_batches

SAMPLE = 2_000
TAG, TINY = 4.0, 0.001

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: A tag's rest up to its end, quotes respected; possessive, so it never goes back.
_REST = re.compile(r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+>""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_BARE_VALUE = re.compile(r"""=\s*[^\s"'>]+/$""")
#: Elements whose content is no markup, by their close tags. Scripts and styles run to the page's end if open.
_RAW = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)", re.I) for n in "script style title textarea iframe noscript noembed noframes xmp".split()}
#: Elements that don't end a block of text.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names of parts that are not the article, and words that only say what kind of box a part is in.
_PARTS = frozenset("ad ads advert advertisement adverts aside banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog disqus footer form gdpr header login menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related replies respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
_BOXES = frozenset("area articles bar block body bottom box button buttons container content footer global header holder inner item items left links list main nav outer overlay page pane panel popup posts primary right row secondary section site slot stories thread top unit wrap wrapper".split())
_PART_TAGS = frozenset("aside audio button canvas dialog footer form header menu nav object select svg template video".split())
#: Parts that an article inside does not end: it is a comment or a teaser.
_CLOSED_PARTS = frozenset("aside comment comments dialog footer menu nav navigation related respond sidebar template".split())
_CONTENT = frozenset("article main p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption".split())
_ARTICLE = frozenset(("article", "main"))


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("", text, "") and (name, "", attributes) of tags, "/name" of close tags, in order."""
    at, n, last, plain, unended, unclosed = 0, len(page), page.rfind(">"), False, False, set()
    while at < n:
        i = page.find("<", at)
        if i < 0 or i > last:  # no tag can end any more
            yield "", page[at : n if i < 0 or not page.startswith("<!--", i) else i], ""
            return
        if i > at:
            yield "", page[at:i], ""
        nxt = page[i + 1 : i + 2]
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = n if end < 0 else end + 3
        elif not unended and page.startswith("<![CDATA[", i):
            end = page.find("]]>", i)
            at, unended = (i, True) if end < 0 else (end + 3, False)
        elif nxt in ("!", "?") and nxt:
            at = page.find(">", i) + 1
        elif nxt == "/" and (m := _NAME.match(page, i + 2)):
            yield "/" + m[0].lower(), "", ""
            at = page.find(">", m.end()) + 1 or n
        elif m := _NAME.match(page, i + 1):
            rest = None if plain else _REST.match(page, m.end())
            plain = rest is None  # a quote that never ends: from here tags end at the first mark
            end = rest.end() if rest else page.find(">", m.end()) + 1 or n
            name, attributes = m[0].lower(), page[m.end() : end - 1]
            yield name, "", attributes
            at = end
            if name in _RAW and name not in unclosed and not closes_itself(attributes):
                close = _RAW[name].search(page, end)
                if close:
                    at = page.find(">", close.end()) + 1 or n
                elif name in ("script", "style"):
                    at = n
                else:
                    unclosed.add(name)
        else:
            yield "", "<", ""
            at = i + 1


_PART_WORD = re.compile(rf"(?:{'|'.join(sorted(_PARTS, key=len, reverse=True))})(?:{'|'.join(sorted(_BOXES))})?")


@lru_cache(65_536)
def names_part(token: str) -> bool:
    """Whether a class, id or role names a part: part words, and besides them only words of boxes and numbers."""
    words = [w for w in re.split(r"[^a-z0-9]+", token[:200]) if w]
    parts = [bool(_PART_WORD.fullmatch(w)) for w in words]
    return any(parts) and all(p or w in _BOXES or w.isdigit() for p, w in zip(parts, words))


def closes_itself(attributes: str) -> bool:
    return attributes.endswith("/") and not _BARE_VALUE.search(attributes[-2_000:])


class Open:
    """An open element: its name, the part that holds it, its block's feature, whether it is in a link and in an article."""

    __slots__ = ("name", "part", "block", "link", "article")

    def __init__(self, name, part, block, link, article):
        self.name, self.part, self.block, self.link, self.article = name, part, block, link, article


def events(page: str) -> Iterator[tuple[str, str, str, str, int]]:
    """("tag", feature, name or "/name", part, article) and ("text", context, text, part, article).

    ``article`` numbers the outermost article or main element around, from 1; 0 is none.
    """
    top = Open("", "", "", False, 0)
    stack, held, articles = [top], Counter(), 0

    def pop() -> None:
        held[stack.pop().name] -= 1

    for name, text, attributes in tokens(page):
        now = stack[-1]
        if not name:
            context = f"!{now.part}" if now.part else now.block + ("/a" if now.link else "")
            yield "text", context, html.unescape(text), now.part, now.article
            continue
        if name[0] == "/":
            yield "tag", f"/!{now.part}" if now.part else name, name, now.part, now.article
            if held[name[1:]] > 0:
                while stack[-1].name != name[1:]:
                    pop()
                pop()
            continue
        names = [t for found in _NAMES.findall(attributes) for t in "".join(found).lower().split()] if attributes else []
        words = [w for t in names[:1] for w in re.split(r"[^a-z0-9]+", t[:200]) if w]
        feature = f"{name}.{words[0]}" if words else name
        if name not in _INLINE:
            while stack[-1].name in ("p", "a"):  # a block ends an open paragraph or link
                pop()
            if name in ("li", "dd", "dt", "td", "th", "tr", "option") and stack[-1].name == name:
                pop()
        now = stack[-1]
        part, article = now.part, now.article
        named = name not in ("html", "body") and any(map(names_part, names))
        if name in _ARTICLE and not named:
            if part and not _CLOSED_PARTS.intersection(re.split(r"\W", part)):
                part = ""
            if not part and not article:
                articles += 1
                article = articles
        elif not part and (named or name in _PART_TAGS and not (article and name == "header")):
            part = feature
        yield "tag", f"!{part}" if part else feature, name, part, article
        if name in _VOID or name in _RAW or (name in _INLINE and name != "a") or closes_itself(attributes):
            continue
        link = name == "a"
        stack.append(Open(name, part, now.block if link else feature, link, article))
        held[name] += 1


def article_counts(page: str) -> Counter:
    """How often each feature is in (1) and outside (0) the article of a labelled page."""
    counts: Counter = Counter()
    for kind, feature, value, part, article in events(page):
        inside = int(article > 0 and not part)
        if kind == "tag":
            counts["<" + feature, inside] += 1
        elif n := len(value.split()):
            counts[feature, inside] += n
    return counts


def prior(feature: str) -> float:
    """The share in articles of a feature that no labelled page has, from its name alone."""
    names = feature.lstrip("<!/").split("/")[0].split(".")
    if "!" in feature[:3] or names[0] in _PART_TAGS:
        return 0.05
    if feature[:1] == "<":  # an unknown tag says little, one inside a line nothing
        return 1.0 if names[0] in _INLINE or feature[1:2] == "/" else 0.95
    return 0.8 if names[0] in _CONTENT else 0.6


def score(feature: str, weights: dict[str, float]) -> float:
    share = weights.get(feature)
    if share is None:
        share = prior(feature)
    return -TAG * (1 - share) - TINY if feature[:1] == "<" else 2 * share - 1


def best_region(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous run of largest sum above 0, the first of equals; (0, 0) if none."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        total += s
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, at = total, (start, i + 1)
    return at


def extract(page: str | None, weights: dict[str, float], joint: str = "\n\n") -> str:
    """The main text: blocks of the best region, with ``joint`` between them; empty if there is none.

    Null and empty pages have no text; of equal regions the first is taken; a page of any length is
    one list of its tags and texts.
    """
    items = list(events(page or ""))
    scores, known = [], {}
    for kind, feature, value, part, _ in items:
        key = "<" + feature if kind == "tag" else feature
        if key not in known:
            known[key] = score(key, weights)
        # a part's words are left out wherever they stand, so they count neither way; its tags do
        n = 1 if kind == "tag" else 0 if part else len(value.split())
        scores.append(n * known[key])
    start, end = best_region(scores)
    held = {items[i][4] for i in range(start, end) if items[i][0] == "text" and not items[i][3] and items[i][2].strip()} - {0}
    if held:  # all of the articles that the region has words of
        own = [i for i, item in enumerate(items) if item[4] in held]
        start, end = min(start, own[0]), max(end, own[-1] + 1)
    blocks, now = [], []
    for kind, _, value, part, _ in items[start:end]:
        if kind == "text":
            if not part:
                now.append(value)
        elif value == "br":
            now.append(" ")
        elif value.lstrip("/") not in _INLINE:
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    return joint.join(b for b in (" ".join(x.split()) for x in blocks) if b)


def fit_weights(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Share of each feature in articles, over about ``sample`` labelled pages; {} without any."""
    labelled = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]") & F.col("html").rlike("(?i)</(article|main)[\\s>]")).select("html")
    n = labelled.count()
    if n > sample:
        labelled = labelled.where(F.xxhash64("html") < F.lit(int(-(2**63) + 2**64 * sample / n)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total: Counter = Counter()
            for page in b["html"]:
                total.update(article_counts(page))
            yield pd.DataFrame([(f, i, c) for (f, i), c in total.items()], columns=["feature", "inside", "n"])

    counts = labelled.mapInPandas(run, "feature string, inside int, n long")
    by = counts.groupBy("feature").agg(F.sum(F.col("n") * F.col("inside")).alias("a"), F.sum("n").alias("n")).where("n > 0")
    return {r["feature"]: (r["a"] + 0.05) / (r["n"] + 0.1) for r in by.collect()}  # features of the sample


def main_text(pages: DataFrame, weights: dict[str, float], joint: str = "\n\n") -> DataFrame:
    """pages' columns (but html) with ``text``: the article of each page, with ``joint`` between blocks.

    Null and empty html give an empty text, html without tags its words; ties go to the first
    region; a page's memory is in proportion to its length; repeated rows and null keys keep rows of
    their own; a column named text is replaced.
    """
    short_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([extract(p, shared.value, joint) for p in b], dtype=object)

    keep = [c for c in pages.columns if c not in ("html", "text")]
    return pages.select(*keep, run("html").alias("text"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text (blocks with two line feeds between them), n_chars of every page."""
    pages = read_table(spark, sf_dir, "pages")
    out = main_text(pages.select("page_id", "url", "html"), fit_weights(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
