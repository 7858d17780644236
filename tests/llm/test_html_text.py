"""HTML extraction: the best region against brute force, broken and long pages, and what articles keep."""

from __future__ import annotations

import random
import time

from cinderframe.llm import html_text

PAGE = ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Menu one</a></li><li><a>Menu two</a></li></ul></nav>"
        "<div class='ad'>buy this now</div><article><h1>Head  &amp; line</h1><p>First <b>bold</b>\n words here.<br>more<p>Second &eacute;.</p><div class='comments'><p>me too</p></div></article><footer>&copy; site all rights</footer></body></html>")  # fmt: skip
TEXT = "Head & line\n\nFirst bold words here. more\n\nSecond é."


def test_article_text(spark):
    pages = spark.createDataFrame([(i, PAGE, "u") for i in range(20)] + [(50, None, "u"), (51, "", "u"), (52, "plain words", "u"), (53, PAGE.replace("</article>", ""), "u"), (0, PAGE, "u"), (None, PAGE, "u")], "page_id long, html string, text string")
    rows = html_text.main_text(pages, html_text.fit_weights(pages)).collect()
    got = {r["page_id"]: r["text"] for r in rows}
    assert len(rows) == 26 and got[0] == got[None] == TEXT and got[50] == got[51] == "" and got[52] == "plain words" and got[53] == TEXT
    bare = {r["page_id"]: r["text"] for r in html_text.main_text(pages, {}).collect()}
    assert bare[0] == TEXT and html_text.fit_weights(pages.where("page_id > 49 and page_id < 53")) == {}
    assert html_text.main_text(pages.limit(0), {}).count() == 0


def test_html_query_puts_two_line_feeds_between_blocks(spark, tmp_path):
    page = "<body><article><h1>Head line</h1><p>First words here.<br>more</p><p>Second one.</p></article></body>"
    spark.createDataFrame([(1, "u", page), (2, "u", "plain words"), (3, None, None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.op10_html_text(spark, str(tmp_path)).collect()}
    want = "Head line\n\nFirst words here. more\n\nSecond one."
    assert got == {1: (want, len(want)), 2: ("plain words", 11), 3: ("", 0)}


def test_nothing_of_an_article_is_lost():
    pages = {
        '<nav>a b</nav><article><h1>T</h1><p>one two three</p><svg class="i"/><p>four five six seven</p></article>': ["T", "one two three", "four five six seven"],
        "<article><p>a b c</p><object/><p>four five</p><script src='x'/><p>six</p></article>": ["a b c", "four five", "six"],
        "<article><p>alpha beta</p><table><tr><td>cell a<td>cell b</table><pre>some code</pre><p>last one</p></article>": ["alpha beta", "cell a", "cell b", "some code", "last one"],
        f"<main><p>x y</p><div class='ad'>{'ad ' * 500}</div><p>z w</p></main>": ["x y", "z w"],
        "<div class=content><p>One two three.</p><ul><li>a <a href=x>link</a> item<li>b item</ul><p>End of it.</p></div><section id=comments><article>me too</article></section>": ["One two three.", "a link item", "b item", "End of it."],
        "<p>a &lt; b</p><script src=/x/>var no</script><p>c &#233;</p><form><button>Go</button><textarea>t</textarea></form>": ["a < b", "c é"],
        "<article><header><h1>Title</h1></header><p>text here</p><footer>by me</footer></article><article class=comment>nope</article>": ["Title", "text here"],
        "a < b and c > d <!-- e": ["a < b and c > d"],
        "<script>var a": [], "<div class='ad'>only ad words</div>": [],
    }
    for page, blocks in pages.items():
        assert html_text.extract(page, {}) == "\n\n".join(blocks), page


PROBES = {
    '<div class="sidebar-layout"><div class="sidebar">links here</div><article><p>a b c</p></article></div>': ["a b c"],
    '<div class="site-nav">x</div><article class="share-price"><p>a b c</p></article>': ["a b c"],
    '<article><p>a b</p><section id="related-work"><p>c d</p></section><p>e f</p></article>': ["a b", "c d", "e f"],
    '<article><p>a b</p><p class="search-algorithms">c d</p></article>': ["a b", "c d"],
    '<article><div class="article-header"><h1>T</h1></div><p>a b</p></article>': ["T", "a b"],
    '<article><p>a b</p><ol class="commentlist"><li>me too</li></ol></article>': ["a b"],
    '<article><p>a b</p></article><div id="disqus_thread"><p>me too</p></div>': ["a b"],
    '<div class="cookiebar">we use these</div><article><p>a b</p><div class="cookie-notice">and here</div></article>': ["a b"],
    "<article><p>a b</p><![CDATA[ x > y ]]><p>c</p></article>": ["a b", "c"],
    '<article><p>a</p><div class="related-posts">no</div><div class="ad-free">b</div><div id="comments-2">no</div></article>': ["a", "b"],
    f"<div class=content><p>{'one two three ' * 9}</p><div class='ad-slot'>{'ad ' * 500}</div><p>{'four five ' * 9}</p></div>": [("one two three " * 9).strip(), ("four five " * 9).strip()],
}


def test_names_of_parts_say_no_more_than_that(spark):
    fitted = html_text.fit_weights(spark.createDataFrame([(i, PAGE) for i in range(20)], "page_id long, html string"))
    for weights in ({}, fitted):
        for page, blocks in PROBES.items():
            assert html_text.extract(page, weights) == "\n\n".join(blocks), page
    assert html_text.extract("<![CDATA[ a <p>b" * 1000, {}).startswith("b")


def direct_text(page, weights):
    """The text of the best region, by trying every region of the page."""
    items = list(html_text.events(page))
    value = [html_text.score(("<" if k == "tag" else "") + f, weights) * (1 if k == "tag" else 0 if part else len(v.split())) for k, f, v, part, _ in items]
    best = max(((sum(value[a:b]), -b, a) for a in range(len(items)) for b in range(a + 1, len(items) + 1)), default=(0, 0, 0))
    start, end = (best[2], -best[1]) if best[0] > 0 else (0, 0)
    blocks = [""]
    for kind, _, v, part, _ in items[start:end]:
        if kind == "text":
            blocks[-1] += "" if part else v
        elif v.lstrip("/") not in html_text._INLINE:
            blocks.append("")
    return "\n\n".join(" ".join(b.split()) for b in blocks if b.strip())


def test_whole_pages_equal_trying_every_region():
    rng = random.Random(4)
    for _ in range(200):
        parts = [rng.choice(["<p>one two three</p>", "<div class=nav><a>x</a></div>", "<li>a b</li>", "<div class=text>c d e f</div>", "<td>t</td>", "plain words", "<b>bold</b> on", "<footer>f g</footer>"]) for _ in range(rng.randint(0, 9))]
        page = "".join(parts)
        weights = {"p": rng.random(), "<p": rng.random(), "div.text": rng.random()}
        assert html_text.extract(page, weights) == direct_text(page, weights), page


def test_best_region_is_the_first_maximum_of_all():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.randint(-3, 3) for _ in range(rng.randint(0, 14))]
        runs = [(sum(s[a:b]), -b, a) for a in range(len(s)) for b in range(a + 1, len(s) + 1)]
        top = max(runs, default=(0, 0, 0))[0]
        a, b = html_text.best_region(s)
        assert sum(s[a:b]) == max(top, 0) and (top > 0) == (b > a)
        assert top <= 0 or b == min(-e for total, e, _ in runs if total == top)


def test_long_and_broken_pages_take_time_in_proportion():
    began = time.time()
    for part in ("<a ", "<div>", "</p>", '<a href="x>', "<a '>\" ", "<title>", "<svg>", "<!-- ", '<a ">" ', "<p>w ", "&"):
        html_text.extract(part * (1_000_000 // len(part)), {})
    assert time.time() - began < 60
    words = " ".join(f"w{i}" for i in range(400_000))
    assert html_text.extract(f"<article><p>{words}</p></article>", {}) == words
