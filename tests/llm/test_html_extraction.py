import itertools
import random

import pytest

from lexmill.llm import html_extraction as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";x(1<2)</script></head><body>
<header class="site-header"><a href="/">Home</a> The Daily</header>
<nav><ul><li><a href=1>One</a><li><a href=2>Two, and more.</a></ul></nav>
<div class="cookie-notice">We use cookies to make this site better for all our readers. Accept?</div>
<div id="sidebar"><p>Popular stories that you should read right now, today, please.</p></div>
<article><h1>Title &amp; more</h1><p><b>First  para
graph&nbsp;here.<br><p>Second &lt;b&gt; with <a href="x">a link</a> in it.<p>Short.
<div class="ad">Buy now. It is a very good thing to buy, all say so.</div><!-- no <p>text</p> -->
<form><p>Your name, please, and your address.</p><input></form><ul><li>An item<li>Another item.</ul>
<blockquote>Quoted words.</blockquote></article>
<section class="comments"><p>Reader: what a fine article this is, I read it twice and liked it.</p></section>
<aside>More of this.</aside><footer>&copy; example &middot; All words reserved here.</footer></body></html>"""


def test_page():
    assert H.main_text(PAGE) == "Title & more\nFirst para graph here.\nSecond <b> with a link in it.\nShort.\nAn item\nAnother item.\nQuoted words."


def test_page_without_article():
    p = "<p>" + "Words that make a sentence, and more of them here. " * 5 + "</p>"
    html = f"<body><ul class=menu><li><a href=1>Home</a></ul><div class=post-content><h2>Head</h2>{p}<p>Yes.</p>{p}</div><div><a href=1>a</a> <a href=2>b</a></div><p>Terms</p></body>"
    lines = H.main_text(html).split("\n")
    assert lines[0] == "Head" and "Yes." in lines and not {"Home", "a b"} & set(lines)


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "<p>", "</p></div>", "<!--", "<script>x", "<a href='>", "<p title=\"a>b\">", "&#0;&bogus;&#xD800;", "<" * 5000, "<b>" * 3000, "<div>" * 3000 + "x"])
def test_damaged(html):
    assert isinstance(H.main_text(html), str)


def test_long_page_is_whole():
    html = "<article>" + "".join(f"<p>Paragraph {i} has some words in it.</p>" for i in range(5000)) + "</article>"
    assert H.main_text(html).count("\n") == 4999


@pytest.mark.parametrize("seed", range(40))
def test_cut_is_least(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    score = [rng.choice([-2, -1, -0.5, 0, 0.5, 1, 2]) * rng.choice([1, 1, 3]) for _ in range(n)]
    edges = {(i, j): rng.choice([0.25, 0.5, 1.0, 2.0]) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5}

    def cost(side):
        return sum(-s if x else s for s, x in zip(score, side, strict=True) if (s < 0) == x and s) + sum(w for (i, j), w in edges.items() if side[i] != side[j])

    best = min(itertools.product([False, True], repeat=n), key=lambda s: (round(cost(s), 9), sum(s)))
    got = H.min_cut(score, edges)
    assert abs(cost(got) - cost(best)) < 1e-9 and sum(got) == sum(best)


def test_columns(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "y"), (None, "v", "<p>", "z"), (1, "u", PAGE, "x")]
    got = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", len(H.main_text(PAGE)))] * 2 + [("2", 0), ("None", 0)]
    assert all(len(r.text) == r.n_chars for r in got)
    assert H.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
