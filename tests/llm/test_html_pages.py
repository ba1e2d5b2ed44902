"""Small pages of varied markup, with the text a reader would take for the article."""

import time

import pytest

from lexmill.llm.html_extraction import main_text

ONE = "The first paragraph of the article tells what happened, and it does so at some length."
TWO = "A second paragraph goes on about the same matter, with commas, clauses and a full stop."
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li></ul></nav>'
LINKS = '<ul><li><a href="/a">First link of many</a></li><li><a href="/b">Second link of many</a></li><li><a href="/c">Third link of many</a></li></ul>'
BOTH = f"{ONE}\n{TWO}"
P = f"<p>{ONE}</p><p>{TWO}</p>"

PAGES = {
    "plain paragraphs": (f"<html><body>{P}</body></html>", BOTH),
    "article and menu": (f"<body>{NAV}<article>{P}</article></body>", BOTH),
    "main with heading": (f"<body><header><a href='/'>Site</a></header><main><h1>Title of it</h1>{P}</main><footer>© 2020 Site</footer></body>", f"Title of it\n{BOTH}"),
    "header within the article": (f"<article><header><h1>Title of it</h1></header>{P}</article>", f"Title of it\n{BOTH}"),
    "divs by class": (f'<div class="navbar">Home News Sport</div><div class="content">{P}</div><div class="sidebar">Popular now and here.</div>', BOTH),
    "divs by id": (f'<div id="menu">Home News Sport</div><div id="main">{P}</div><div id="footer">Imprint, contact and terms.</div>', BOTH),
    "list of links": (f"<div>{LINKS}</div><article>{P}</article>", BOTH),
    "article named with a sidebar": (f'<article class="article-with-sidebar">{P}</article>', BOTH),
    "comments enabled": (f'<div class="post-content comments-enabled">{P}</div>', BOTH),
    "part names inside an article": (f'<article>{P}<div class="search-results-analysis"><p>{TWO}</p></div></article>', f"{BOTH}\n{TWO}"),
    "social science": (f'<article>{P}<ul class="social-science"><li>Sociology is the study of groups, said one.</li><li>Economics is the study of choice, said another.</li></ul></article>', f"{BOTH}\nSociology is the study of groups, said one.\nEconomics is the study of choice, said another."),
    "related work": (f'<article>{P}<section id="related-work"><h2>Related work</h2><p>{TWO}</p></section></article>', f"{BOTH}\nRelated work\n{TWO}"),
    "reader comments": (f'<article>{P}</article><div class="comments"><p>I do not agree with this article, to be honest.</p></div>', BOTH),
    "comments in the article": (f'<article>{P}<section class="comments"><p>I do not agree with this, to be honest.</p></section></article>', BOTH),
    "advert in the article": (f'<article><p>{ONE}</p><div class="ad">Buy our shoes now, they are cheap.</div><p>{TWO}</p></article>', BOTH),
    "inline advert": (f'<article><p>{ONE}</p><p>A second <span class="ad">BUY NOW</span>paragraph goes on.</p></article>', f"{ONE}\nA second paragraph goes on."),
    "inline hidden": (f'<article><p>{ONE}</p><p>A <span hidden>secret</span>second <b style="display:none">x</b>one goes on.</p></article>', f"{ONE}\nA second one goes on."),
    "scripts and styles": (f"<head><style>p {{color: red}}</style><script>var a = '<p>no</p>';</script></head><body><article>{P}<script>more()</script></article></body>", BOTH),
    "noscript and template": (f"<article>{P}<noscript>Please enable it.</noscript><template><p>Not shown.</p></template></article>", BOTH),
    "form and button": (f'<article>{P}<form><label>Your mail</label><input><button>Subscribe</button></form></article>', BOTH),
    "aside": (f"<article>{P}<aside><p>Did you know that asides are beside the point?</p></aside></article>", BOTH),
    "cookie notice": (f'<div class="cookie-notice"><p>We use cookies to make this site better for all, and you may accept.</p></div><article>{P}</article>', BOTH),
    "roles": (f'<div role="navigation">Home News</div><div role="main">{P}</div><div role="complementary"><p>Something else that is beside it.</p></div>', BOTH),
    "references and spaces": ("<p>Fish &amp; chips&nbsp;cost\n  5&euro; &#x2013; or   more, as they say in town.</p>", "Fish & chips cost 5€ – or more, as they say in town."),
    "line breaks": (f"<article><p>{ONE}<br>{TWO}</p></article>", BOTH),
    "unclosed paragraphs": (f"<article><p>{ONE}<p>{TWO}</article>", BOTH),
    "no body, no head end": (f"<html><head><title>T</title><p>{ONE}</p><p>{TWO}</p>", BOTH),
    "inline markup": ("<p>Some <b>bold</b> and <i>italic</i> and <a href='/x'>linked</a> words make up this paragraph.</p>", "Some bold and italic and linked words make up this paragraph."),
    "quote and list": (f"<article><p>{ONE}</p><blockquote>He said so, and more than once.</blockquote><ul><li>One point of it.</li><li>Another point.</li></ul></article>", f"{ONE}\nHe said so, and more than once.\nOne point of it.\nAnother point."),
    "table": (f"<article><p>{ONE}</p><table><tr><th>Year<th>Sum<tr><td>1999<td>12</table></article>", f"{ONE}\nYear\nSum\n1999\n12"),
    "short line between paragraphs": (f"<article><p>{ONE}</p><p>No.</p><p>{TWO}</p></article>", f"{ONE}\nNo.\n{TWO}"),
    "self-closed svg": (f'<article><svg class="i"/><p>{ONE}</p><math/><p>{TWO}</p></article>', BOTH),
    "comment of markup": (f"<article><!-- <p>not this</p> --><p>{ONE}</p><p>{TWO}</p></article>", BOTH),
    "one word": ("<p>Hi</p>", "Hi"),
    "bare text": ("Hi", "Hi"),
    "only links": (f"<body>{NAV}{LINKS}</body>", ""),
    "nothing": ("<html><head><title>Only a title</title></head><body></body></html>", ""),
    "broken": ("<p>An unclosed <b>tag and a stray</i></div> end, and then the page ends <a href='x", "An unclosed tag and a stray end, and then the page ends"),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    html, want = PAGES[name]
    assert main_text(html) == want


def test_deep_pages_take_time_in_proportion():
    deep = {n: "<div>" * n + f"<p>{ONE}" + "</div>" * n for n in (2_000, 32_000)}
    stray = {n: "<b>" * n + "text " + "</i></div>" * n for n in (2_000, 32_000)}
    for pages in (deep, stray):
        began = time.time()
        main_text(pages[2_000])
        small = time.time() - began
        began = time.time()
        main_text(pages[32_000])
        assert time.time() - began < 100 * small + 1
    assert main_text(deep[32_000]) == ONE
