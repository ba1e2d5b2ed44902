"""Forms around pages, controls in sentences, names of two words."""

import pytest

from lexmill.llm.html_extraction import main_text

ONE = "The first paragraph of the article tells what happened, and it does so at some length."
TWO = "A second paragraph goes on about the same matter, with commas, clauses and a full stop."
BOTH = f"{ONE}\n{TWO}"
P = f"<p>{ONE}</p><p>{TWO}</p>"
SAYS = "<p>I do not agree with this article, to be honest with you all.</p>"

PAGES = {
    "form around the page": (f'<form><div id="content"><article>{P}</article></div></form>', BOTH),
    "form around the page, no article": (f'<form id="aspnetForm"><div>{P}</div><div><label>Name</label><input><button>Log in</button></div></form>', BOTH),
    "form around an article that is a small part": (f'<form><article><p>{ONE}</p></article></form><div>{"<p>Lots of other words that follow one another here.</p>" * 9}</div>', ONE),
    "form of a newsletter": (f"<article>{P}</article><form><p>Get our newsletter by mail each day.</p><label>Your mail</label><input><button>Subscribe</button></form>", BOTH),
    "form in an article": (f"<article><p>{ONE}</p><form><p>Write to us about it.</p><select><option>One</option></select></form><p>{TWO}</p></article>", BOTH),
    "controls in a sentence": (f"<article><p>{ONE}</p><p>Press <button>Start</button> and then <label>the bell</label> rings at once.</p></article>", f"{ONE}\nPress Start and then the bell rings at once."),
    "controls alone": (f"<article><p>{ONE}</p><button>Share</button> <button>Save</button><p>{TWO}</p><label>Your view</label></article>", BOTH),
    "fieldset": (f"<article><p>{ONE}</p><fieldset><legend>Of the matter</legend><p>{TWO}</p></fieldset></article>", f"{ONE}\nOf the matter\n{TWO}"),
    "wrapper named after a part": (f'<div class="sidebar-wrapper"><h1>Title of it</h1>{P}</div>', f"Title of it\n{BOTH}"),
    "layout names": (f'<div class="content-sidebar-wrap"><article class="comments-open">{P}</article></div>', BOTH),
    "related work": (f'<article>{P}<section id="related-work"><p>{TWO}</p></section></article>', f"{BOTH}\n{TWO}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    html, want = PAGES[name]
    assert main_text(html) == want


@pytest.mark.parametrize("name", ["reader-comments", "comment-list", "user-comments", "sidebar-left", "ad-slot", "cookie-bar", "commentsArea", "related-posts", "share_buttons", "site-navigation"])
def test_parts_by_names_of_two_words(name):
    for html in (f'<article>{P}<div class="{name}">{SAYS}</div></article>', f'<article>{P}</article><div id="{name}">{SAYS}</div>', f'<form><article>{P}<section class="{name}">{SAYS}</section></article></form>'):
        assert main_text(html) == BOTH
