"""Names of wrappers, heads without an end tag and self-closed drawings."""

import pytest

from lexmill.llm import html_extraction as H

TEXT = "<p>The river rose again in the night, and by the morning the old bridge was gone.</p>" * 3
ARTICLE = f"<article><h1>The bridge</h1>{TEXT}</article>"


@pytest.mark.parametrize("html", [
    f"<div class='site has-sidebar'>{ARTICLE}</div>", f"<div class='content-sidebar-wrap'>{ARTICLE}</div>", f"<div id='no-sidebar'>{ARTICLE}</div>",
    ARTICLE.replace("<article>", "<article class='post comments-open'>"), f"<div class='has-sidebar'><h1>The bridge</h1>{TEXT}</div>",
    f"<html><head><title>T</title><meta charset=utf-8><body>{ARTICLE}</body></html>", f"<head><title>T</title>{ARTICLE}",
    f"<svg class='icon'/>{ARTICLE}", f"{ARTICLE.replace('</h1>', '<math/></h1>')}",
])
def test_article_is_whole(html):
    assert H.main_text(html).count("The river rose") == 3 and H.main_text(html).startswith("The bridge")


@pytest.mark.parametrize("name", ["sidebar", "comments", "ad", "cookie-notice", "related share"])
def test_parts_that_only_the_name_tells(name):
    html = f"<div class='{name}'><p>Other things that you may like to read, today.</p></div>"
    assert "Other things" not in H.main_text(ARTICLE + html) and "Other things" not in H.main_text(ARTICLE.replace("</article>", html + "</article>"))


def test_drawing_with_an_end_tag_is_no_text():
    assert "drawn" not in H.main_text(f"<svg><text>drawn</text></svg>{ARTICLE}")
