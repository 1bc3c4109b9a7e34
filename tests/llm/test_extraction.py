"""Roles of boxes inside and outside the article, and generated pages against their own markup."""

import html
import re

import pytest

from tidemark.llm import extraction

BODY = "".join(f"<p>{'words of the article text ' * 10}</p>" for _ in range(3))
TEXT = " ".join(("words of the article text " * 10).strip() for _ in range(3))
JUNK = "article-comments main-menu article-footer page-footer page-header main-sidebar post-notice content-ad entry-share user-reviews site-info userReviews commentList"


@pytest.mark.parametrize("name", JUNK.split())
@pytest.mark.parametrize("outer", ["<article>%s</article>", "<div id=main>%s</div>", "<main><div class=post-body>%s</div></main>"])
def test_boxes_of_a_known_role_go_wherever_they_stand(name, outer):
    box = f"<div class='{name}'><p>{'junk said the reader at length ' * 20}</p></div>"
    assert extraction.extract(f"<html><body><nav><a href=x>h</a></nav>{outer % (BODY + box)}</body></html>") == TEXT


LEAKED = "usercomments cmt-list feedback-thread responses thread talkback Guestbook kommentare commentaires see-also post-meta tags-list toolbox paywall author-bio related-posts social-links ad-slot-2 comments-area"
ABOUT = "discussion search-engines share-prices related-work reviews notice-period story-of-the-ads social-history comment-on-law colophon"


@pytest.mark.parametrize("name", LEAKED.split())
@pytest.mark.parametrize("outer", ["<article>%s</article>", "<div id=main>%s</div>"])
def test_other_names_of_boxes_go_too(name, outer):
    box = f"<div class='{name}'><p>{'junk said the reader at length ' * 20}</p></div>"
    assert extraction.extract(f"<html><body>{outer % (BODY + box)}</body></html>") == TEXT


@pytest.mark.parametrize("name", ABOUT.split())
def test_names_that_are_about_something_keep_their_text(name):
    part = f"<div class='{name}' id='{name}'><p>{'a part of the article ' * 20}</p></div>"
    assert extraction.extract(f"<html><body><article>{BODY}{part}</article></body></html>") == f"{TEXT} {('a part of the article ' * 20).strip()}"


def test_formulas_and_field_sets_of_the_article_stay():
    more = "<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p><fieldset><p>framed words of the text</p></fieldset>"
    assert extraction.extract(f"<body><article>{BODY}{more}</article></body>") == f"{TEXT} so x=2 holds framed words of the text"


def test_links_inside_the_article_stay():
    links = "<ul><li><a href=1>one</a><li><a href=2>two</a></ul>"
    assert extraction.extract(f"<body><article>{BODY}{links}</article>{links}</body>") == f"{TEXT} one two"


@pytest.mark.parametrize("outer", ["<div class='content-sidebar-wrap'>%s</div>", "<div class='has-sidebar'>%s</div>", "<article class='post comments-open'>%s</article>", "<article><header class='entry-header'></header>%s</article>"])
def test_names_that_only_mention_a_role_keep_their_text(outer):
    assert extraction.extract(f"<body>{outer % BODY}<div class=sidebar>side</div></body>") == TEXT


def test_comments_marked_up_as_articles_go():
    comment = f"<article class='comment'><p>{'a reader says so ' * 30}</p></article>"
    assert extraction.extract(f"<body><article class=post>{BODY}</article>{comment}</body>") == TEXT


def test_densest_box_wins_without_any_names():
    menu = "<div>" + "".join(f"<a href={i}>item {i}</a> " for i in range(30)) + "</div>"
    assert extraction.extract(f"<body>{menu}<div><div>{BODY}</div></div>{menu}</body>") == TEXT


def test_generated_pages_equal_their_markup(spark):
    for r in extraction.main_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), ("page_id", "html")).collect():
        inner = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner[1])) if inner else ""
        assert r.text == " ".join(html.unescape(plain).split())


def test_empty_table(spark):
    assert extraction.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
