"""Main text of pages without an article element, odd attributes and names."""
import random

import pytest

from sourceloom.llm.html import main_text

LONG = "This paragraph, which is long, goes on with commas, clauses, and other things, so that it weighs more, much more, than the rest of the page, and on, and on."
SHORT = "A shorter paragraph without much weight stands here."
MENU = '<div class="top-menu"><ul><li><a href=/>Home</a></li><li><a href=/n>News of today, and more</a></li></ul></div>'
FOOT = '<div id="footer"><p>Copyright, all rights reserved, and so on, for everything on this page, by the owner of this page.</p></div>'


def page(body):
    return f"<html><head><title>T</title></head><body>{MENU}{body}{FOOT}</body></html>"


def test_every_block_of_a_wrapper():
    blocks = [LONG * 4] + [f"{SHORT} {i}" for i in range(5)]
    assert main_text(page("<div>" + "".join(f"<div><p>{b}</p></div>" for b in blocks) + "</div>")).split("\n\n") == blocks


def test_section_after_section_with_a_list():
    html = f"<section><p>{LONG}</p><p>{LONG}</p></section><section><h2>Next</h2><p>{SHORT}</p><ul><li>one thing</li><li>another</li></ul></section>"
    assert main_text(page(html)).split("\n\n") == [LONG, LONG, "Next", SHORT, "one thing", "another"]


def test_wrappers_in_wrappers():
    html = (f"<div><h1>Title</h1><div><div><p>{LONG}</p><p>{LONG}</p></div></div><div><div><p>{SHORT}</p></div></div>"
            f"<div><a href=1>one link</a> <a href=2>another link of some length, with commas, and more</a></div></div>")
    assert main_text(page(html)).split("\n\n") == ["Title", LONG, LONG, SHORT]


@pytest.mark.parametrize("attribute", ["title=it's", "title='a > b'", 'title="it\'s"', "data-x=a\"b", "alt = 'x' title=don't", "data-class=ad", 'title="class=ad hidden"'])
def test_attributes_as_browsers_read_them(attribute):
    assert main_text(page(f"<div><p>{LONG}</p><p {attribute}>{SHORT}</p><p>isn't lost</p><p>{SHORT}</p></div>")).split("\n\n") == [LONG, SHORT, "isn't lost", SHORT]


@pytest.mark.parametrize("names", ["share-price", "social-history", "content comments-enabled", "legal-history", "post-header", "notice-period", "headerless", "ad-hoc"])
def test_names_of_the_article(names):
    assert SHORT in main_text(page(f'<article><p>{LONG}</p><div class="{names}"><p>{SHORT}</p></div></article>'))


@pytest.mark.parametrize("names", ["ad", "ad-slot-2", "share-buttons", "socialShare", "main-nav", "post-comments", "comment-body", "x cookie-banner", "content sidebar", "related-posts1 related", "newsletter_signup"])
def test_names_of_what_is_not(names):
    for kind in ("class", "id"):
        assert SHORT not in main_text(page(f'<article><p>{LONG}</p><div {kind}="{names}"><p>{SHORT}</p></div></article>'))
    assert SHORT not in main_text(page(f"<article><p>{LONG}</p><div hidden><p>{SHORT}</p></div></article>"))


@pytest.mark.parametrize("seed", range(20))
def test_pages_without_article(seed):
    """Random wrappers: every prose block comes out in page order, nothing of what stands around."""
    r = random.Random(seed)
    want = []

    def prose():
        want.append(" ".join(f"word{r.randrange(900)}{r.choice(['', ',', '.'])}" for _ in range(r.choice([14, 30, 120]))))
        return f"<p>{want[-1]}</p>"

    def side():
        return r.choice(['<div class="share-buttons"><a href=1>share this page, please</a></div>', '<aside><p>An advert, which is here, to be read.</p></aside>',
                         '<form><p>Your name, and address, please fill them in</p></form>', "", ""])

    def block(depth):
        inner = "".join(prose() + side() for _ in range(r.randint(1, 3))) if depth == 0 else "".join(block(depth - 1) for _ in range(r.randint(1, 3)))
        tag = r.choice(["div", "section"])
        return f"<{tag}>{inner}</{tag}>"

    html = page(f"<div>{block(2)}{block(1)}{side()}</div>")
    assert main_text(html).split("\n\n") == want


def test_very_long_and_empty_pages():
    many = "".join(f"<div><p>{SHORT} {i}</p></div>" for i in range(20_000))
    assert main_text(page(f"<div>{many}</div>")).count("\n\n") == 19_999
    deep = "<div>" * 3000 + f"<p>{LONG}</p>" + "</div>" * 3000
    assert main_text(page(deep)) == LONG
    assert main_text("") == "" and main_text("<p>") == "" and main_text("<!-- never closed") == ""
