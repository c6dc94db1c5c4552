"""Made pages whose article is known, the table's own pages against a plain reading of their template, and odd pages at length."""

import html
import random
import re
import time

import pytest

from loamwork.llm.common import table
from loamwork.llm.main_text import blocks, extract_main_text, main_text

WORDS = "the river of valley is a place that was known to all people in old town and it has been so for long time they would walk from mill church".split()
OTHER = "Home News Sport Login Basket Prices Jobs Travel Weather Archive".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def links(r, n):
    return "".join(f'<li><a href="/{w}">{w}</a></li>' for w in r.choices(OTHER, k=n))


def made_page(seed):
    """(html, article blocks). What stands around the article is prose or links that only its place or name tells apart."""
    r = random.Random(seed)
    article = [sentence(r, 4)] + [" ".join(sentence(r, r.randint(8, 16)) for _ in range(r.randint(2, 5))) for _ in range(r.randint(2, 6))]
    if r.random() < 0.5:
        article.insert(2, sentence(r, 5))  # a short one between long ones
    if r.random() < 0.3:
        article.append(article[-1] + " © 1990 & so <on>")
    body = [f"<h1>{html.escape(article[0])}</h1>"]
    for x in article[1:]:
        words = html.escape(x).split(" ")
        if r.random() < 0.3:
            words[1] = f"<b>{words[1]}</b>"
        body.append("<p>" + r.choice([" ", "\n", "  "]).join(words) + r.choice(["</p>", "", "</p>\n"]))
    prose = lambda: sentence(r, 12) + " " + sentence(r, 9)
    inside = [
        f'<aside><p>{prose()}</p></aside>', f'<div class="ad-slot">{prose()}</div>', f"<form><label>{prose()}</label><input></form>", f'<div class="share-links">{sentence(r, 6)}</div>',
        f'<section id="comments"><p>{prose()}</p><div class="comment-content">{prose()}</div></section>', f"<script>var a = '<p>{prose()}</p>';</script>", "<!-- <p>not this</p> -->", f"<style>p {{ {prose()} }}</style>",
    ]
    for x in r.sample(inside, r.randint(0, 4)):
        body.insert(r.randint(2, len(body)), x)
    kind = r.choice(["<article>{}</article>", '<main class="page">{}</main>', '<div class="content has-sidebar">{}</div>', '<div class="article search-page">{}</div>', '<div role="main">{}</div>', '<div id="postBody" class="post-body">{}</div>'])
    around = [f"<header><p>{prose()}</p></header>", f"<nav><ul>{links(r, 5)}</ul></nav>", f'<div class="cookie-notice"><p>{prose()}</p></div>', f'<div id="sidebar"><p>{prose()}</p><ul>{links(r, 3)}</ul></div>', f'<div class="topbar">{sentence(r, 5)}</div>']
    below = [f"<footer><p>{prose()}</p></footer>", f'<div class="comments"><p>{prose()}</p></div>', f'<div class="newsletter-signup">{prose()}</div>', f"<p>&copy; {sentence(r, 6)}</p>", f"<ul>{links(r, 4)}</ul>"]
    r.shuffle(around)
    page = "<!DOCTYPE html><html><head><title>T</title></head><body>" + "".join(around[: r.randint(0, 5)]) + kind.format("".join(body)) + "".join(r.sample(below, r.randint(0, 4))) + "</body></html>"
    return page, article


@pytest.mark.parametrize("seed", range(200))
def test_made_pages_give_their_article(seed):
    page, article = made_page(seed)
    assert main_text(page).split("\n") == [" ".join(x.split()) for x in article]


def plain_article(page):
    """The article of the table's template, by splitting at its few block tags."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    found = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:h1|p)>", inside)]
    return [x for x in found if x]


def test_pages_of_the_table(spark):
    for r in extract_main_text(table(spark, "/root/testdata/sf0.01", "pages")).collect():
        assert r.text.split("\n") == plain_article(r.html) and r.n_chars == len(r.text)


PROSE = "It is a long way to the town and the people of the valley know that it has been so for all of the time. " * 3


@pytest.mark.parametrize("name", ["content has-sidebar", "article search-page", "content no-share", "post with-comments", "page-with-sidebar", "form", "widget", "comment"])
def test_names_do_not_lose_the_only_article(name):
    assert main_text(f'<body><div class="nav"><a href=x>Home</a></div><div class="{name}"><p>{PROSE}</p><p>{PROSE}</p></div></body>') == "\n".join([PROSE.strip()] * 2)


def test_teasers_do_not_lose_the_prose_outside():
    teaser = "<article><h3>Look at this</h3><p>One short teaser of the day.</p></article>"
    got = main_text(f"<body><h1>The town</h1><p>{PROSE}</p><p>{PROSE}</p><p>© {PROSE}</p>{teaser}{teaser}</body>")
    assert got.split("\n")[:4] == ["The town", PROSE.strip(), PROSE.strip(), "© " + PROSE.strip()]


@pytest.mark.parametrize("unit", ["<p x=", '<a "', "<a '\"", '<a "x>" ', "<", "</", "<!--", "<p>", "<div>", "</div>", "<script>", "<a b c ", "&amp", "<p x='>", "a     b", '<b class="x', "<!", "<script><"])
def test_long_odd_pages_take_little_time(unit):
    began = time.time()
    blocks(unit * (1_000_000 // len(unit)))
    assert time.time() - began < 8


def test_quotes_that_never_close():
    assert main_text(f'<article><p title="a > b">{PROSE}</p><p class="x>{PROSE}</article>') == "\n".join([PROSE.strip()] * 2)
    assert main_text(f"<article><p>{PROSE}</p><p x=") == PROSE.strip()


def test_raw_elements_close_as_in_browsers():
    inner = "".join(f"<p>{k} {PROSE}</p>" for k in range(5))
    want = "\n".join(f"{k} {PROSE.strip()}" for k in range(5))
    for page in (f"<body><script>var x = '<p>no';</script x><article>{inner}</article>", f"<body><style>p</style/><article>{inner}</article>", f"<body><article>{inner}</article><script>never closed <p>{PROSE}</p>"):
        assert main_text(page) == want
    for tag in ("svg", "object", "canvas", "select", "video", "noscript", "math"):
        first, rest = inner.split("</p>", 1)
        assert main_text(f"<body><article>{first}</p><{tag} width=1>{rest}</article>") == want, tag
        assert main_text(f"<body><article>{first}</p><{tag}>{PROSE}</{tag} >{rest}</article>") == want, tag
    began = time.time()
    blocks("<svg><object>" * 100_000)
    assert time.time() - began < 8


def test_a_readers_post_is_not_the_article():
    own = "".join(f"<p>{k} {PROSE}</p>" for k in range(3))
    reader = f"<p>I {PROSE}</p><p>You {PROSE}</p>"
    want = "\n".join(f"{k} {PROSE.strip()}" for k in range(3))
    assert main_text(f'<body><div>{own}</div><div class="user-post">{reader}</div></body>') == want
    assert main_text(f'<body><div class="main-post">{own}</div><div><p>{PROSE}</p></div></body>') == want
    # a name of content on the smaller part takes nothing from the rest
    assert main_text(f'<body><div>{own}</div><div class="post">{reader}</div></body>').startswith(want)


def bare_page(seed):
    """(html, article blocks) of a page without container or telling name: only density and links tell the article."""
    r = random.Random(seed)
    article = [" ".join(sentence(r, r.randint(12, 20)) for _ in range(r.randint(4, 7))) for _ in range(r.randint(3, 6))]
    body = [f"<p>{html.escape(x)}</p>" for x in article]
    if r.random() < 0.5:
        article.insert(2, sentence(r, 5))
        body.insert(2, f"<p>{article[2]}</p>")
    bar = lambda n: "<ul>" + links(r, n) + "</ul>"
    top = "".join(f"<div>{bar(r.randint(3, 7))}</div>" for _ in range(r.randint(1, 2)))
    bottom = f"<div>{bar(r.randint(3, 6))}</div><p>© 2020 Town Press</p><table><tr><td><a href=/x>{sentence(r, 9)}</a></td></tr></table>"
    return f"<html><body>{top}<div><div>{''.join(body)}</div></div>{bottom}</body></html>", article


@pytest.mark.parametrize("seed", range(100))
def test_pages_without_containers_give_their_article(seed):
    page, article = bare_page(seed)
    assert main_text(page).split("\n") == article
