"""Main text of layouts written by hand, which the generator of the training pages doesn't make."""

from __future__ import annotations

import time
import tracemalloc

import numpy as np
import pytest

from foldline.llm import html

BODY = "<h1>Rivers of the north</h1><p>The first river rises in the hills and runs to the sea.</p><p>It was mapped in the last century by two brothers.</p>"
TEXT = "Rivers of the north The first river rises in the hills and runs to the sea. It was mapped in the last century by two brothers."
MENU = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About us</a></li><li><a href='/c'>Contact</a></li></ul></nav>"
FOOT = "<footer><p>Copyright 2020 The Company. All rights reserved.</p></footer>"

LAYOUTS = {
    "plain": f"<html><head><title>t</title></head><body>{MENU}<article>{BODY}</article>{FOOT}</body></html>",
    "head left open": f"<html><head><title>t</title><meta charset=utf-8><body>{MENU}<article>{BODY}</article>{FOOT}",
    "no body tag": f"<head><title>t</title><article>{BODY}</article>{FOOT}",
    "comments in the article": f"<article>{BODY}<section class='comments'><p>nice article mate</p></section></article>{FOOT}",
    "comments as a list": f"<article>{BODY}<ol class='commentlist'><li>Great post, thanks</li><li>I agree with this</li></ol></article>",
    "comments by id": f"<main>{BODY}</main><div id='comments'><h3>2 comments</h3><div class='comment'><b>Ann</b><p>Thanks for this.</p></div></div>",
    "comments in an article of their own": f"<article>{BODY}</article><section id=comments><article class=comment><p>What a great read.</p></article></section>",
    "advert in the article": f"<article>{BODY}<div class='advertisement'>Buy now and save</div></article>",
    "advert between paragraphs": f"<article>{BODY.replace('</p><p>', '</p><div class=ad><a href=/buy>Sponsored offer</a></div><p>', 1)}</article>",
    "aside in the article": f"<article>{BODY}<aside><h3>Related articles</h3><ul><li><a href=/x>Lakes</a></li></ul></aside></article>",
    "unclosed quote": f"<body>{MENU}<article>{BODY}<p title=\"x>Found words.</p><p title=\"y\">Kept words.</p></article>",
    "quote never closed": f"<body><article>{BODY}<p>Last words of it.</p></article><div class='x>",
    "nested lists": f"<article>{BODY}<ul><li>One<ul><li>Inner one<li>Inner two</ul></li><li>Two</li></ul></article>{FOOT}",
    "nested tables": f"<article>{BODY}<table><tr><td>Left<table><tr><td>Deep</td></tr></table></td><td>Right</td></tr></table></article>{FOOT}",
    "table layout": f"<table><tr><td><ul class=menu><li><a href=/>Home</a><li><a href=/b>Blog</a></ul></td><td class=content>{BODY}</td></tr></table>{FOOT}",
    "list after a table in a sidebar": f"<article>{BODY}</article><aside class=sidebar><table><tr><td>Trending</td></tr></table>Most popular posts</aside>",
    "script and style": f"<style>p {{color:red}}</style><script>var a = '<p>no</p>';</script><article>{BODY}<script>if (a < b) {{}}</script></article>",
    "no paragraph ends": "<article>" + BODY.replace("</p>", "") + "</article>" + FOOT,
    "white space and references": "<article>" + BODY.replace("river rises", "river\n\t&nbsp; rises").replace("two brothers", "two&#32;brothers") + "</article>",
    "inline markup": "<article>" + BODY.replace("first river", "<b>first</b> <a href=/r>river</a>").replace("hills and", "hills<br>and") + "</article>",
    "comment and cdata": f"<!-- <article>no</article> --><article>{BODY}<!-- > --></article>",
    "upper case": f"<HTML><BODY><DIV CLASS='Navigation'><A HREF=/>Home</A></DIV><ARTICLE>{BODY}</ARTICLE></BODY></HTML>",
    "cookie banner": f"<div class='cookie-banner'><p>We use cookies on this site.</p><button>Accept</button></div><article>{BODY}</article>",
    "newsletter form": f"<article>{BODY}<form class=newsletter><label>Email</label><input><button>Subscribe</button></form></article>{FOOT}",
    "share bar": f"<article>{BODY}<div class='share-buttons'><a href=/t>Tweet</a> <a href=/f>Share</a></div></article>",
    "main and sidebar": f"<header><div class=logo>The Daily Site</div>{MENU}</header><main>{BODY}</main><div class='sidebar'><h3>Popular</h3><p>Read more of our posts.</p></div>{FOOT}",
    "content div": f"<div id=header>The Daily Site</div><div id=menu><a href=/>Home</a></div><div id=content>{BODY}</div><div id=footer>All rights reserved</div>",
    "wordpress": f"<div id=page><div id=primary class=content-area><article class='post hentry'><div class=entry-content>{BODY}</div></article></div><div id=secondary class=widget-area><h2>Archives</h2></div></div>",
    "breadcrumbs": f"<div class=breadcrumb><a href=/>Home</a> <a href=/r>Rivers</a></div><article>{BODY}</article>",
    "hidden parts": f"<article>{BODY}<noscript>Enable scripts</noscript><template><p>no</p></template><select><option>One<option>Two</select><textarea>write</textarea></article>",
    "login box": f"<div class='login'><form><label>User name</label><input><label>Password</label><input type=password><button>Log in</button></form></div><article>{BODY}</article>",
    "page numbers": f"<article>{BODY}</article><div class='pagination'><a href=/1>1</a><a href=/2>2</a><a href=/3>Next</a></div>",
    "many wrappers": "<div class=container><div class=row><div class=col>" * 30 + f"<article>{BODY}</article>" + "</div></div></div>" * 30 + FOOT,
    "outermost menu": "<nav>" + "<div>" * 100 + "<p>Home and about us and more of our services</p>" + "</div>" * 100 + f"</nav><article>{BODY}</article>",
}
MORE = {
    "nested lists": " One Inner one Inner two Two", "nested tables": " Left Deep Right", "quote never closed": " Last words of it.",
    "unclosed quote": " Found words. Kept words.",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    assert html.main_text(html.trained(), [LAYOUTS[name]]) == [TEXT + MORE.get(name, "")]


def test_ends_of_pages():
    text = lambda page: [b.text for b in html.blocks(page)]
    assert text("if a <b and c") == ["if a <b and c"] and text("<p>x < y") == ["x < y"] and text("<p>1 <2 and 3>2") == ["1 <2 and 3>2"]
    assert text("<p>x</p><div class='a") == ["x"] and text("<p>x</p><di") == ["x"] and text("<p>x</p><!-- rest") == ["x"]


def test_names_of_all_elements_count():
    path = lambda page: html.blocks(page)[-1].path
    slot = lambda x: html._slot(x, html.PATH_DIM)
    assert slot("nav") in path("<nav>" + "<div>" * 500 + "x") and slot(".menu") in path("<div class=menu>" + "<p>" * 3 + "<b>" * 200 + "x")
    # What a closed inner element was called is forgotten, and its outer ones are kept.
    assert set(path("<aside><table><tr><td>in</td></tr></table>after")) == {slot("aside")}
    assert set(path("<ul class=a><li>1<ul><li>2</ul>after")) == {slot("ul"), slot(".a"), slot("li")}


def test_reading_in_chunks_is_the_same(monkeypatch):
    rng, w = np.random.default_rng(5), html.trained()
    pages = sorted((html.blocks(html._example(rng)[0]) for _ in range(6)), key=len, reverse=True)
    whole = html.scores(w, pages)
    alone = [html.scores(w, [p])[:, 0] for p in pages]
    monkeypatch.setattr(html, "BATCH_CELLS", 20)
    cut = html.scores(w, pages)
    for k, p in enumerate(pages):
        assert np.allclose(whole[: len(p), k], alone[k], atol=1e-5) and np.allclose(whole[: len(p), k], cut[: len(p), k], atol=1e-5)


def test_gradients_by_differences():
    rng = np.random.default_rng(6)
    made = sorted((html._example(rng) for _ in range(4)), key=lambda x: -len(html.blocks(x[0])))
    pages = [html.blocks(page) for page, _ in made]
    labels = [rng.integers(0, 2, len(p)).astype(np.float32) for p in pages]
    w = {k: v.astype(np.float64) for k, v in html.init().items()}

    def loss():
        p = html.scores(w, pages).astype(np.float64)
        both = [(p[: len(y), k], y) for k, y in enumerate(labels)]
        return sum(-(y * np.log(a) + (1 - y) * np.log(1 - a)).sum() for a, y in both) / sum(map(len, labels))

    grad = html.gradients(w, pages, labels)
    for name in w:
        at = np.unravel_index(np.abs(grad[name]).argmax(), w[name].shape)
        before = w[name][at]
        w[name][at] = before + 1e-2
        up = loss()
        w[name][at] = before - 1e-2
        down = loss()
        w[name][at] = before
        assert abs((up - down) / 2e-2 - grad[name][at]) < 2e-3 + 0.05 * abs(grad[name][at]), name


def test_very_long_page():
    page = "<article>" + "<p>A few words of it.</p>" * 200_000 + "</article>"
    w = html.trained()
    start = time.time()
    tracemalloc.start()
    text = html.main_text(w, [page])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) == 200_000 * 18 + 199_999 and peak < 250 << 20 and time.time() - start < 240
