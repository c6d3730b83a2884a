"""Block reading on broken markup, learning by gradients, and main text of generated and given pages."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest

from lodestar.llm import html_extract as H


@pytest.fixture(scope="module")
def model():
    return H.labeller()


def blocks(source):
    return H.Page(source).texts


def test_blocks_of_broken_markup():
    assert blocks("") == [] and blocks("   ") == []
    assert blocks("just text, 1 < 2 &amp; 3 > 2") == ["just text, 1 < 2 & 3 > 2"]
    assert blocks("<p>a\n  b&nbsp;c<p>d<br>e<b>f</b>g") == ["a b c", "d", "efg"]
    assert blocks("<title>t</title><script>var x='</p><p>no';</script><style>p{}</style><p>yes<!-- <p>no --> still</p>") == ["yes still"]
    assert blocks("<ul><li>one<li>two<ul><li>in</ul><li>three</ul>after") == ["one", "two", "in", "three", "after"]
    assert blocks("<div title='a > b'>x</div></div></p>y") == ["x", "y"]
    assert blocks("<script>never closed <p>x") == [] and blocks("<p>x<!-- never closed") == ["x"]
    assert blocks('<a href="x>unclosed quote<p>t') == ["unclosed quote", "t"]
    assert blocks("&#233;&#x4e2d;&hellip;&unknown;") == ["é中…&unknown;"]
    deep = "<div>" * 3000 + "core" + "</div>" * 3000
    assert blocks(deep) == ["core"]


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    model = H.Labeller.fresh(1)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    sizes = np.array([4, 1, 6])
    x, y = rng.normal(0, 1, (11, H.PATH + H.WORDS + H.SHARES)), rng.integers(0, 2, 11).astype(float)
    _, g = model.gradients(x, sizes, y)
    for name in model.w:
        flat = model.w[name].reshape(-1)
        for k in rng.integers(0, len(flat), 4):
            old = flat[k]
            flat[k] = old + 1e-3
            up, _ = model.gradients(x, sizes, y)
            flat[k] = old - 1e-3
            down, _ = model.gradients(x, sizes, y)
            flat[k] = old
            assert g[name].reshape(-1)[k] == pytest.approx((up - down) / 2e-3, abs=2e-4)


def test_held_out_pages_are_labelled(model):
    rng = random.Random(77)
    pages, labels = [], []
    for _ in range(300):
        p = H.Page(H.labelled_page(rng))
        labels.append(np.array([H._MARK in t for t in p.texts]))
        p.texts = [t.replace(H._MARK, "") or "-" for t in p.texts]
        pages.append(p)
    got = model.label(H.features(pages), np.array([len(p.texts) for p in pages]))
    want = np.concatenate(labels)
    right, found = (got & want).sum() / got.sum(), (got & want).sum() / want.sum()
    assert right > 0.96 and found > 0.96, (right, found)


def test_given_pages_give_their_article(model, spark, sf_dir):
    rows = H.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), model).collect()
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(source)
    same = 0
    for r in rows:
        article = re.search("<article.*?</article>|<article.*", source[r.page_id], re.S)[0]
        same += r.text == "\n".join(blocks(article))
        assert r.n_chars == len(r.text)
    assert same >= 0.99 * len(rows), (same, len(rows))


PAGE = """<!DOCTYPE html><html><head><title>Site</title><style>p{}</style></head><body>
<header class="site-header"><a href="/">The Daily Example</a></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Sports</a></li></ul></nav>
<div class="cookie-notice">We use cookies to improve your experience. <button>Accept all</button></div>
%s
<div class="comments"><h3>2 comments</h3><div class="comment"><b>Anna</b> says: <p>I liked this very much.</p></div></div>
<aside class="sidebar"><h3>Related articles</h3><ul><li><a href="/x">Other story</a></li></ul></aside>
<form class="newsletter"><label>Your e-mail</label><button>Subscribe</button></form>
<footer>&copy; 2024 The Daily Example. All rights reserved.</footer><script>track()</script></body></html>"""


@pytest.mark.parametrize("frame", ["<article>{}</article>", '<div class="post-content">{}</div>', '<main><div id="content">{}</div></main>'])
def test_an_article_among_furniture(model, frame):
    body = "<h1>A quiet morning by the river</h1><p>The water was low that day, and the boats lay on the sand.</p><div class='ad'>Advertisement</div><p>Nobody spoke of it later; the letters say nothing.</p><ul><li>first point of the story</li><li>second point of the story</li></ul>"
    got = H.main_texts(model, [PAGE % frame.format(body)])[0]
    assert got.split("\n") == ["A quiet morning by the river", "The water was low that day, and the boats lay on the sand.", "Nobody spoke of it later; the letters say nothing.", "first point of the story", "second point of the story"]


def test_nulls_empty_tables_and_long_pages(model, spark):
    long = "<article>" + "<p>word another word, and more of it.</p>" * 20000 + "</article>"
    rows = [(1, "u", None, 5), (2, None, "", 5), (None, "u", "<article><p>Some text of an article here.</p></article>", 5), (3, "u", long, 5), (3, "u", long, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r.page_id or 0), r.n_chars, r.text.count("\n")) for r in H.extract(pages, model).collect())
    assert got[1:3] == [(1, 0, 0), (2, 0, 0)] and got[3] == got[4]
    assert got[3][2] == 19999
    assert H.extract(pages.limit(0), model).collect() == []


@pytest.mark.parametrize(
    ("source", "texts"),
    [
        ("<article><p>one</p><svg><p>two</p><p>three</p></article>", ["one", "two", "three"]),
        ('<p>a</p><svg width="1"/><p>b</p><video><p>c</p></video>', ["a", "b", "c"]),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", ["so x=2 holds"]),
        ("<noscript><p>plain</p></noscript><script>var a = '<p>no</p>'</script>", ["plain"]),
        ("<p>a</p><!-- x > y", ["a"]),
        ("x < y and <b", ["x < y and <b"]),
    ],
)
def test_no_text_is_lost(source, texts):
    assert H.Page(source).texts == texts


@pytest.mark.parametrize("flood", ["<a ", "<!", "<a '", "</a", "<![CDATA[", '<a href="x '])
@pytest.mark.parametrize("end", ["", "<p>z</p>"])
def test_floods_of_open_tags_are_read_in_linear_time(flood, end):
    start = time.perf_counter()
    H.Page(flood * (1_000_000 // len(flood)) + end)
    assert time.perf_counter() - start < 5
