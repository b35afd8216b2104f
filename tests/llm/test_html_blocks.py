import html as h
import re
import time

import numpy as np
import pytest

from tarnwell.llm import html_blocks as op


@pytest.fixture(scope="module")
def labeller(spark):
    return op.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def wanted(page):
    article = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = [" ".join(h.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
    return "\n".join(p for p in parts if p)


def test_pages_of_another_table(spark, labeller):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = op.extract(pages, labeller=labeller).collect()
    assert len(got) == len(html)
    assert [r.page_id for r in got if r.text != wanted(html[r.page_id])] == []
    assert all(r.n_chars == len(r.text) for r in got)


def words(n, seed=0):
    return " ".join(f"word{(i * 7 + seed) % 50}" for i in range(n)) + "."


def test_other_layouts(spark, labeller):
    body = [words(40 + i, i) for i in range(6)]
    paragraphs = "".join(f"<p>{b}</p>" for b in body)
    page = (
        '<html><body><div class="menu"><ul><li><a href="/">Home</a><li><a href="/b">News</a></ul></div><div class="cookie-notice"><p>We use cookies.</p></div>'
        f'<div class="content">{paragraphs}</div><div class="sidebar"><ul><li><a href="/x">Most read</a></li></ul></div>'
        '<form class="subscribe"><label>Your mail</label></form><section class="comments"><div class="comment"><p>Nice one thanks</p></div></section><div class="footer"><p>Imprint</p></div></body></html>'
    )
    got = op.extract(spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string"), labeller=labeller).first()
    assert got.text == "\n".join(body)


def test_blocks():
    page = "<p>a &amp; b<br>c <b>d</b><p>e&nbsp;f<!-- x --><script>var t='</p>';</script><ul><li>g<li>h</ul><p>i < j <img src='>'>k</p><td>z"
    assert [b.text for b in op.blocks(page)] == ["a & b c d", "e f", "g", "h", "i < j k", "z"]
    assert op.blocks("") == [] and op.blocks("<script>never closed") == [] and [b.text for b in op.blocks("bare &#233; text")] == ["bare é text"]


def test_gradients():
    rng = np.random.default_rng(0)
    model = op.Labeller(width=4, hidden=3)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x, mask = op.padded([rng.normal(size=(5, 4)), rng.normal(size=(3, 4))])
    x = x.astype(np.float64)
    d = rng.normal(size=(5, 2, 3)) * mask[:, :, None]
    for way in "fb":
        loss = lambda: float((model.run(x, mask, way, False)[0].astype(np.float64) * d).sum())  # noqa: B023, E731
        grads = {k: np.zeros_like(v) for k, v in model.weights.items()}
        model.back(x, mask, way, model.run(x, mask, way, True)[1], d, grads)
        for name in (way + "x", way + "h", way + "c"):
            flat = model.weights[name].reshape(-1)
            for i in rng.integers(0, flat.size, 4):
                old = flat[i]
                flat[i] = old + 1e-3
                up = loss()
                flat[i] = old - 1e-3
                down = loss()
                flat[i] = old
                assert grads[name].reshape(-1)[i] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-3)


def test_edge_cases(spark, labeller):
    deep = "<div>" * 3000 + "x"
    rows = [(1, None, None, "a"), (None, "u", "", "b"), (2, "u", deep, "c"), (2, "u", deep, "c"), (3, "u", "<p>" + "long text " * 50_000, "d")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = op.extract(df, labeller=labeller).collect()
    assert len(got) == 5 and got[0].text == "" and got[1].text == ""
    assert op.extract(df.limit(0), labeller=labeller).count() == 0
    assert op.extract(df).count() == 5  # no page that can teach


def test_scripts_and_drawings_do_not_split_a_line():
    page = "<p>one <script>var a = '<p>';</script>two <svg><path d='x'/></svg>three<style>p{}</style> <iframe src=x>no</iframe>four<noscript>n</noscript><svg/></p><p>&am<b>p; x</b></p>"
    assert [b.text for b in op.blocks(page)] == ["one two three four", "&amp; x"]


@pytest.mark.parametrize("piece", ["<a href=x", "<a href=x ", "<div>", "<b>", "<a title=\"", "</b>", "<!--", "<p><b>", "<td><b><th>", "< ", "<x y='"])
def test_broken_pages_take_linear_time(piece):
    page = "<table><tr><th>" + piece * (1_000_000 // len(piece))
    begin = time.process_time()
    op.blocks(page)
    assert time.process_time() - begin < 4


def test_quotes_and_signs():
    assert [b.text for b in op.blocks("<p title='a>b' x=\"c\" \">one</p> a < b <3 </ x>c")] == ["one", "a < b <3 c"]
    assert [b.text for b in op.blocks("<div>a<div>b</div></span>c</div><p>d<unknown>e")] == ["a", "b", "c", "d", "e"]


def test_deep_nesting_with_text_keeps_paths_short():
    page = "<article>" + "<div>text " * 4000
    found = op.blocks(page)
    assert sum(len(b.text.split()) for b in found) == 4000 and max(len(b.path) for b in found) <= op.NAMES_KEPT
    assert all(b.label == 1 for b in found)


def test_long_pages_teach(spark):
    pages = [(i, f"<html><body><nav><a>Home</a></nav><article>{'<p>' + words(30, i) + '</p>'}</article><footer>Imprint</footer><!--{'x' * 300_000}--></body></html>") for i in range(12)]
    df = spark.createDataFrame(pages, "page_id bigint, html string")
    read = op.teaching(df, "page_id", "html")
    assert len(read) == 12 and all([b.label for b in page] == [0, 1, 0] for page in read)
