"""The block labeller: pages into blocks, gradients, batches against single steps, held-out layouts and whole pages."""

import html
import re

import numpy as np
import pytest

from eventlens.llm import html_text
from eventlens.llm.html_blocks import blocks, vectors
from eventlens.llm.html_layouts import Layouts

SF = "/root/testdata/sf0.001"


def texts(page):
    return [b.text for b in blocks(page)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("", []),
        ("  \n ", []),
        ("no tags &amp; 1 < 2", ["no tags & 1 < 2"]),
        ("<p>one<p>two  <b>bo</b>ld\n\tend", ["one", "two bold end"]),
        ("<p>a<br>b<p><b>c<br><p>d</p>", ["a b", "c", "d"]),
        ("<div>x<!-- <p>no</p> -->y</div>", ["xy"]),
        ("<script>var t='</p>';</SCRIPT ><p>t</p><style>p{}", ["t"]),
        ("<title>no</title><noscript><p>no</p></noscript><p>yes", ["yes"]),
        ('<p title="a > b">q</p><p title=\'x"y>z\'>r</p>', ["q", "r"]),
        ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>", ["1", "2", "3", "4"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("&lt;b&gt; &eacute;&nbsp;&#8364; &copy", ["<b> é € ©"]),
        ("</p>a</b></div>b", ["a", "b"]),
        ("<p>cut<p class='x", ["cut"]),
        ("<!DOCTYPE html><?xml ?><html><body>k</body></html>", ["k"]),
        ("<p>퟿\x00z", ["퟿\x00z"]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_paths_know_open_elements():
    found = blocks('<nav><a href=x>Home</a></nav><div class="comment-list"><p>t</p></div><p>u')
    assert [b.leaf for b in found] == ["nav", "p", "p"] and [b.linked for b in found] == [4, 0, 0]
    assert len({b.path for b in found}) == 3 and vectors(found).shape[0] == 3
    assert found[1].path & ~found[2].path  # the class


def test_long_and_broken_pages_take_linear_time():
    assert len(blocks("<div>" * 50_000 + "x" + "<li>y" * 50_000)) == 50_001
    assert len(blocks('<p a="' * 20_000 + ">" + "<p>z" * 3)) >= 3
    assert texts("<p" * 200_000) == []
    assert len(blocks("a < b " * 100_000)[0].text) == 599_999


def test_gradients():
    rng = np.random.default_rng(1)
    model = html_text.BlockLabeller.fresh(inner=3, hidden=2, kind=np.float64)
    x = rng.random((4, 3, html_text.WIDTH)) * (rng.random((4, 3, html_text.WIDTH)) < 0.05)
    size, y = np.array([4, 2, 3]), (rng.random((4, 3)) < 0.5).astype(float)
    _, grad = model.loss(x, size, y)
    for name, g in grad.items():
        for at in rng.integers(0, g.size, 6):
            w = model.weights[name].reshape(-1)
            old = w[at]
            w[at] = old + 1e-5
            up = model.loss(x, size, y)[0]
            w[at] = old - 1e-5
            down = model.loss(x, size, y)[0]
            w[at] = old
            assert abs((up - down) / 2e-5 - g.reshape(-1)[at]) < 1e-6, name


def plain_logits(model, found):
    """One step after the other, in both directions."""
    w, x = model.weights, vectors(found)
    e = np.tanh(x @ w["ew"] + w["eb"])
    n = w["fu"].shape[0]

    def walk(rows, d):
        h = c = np.zeros(n)
        for row in rows:
            a = row @ w[d + "w"] + h @ w[d + "u"] + w[d + "b"]
            i, f, o, g = 1 / (1 + np.exp(-a[:n])), 1 / (1 + np.exp(-a[n : 2 * n])), 1 / (1 + np.exp(-a[2 * n : 3 * n])), np.tanh(a[3 * n :])
            c = f * c + i * g
            h = o * np.tanh(c)
            yield h

    forward, backward = list(walk(e, "f")), list(walk(e[::-1], "r"))[::-1]
    return np.array([np.concatenate([f, b, v]) @ w["ow"][:, 0] + w["ob"][0] for f, b, v in zip(forward, backward, e, strict=True)])


def test_batches_and_pieces_equal_single_steps(monkeypatch):
    model = html_text.BlockLabeller.fresh(seed=3)
    layouts = Layouts(4, [])
    pages = [html_text.labelled(layouts.page())[0] for _ in range(12)] + [[]]
    want = [plain_logits(model, p) for p in pages]
    for size in (html_text.BATCH, 7):  # with 7, most pages go piece by piece
        monkeypatch.setattr(html_text, "BATCH", size)
        for got, w in zip(model.logits(pages), want, strict=True):
            assert len(got) == len(w) and np.allclose(got, w, atol=1e-4)


@pytest.fixture(scope="module")
def model(spark):
    return html_text.train_labeller(spark.read.parquet(f"{SF}/pages.parquet"), made_up=1500)


def test_held_out_layouts(model):
    layouts = Layouts(77, [])  # other words, another seed
    made = [html_text.labelled(layouts.page()) for _ in range(200)]
    got = np.concatenate(model.logits([b for b, _ in made])) > 0
    assert (got == (np.concatenate([y for _, y in made]) > 0)).mean() > 0.98


PAGE = """<!doctype html><html><head><title>T</title></head><body>
<div class="cookie-banner"><p>We use cookies to improve your experience.</p><button>Accept all cookies</button></div>
<header class="site-header"><h1>The Daily Paper</h1><nav><ul><li><a href="/">Home</a></li><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li></ul></nav></header>
<main><article class="post"><h1>Rain over the northern hills</h1>
<p>The rain that began on Monday has not stopped, and the river rose by two metres overnight.</p>
<p>Residents of the lower town were told to move to higher ground, while volunteers filled bags with sand.</p>
<ul><li>The bridge is closed to all traffic.</li><li>Schools stay open until further notice.</li></ul>
<p>More rain is expected.</p></article></main>
<aside class="sidebar"><h3>Related articles</h3><ul><li><a href="/1">Storm of last year</a></li><li><a href="/2">How dams work</a></li></ul></aside>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I live near the bridge and the water was in my cellar on Tuesday morning already.</p></div></section>
<form class="newsletter"><label>Email address</label><input name="e"><button>Subscribe</button></form>
<footer>&copy; 2024 The Daily Paper. All rights reserved.</footer></body></html>"""


def test_a_page(model):
    text, n = model.main_text([blocks(PAGE)])[0]
    assert text.split("\n\n") == [
        "Rain over the northern hills",
        "The rain that began on Monday has not stopped, and the river rose by two metres overnight.",
        "Residents of the lower town were told to move to higher ground, while volunteers filled bags with sand.",
        "The bridge is closed to all traffic.",
        "Schools stay open until further notice.",
        "More rain is expected.",
    ]
    assert n == 6


def test_pages_of_the_table(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    wrong = 0
    for r in html_text.extract_main_text(pages, model).collect():
        inside = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
        wrong += r.main_text != "\n\n".join(x for x in want if x)
        assert r.n_chars == len(r.main_text) and r.n_main_blocks <= r.n_blocks
    assert wrong <= 1


def test_edges(spark, model):
    rows = [(1, "u", None, "a"), (2, None, "", "b"), (2, None, "", "b"), (3, "u", "<p>" + "word " * 300_000, "c"), (4, "u", "<p>x</p>" * 20_000, "d")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string")
    out = html_text.extract_main_text(df, model)
    assert out.columns == ["page_id", "url", "html", "main_text", "main_text_", "n_chars", "n_blocks", "n_main_blocks"]
    found = {r.page_id: r for r in out.collect()}
    assert out.count() == 5 and found[1].main_text_ == found[2].main_text_ == "" and found[1].main_text == "a"
    assert found[3].n_blocks == 1 and found[4].n_blocks == 20_000
    assert html_text.extract_main_text(df.limit(0), model).collect() == []


def test_query_without_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    df = html_text.op11_html_text(spark, str(tmp_path))
    assert df.columns[:4] == ["page_id", "url", "text", "n_chars"] and df.collect() == []
