"""Tag scanning by the standard's attribute states, decoding against enumeration, the gradient against differences, and hostile pages."""

import itertools
import random
import time

import numpy as np
import pytest

from ledgerline.llm import html_crf


def texts(page):
    return [b[0] for b in html_crf.blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p data-x=it's>One</p><p>Two isn't here</p>", ["One", "Two isn't here"]),
        ('<p title="5" tall">One</p><p>Two</p>', ["One", "Two"]),
        ("<p a=b'c d='e>f'>One</p>", ["One"]),
        ('<p a = "x>y" b>One</p>', ["One"]),
        ('<p a="x>One</p><p>Two</p>', ["One", "Two"]),
        ("<p a=>One</p>", ["One"]),
        ("<p =a>One</p>", ["One"]),
        ("<p a='1'b=\"2\">One</p>", ["One"]),
        ("<p\n\tclass = x\n>One</p\n>", ["One"]),
        ("<!--><p>One</p><!-- <p>no</p> --!><p>Two</p>", ["One", "Two"]),
        ("</ 3 ><p>1 < 2 and 3 <4</p>", ["1 < 2 and 3 <4"]),
        ("<p>One</p><p>cut off <b cl", ["One", "cut off"]),
        ("<p>x<sup>2</sup> <math><mi>y</mi></math>, <object data=a>stand-in</object></p>", ["x2 y, stand-in"]),
    ],
)
def test_tags(page, want):
    assert texts(page) == want


def test_whole_article_after_stray_quotes():
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>T</h1><p data-x=it's>Hello there my friend, how are you.</p><p>Second paragraph isn't here for show.</p></article></body></html>"
    assert html_crf.default_model().extract(page) == "T\nHello there my friend, how are you.\nSecond paragraph isn't here for show."


def test_viterbi_against_all_labellings():
    r = random.Random(2)
    model = html_crf.default_model()
    for page, _ in html_crf.training_pages(40, seed=99):
        found = html_crf.blocks(page, model.known)[:10]

        def value(labels, found=found):
            total = model.starts[labels[0]] + sum(model.moves[a][b] for a, b in itertools.pairwise(labels))
            return total + sum(y * sum(model.weights.get(f, 0.0) for f in [*found[i][1], *html_crf.local_features(found, i)]) for i, y in enumerate(labels))

        if found:
            assert value(model.decode(found)) == pytest.approx(max(value(x) for x in itertools.product((0, 1), repeat=len(found))))
    assert model.decode([]) == [] and r


def test_loss_against_enumeration_and_differences():
    pages = [p for p in html_crf.training_pages(60, seed=5) if len(html_crf.blocks(p[0])) <= 9][:6]
    chains = html_crf.Chains(pages, 1)
    rng = np.random.default_rng(0)
    d = len(chains.index)
    w = rng.normal(size=d + 6)
    loss, gradient = chains.loss(w, 0.01)
    emission = np.bincount(chains.cell, w[chains.feature], chains.n * chains.t).reshape(chains.n, chains.t)
    total = 0.0
    for p in range(chains.n):
        size = int(chains.live[p].sum())

        def value(y, p=p):
            return w[d + 4 + y[0]] + sum(w[d + 2 * a + b] for a, b in itertools.pairwise(y)) + sum(emission[p, i] for i, x in enumerate(y) if x)

        total += np.logaddexp.reduce([value(y) for y in itertools.product((0, 1), repeat=size)]) - value(chains.y[p, :size].tolist())
    assert loss == pytest.approx(total / chains.n + 0.005 * (w @ w))
    for i in [*rng.choice(d, 12, replace=False), *range(d, d + 6)]:
        step = np.zeros(d + 6)
        step[i] = 1e-5
        assert gradient[i] == pytest.approx((chains.loss(w + step, 0.01)[0] - chains.loss(w - step, 0.01)[0]) / 2e-5, abs=1e-6)


@pytest.mark.parametrize(
    "page",
    ["<i>" * 30000 + "</u>" * 30000, "<td>" + "<i>" * 20000 + "<p>x" * 20000, "".join(f"<div class=w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}>x" for i in range(20000)), "<title>" * 50000, "<p a='" * 20000 + '"', "<!--" * 50000, "<" * 100000, "<ul>" + "<li>x" * 50000, "<svg>" * 50000],
    ids=["unknown-ends", "scopes", "deep", "titles", "quotes", "comments", "angles", "items", "svg"],
)
def test_hostile_pages_take_linear_time(page):
    began = time.time()
    html_crf.default_model().extract(page)
    assert time.time() - began < 5


def test_long_broken_and_clashing_rows(spark):
    body = "<p>" + "A sentence of plain words, as ever. " * 2000 + "</p>"
    rows = [(1, "u", f"<article><h1>Title of it</h1>{body * 20}</article>", "c"), (1, "u", f"<article><h1>Title of it</h1>{body * 20}</article>", "c"), (2, "v", "<div" * 5000, None), (None, None, None, None), (3, "w", "\x00<p>퟿&#0;&#xD800;&bogus;&amp</p>", "d")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_crf.extract(df, id_cols=["page_id", "url"]).collect()
    assert len(out) == 5 and all(r.n_chars == len(r.text) for r in out)
    assert [r.n_chars for r in out if r.page_id == 1] == [len("Title of it\n") + 20 * len(("A sentence of plain words, as ever. " * 2000).strip()) + 19] * 2
    assert html_crf.extract(df.limit(0), id_cols=["page_id"]).count() == 0
    with pytest.raises(ValueError, match="text"):
        html_crf.extract(df, id_cols=["page_id", "text"])
