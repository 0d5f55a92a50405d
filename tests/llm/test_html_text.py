"""HTML extraction: made pages held out of training, the given pages, and odd markup."""

import os
import re
from html import unescape

import numpy as np
import pytest

from fareloom.llm import html_text as X
from fareloom.llm.boosting import fit_trees
from fareloom.llm.layouts import labelled_pages

PIECES = [f"Sentence {n} of the story, which goes on for a while and says number {n * 7} twice." for n in range(60)]
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return X.fit(labelled_pages(PIECES, 300), 40)


def wanted(page):
    truth = X._truth(page)
    return page.text([truth[page.home[n]] for n in range(len(page.tag))])


def test_held_out_pages(model):
    pages = labelled_pages(PIECES, 60, seed=5)
    exact = sum(text == wanted(X.Page(html)) for html, text in zip(pages, model.texts(pages), strict=True))
    assert exact >= 54


def test_labels_agree_along_paths(model):
    draw = np.random.default_rng(1)
    for html in labelled_pages(PIECES, 30, seed=8):
        page = X.Page(html)
        nodes, x = X.features(page, model.odds)
        keep = X.decode(page, nodes, draw.normal(0, 3, len(nodes)))
        for n in nodes:
            if n:
                assert not keep[n] or keep[page.home[page.parent[n]]]


def test_text_rules(model):
    page = X.Page("<p>a &amp;&lt;\n  b<br>c<b> d</b>e<p>f<script>x('</p>')</script><ul><li>g<li>h</ul>i &#x41;&eacute;")
    assert page.text([True] * 50) == "a &< b c de\nf\ng\nh\ni Aé"
    assert model.texts([None, "", "no tags  at\nall", "<" , "<div>" * 30_000 + "deep" + "</div>" * 10]) [:4] == ["", "", "no tags at all", "<"]


def test_trees_learn_a_rule():
    x = np.random.default_rng(3).random((2000, 5))
    y = ((x[:, 1] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    found = fit_trees(x[:1500], y[:1500], 30).logits(x[1500:]) > 0
    assert np.mean(found == y[1500:]) > 0.97


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_given_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    found = X.extract(pages, X.train(pages)).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    assert len(found) == len(html)
    for r in found:
        body = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_odd_tables(spark):
    rows = spark.createDataFrame([(None, "u", None, "c"), (1, None, "", "c"), (1, None, "", "c")], "page_id long, url string, html string, text string")
    assert [(r.text, r.n_chars) for r in X.extract(rows, X.train(rows)).collect()] == [("", 0)] * 3
    assert X.extract(rows.limit(0), X.train(rows.limit(0))).count() == 0
