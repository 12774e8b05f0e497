import itertools
import re
from html import unescape

import numpy as np

from matrixloom.llm import html, pages


def test_blocks():
    page = (
        "<head><title>T &amp; t</title><style>p{}</style></head><body><nav><ul><li><a href=x>One</a><li>Two</ul></nav>"
        "<!-- <p>no</p> --><script>var t='</p><p>no';</script><p>foo<b>bar</b> &lt;x&gt;\n\t&nbsp;y<br>z<p>un<i>closed<div class='side-Bar x'>a < b</div>tail"
    )
    found = html.blocks(page)
    assert [b.text for b in found] == ["T & t", "One", "Two", "foobar <x> y z", "unclosed", "a < b", "tail"]
    assert "in:nav" in found[2].around and "in:nav" not in found[3].around and "in:title" in found[0].around
    assert {"name:side", "name:bar"} <= found[5].around and not any(f.startswith("name:") for f in found[6].around)
    assert "links:3" in found[1].own and "links:0" in found[2].own


def test_edge_pages():
    model = html.default_model()
    for page in (None, "", "<", "<!--", "<p", "<script>x", "</p></div>", "<a b='", "&", "<div>" * 3000 + "x"):
        assert isinstance(model.text(page), str)
    assert len(html.blocks("<p>" + "word " * 300_000)) == 1
    assert [b.text for b in html.blocks("plain &eacute; text")] == ["plain é text"]


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(0)
    names = [f"f{i}" for i in range(9)]
    for _ in range(20):
        model = html.Model(dict(zip(names, rng.normal(0, 2, 9))), rng.normal(0, 1, 2), rng.normal(0, 2, (2, 2)))
        chain = [html.Block("x", frozenset(rng.choice(names, 2)), tuple(rng.choice(names, 2))) for _ in range(7)]

        def score(y):
            s = model.first[y[0]] + sum(model.steps[a][b] for a, b in zip(y, y[1:]))  # noqa: B023
            return s + sum(sum(model.weights[f] for f in (*b.around, *b.own)) for b, label in zip(chain, y) if label)  # noqa: B023

        assert np.isclose(score(model.decoded(chain)), max(map(score, itertools.product((0, 1), repeat=7))))


def test_likelihood_rises_and_held_out_pages_are_labelled():
    few, many = (html.fit(pages.labelled(40, 3), rounds=n) for n in (1, 60))
    wrong = []
    for model in (few, many, html.default_model()):
        held = [(html.blocks(p), y) for p, y in pages.labelled(120, 77)]
        wrong.append(sum(a != b for found, y in held for a, b in zip(model.decoded(found), y)) / sum(len(y) for _, y in held))
    assert wrong[1] < wrong[0] / 2 and wrong[2] < 0.03


def article_of(page):
    """What pages of the test tables have between their article's tags."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(" ".join(unescape(re.sub(r"</?b>", "", x)) for x in re.split(r"</?(?:p|h1|br)>", inside)).split())


def test_whole_table(spark, sf):
    rows = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = html.op6(spark, sf).collect()
    assert sorted(r.page_id for r in out) == sorted(rows)
    for r in out:
        assert r.text == article_of(rows[r.page_id].html) and r.n_chars == len(r.text) and r.url == rows[r.page_id].url


def test_edge_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, "u", "<article><p>Some words here, and more of them.</p></article>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS text")
    out = sorted((tuple(r) for r in html.extracted(frame).collect()), key=str)
    assert out == sorted([(1, "u", ""), (1, "u", ""), (None, None, ""), (2, "u", "Some words here, and more of them.")], key=str)
    assert html.extracted(frame.limit(0)).count() == 0


def test_silent_elements_without_an_end_do_not_cut_the_page():
    texts = lambda page: [b.text for b in html.blocks(page)]
    for tag in ("<svg/>", '<svg class="x" />', "<math/>", "<audio src=a>", "<video>", "<object>", "<noscript>"):
        assert texts(f"<p>one</p>{tag}<p>two</p>{tag}<p>three</p>") == ["one", "two", "three"], tag
    assert texts("<p>one</p><svg/><p>two</p><svg><text>no</text></svg><p>three</p>") == ["one", "two", "three"]
    assert texts("<p>one</p><script>no<p>no</p>") == ["one"]
