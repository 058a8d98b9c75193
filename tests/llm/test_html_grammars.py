"""Block labels on grammars that the model was not trained on, odd markup, and the edge cases of a table of pages."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.llm import html_text

LONG = "The first sentence of this paragraph runs on for quite a while, as sentences do. Another one follows it, and it is no shorter than the one before."


@pytest.fixture(scope="module")
def model():
    return html_text.train()


def _f1(model, grammar, pages=100):
    rng, hit, wrong = np.random.default_rng(77), 0, 0
    for _ in range(pages):
        page, want = html_text.written_page(rng, grammar)
        blocks = html_text.leaf_blocks(page)
        assert len(blocks) == len(want), page
        got, want = html_text.label([blocks], model)[0], np.array(want)
        hit, wrong = hit + 2 * int((got & want).sum()), wrong + int((got ^ want).sum())
    return hit / (hit + wrong)


@pytest.mark.parametrize("grammar", html_text.HELD_OUT, ids=lambda g: g.__name__)
def test_grammars_never_trained_on(model, grammar):
    assert grammar not in [g for g, _ in html_text.GRAMMARS]
    assert _f1(model, grammar) >= 0.95


def test_bare_pages(model):
    menu = "<div><a href=/a>Home</a></div><div><a href=/b>News</a></div><div><a href=/c>Contact us</a></div>"
    in_div = f"<html><body>{menu}<div><h1>A title</h1><div>{LONG}</div><div>{LONG} {LONG}</div></div><p>&copy; 2024 Somebody</p></body></html>"
    assert html_text.main_text([in_div], model)[0] == f"A title\n\n{LONG}\n\n{LONG} {LONG}"
    in_cell = f"<table><tr><td><div><a href=/a>One</a></div><div><a href=/b>Two</a></div></td><td><p>{LONG}</p><p>{LONG} {LONG}</p></td></tr></table>"
    assert html_text.main_text([in_cell], model)[0] == f"{LONG}\n\n{LONG} {LONG}"


def test_odd_markup_takes_time_in_proportion():
    pages = ['<p title="' + "<b " * 30_000, '<p title="' + "<b " * 30_000 + '">text</p>', "<div>x" * 30_000, "<b>" * 30_000 + "</i>" * 30_000 + "x", "<!--" * 30_000, "<" * 90_000, "&" * 90_000]
    start = time.process_time()
    for p in pages:
        html_text.leaf_blocks(p)
    assert time.process_time() - start < 6
    deep = html_text.leaf_blocks("<div>" * 5_000 + "text")
    assert deep[0].text == "text" and len(deep[0].path) <= html_text.OUTER + html_text.INNER


def test_quotes_close_values_only():
    assert [b.text for b in html_text.leaf_blocks("<p title=it's>one</p><p title='a > b'>two</p>it's <b class=\"x\">three</b>")] == ["one", "two", "it's three"]


def test_tables_of_pages(spark, model):
    rows = [(1, "u", None), (2, "u", ""), (2, "u", ""), (None, None, f"<article><p>{LONG}</p></article>"), (3, "u", "<article><p>" + LONG * 3000 + "</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine")).withColumn("_text", F.lit("also mine"))
    out = html_text.extract(pages, model)
    assert out.columns == pages.columns
    got = sorted((str(r.page_id), r.text, r._text) for r in out.collect())
    assert got == sorted((str(i), {None: LONG, 3: LONG * 3000}.get(i, ""), "also mine") for i, *_ in rows)
    assert html_text.extract(pages.limit(0), model).count() == 0
