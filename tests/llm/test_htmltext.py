"""What ratio, smoothing and clustering decide on a page, against plain versions, and hard cases."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from rareflow.llm import htmltext
from rareflow.llm.htmltext import main_text

P = "A sentence of the article with enough words to be prose. " * 4
ONE = P.strip()
MENU = "".join(f"<li><a href={i}>Item {i}</a></li>" for i in range(8))
BARE = f"<body><div><ul>{MENU}</ul></div><div>Buy now</div><div><h1>Title</h1><p>{P}</p><p>Short.</p><p>{P}</p></div><div><a href=x>Imprint</a> <a href=y>Terms</a></div></body>"


def test_clustering_finds_the_region_of_a_bare_page(monkeypatch):
    want = "\n".join(["Title", ONE, "Short.", ONE])
    assert main_text(BARE) == want
    monkeypatch.setattr(htmltext, "two_clusters", lambda values: -1.0)  # every line dense
    assert main_text(BARE) != want


def test_clustering_decides_on_marked_parts_and_articles(monkeypatch):
    teasers = "".join(f"<article><h3><a href={i}>Story {i}</a></h3></article>" for i in range(4))
    page = f'<body><nav><ul>{MENU}</ul></nav><article><h1>Title</h1><p>{P}</p><div class="share"><span>Tweet</span><span>Mail</span></div></article>{teasers}<footer>All rights</footer></body>'
    assert main_text(page) == f"Title\n{ONE}"
    monkeypatch.setattr(htmltext, "two_clusters", lambda values: -1.0)
    assert main_text(page) != f"Title\n{ONE}"


def test_smoothing_is_a_weighted_mean():
    r = random.Random(2)
    for n in (1, 2, 5, 40):
        x = np.array([r.uniform(0, 200) for _ in range(n)])
        w = lambda i, j: np.exp(-0.5 * (i - j) ** 2) if abs(i - j) <= 3 else 0.0
        want = [sum(w(i, j) * x[j] for j in range(n)) / sum(w(i, j) for j in range(n)) for i in range(n)]
        assert np.allclose(htmltext.smoothed(x), want)


def test_threshold_lies_between_the_means_of_its_clusters():
    r = random.Random(3)
    for _ in range(50):
        x = np.array([r.gauss(10, 3) for _ in range(r.randint(1, 30))] + [r.gauss(150, 20) for _ in range(r.randint(1, 30))])
        cut = htmltext.two_clusters(x)
        assert abs(cut - (x[x < cut].mean() + x[x >= cut].mean()) / 2) < 1e-6
        assert (x < 80).sum() == (x < cut).sum()
    assert htmltext.two_clusters(np.full(4, 7.0)) == 7.0 and htmltext.two_clusters(np.array([60.0, 62, 90])) == 60


def test_lines_of_furniture_are_not_lifted_by_their_neighbours():
    ratios, kind = np.array([100.0, 90, 60, 110, 40, 100]), np.array([0, 0, 2, 2, 0, 0])
    assert htmltext.dense_lines(ratios, kind).tolist() == [True, True, False, False, True, True]


CASES = {
    "wrapper named after its sidebar": (f'<div class="content has-sidebar"><p>{P}</p><p>{P}</p></div>', f"{ONE}\n{ONE}"),
    "wrapper named after the search": (f'<body><div id="search-results-page" class="sidebar menu"><h1>T</h1><p>{P}</p></div></body>', f"T\n{ONE}"),
    "headline in the article's header": (f'<article><div class="article-header"><h1>Head</h1></div><p>{P}</p></article>', f"Head\n{ONE}"),
    "comment article": (f'<body><main><h1>Head</h1><p>{P}</p><article class="comment"><p>Bad {P}</p></article></main></body>', f"Head\n{ONE}"),
    "comments longer than the article": (f'<body><h1>Head</h1><div><p>{P}</p></div><div class="comments"><p>{P}</p><p>{P}</p><p>{P}</p></div></body>', f"Head\n{ONE}"),
    "two articles": (f"<body><article><p>1 {P}</p></article><p>between {P}</p><article><p>2 {P}</p></article></body>", f"1 {ONE}\n2 {ONE}"),
    "page in a form": (f"<body><form><div><p>{P}</p><p>{P}</p></div></form></body>", f"{ONE}\n{ONE}"),
    "login form": (f"<body><div><p>{P}</p><form><label>Name</label><input><p>Forgot it?</p></form><p>{P}</p></div></body>", f"{ONE}\n{ONE}"),
    "hidden parts": (f'<body><p>{P}</p><p hidden>{P}</p><p style="display: none">{P}</p><p aria-hidden="true">{P}</p></body>', ONE),
    "list items without ends": (f"<div><h1>Head</h1><p>{P}</p><ul><li>one<li>two <ol><li>deep</ol><li>three</ul></div>", f"Head\n{ONE}\none\ntwo\ndeep\nthree"),
    "a cell's text": (f"<table><tr><td>{P}<td>{P}<tr><td>{P}</table>", f"{ONE}\n{ONE}\n{ONE}"),
    "references": ("<p>&lt;b&gt; &amp;amp; &#233;&nbsp;&eacute;</p>", "<b> &amp; é é"),
    "nothing": ("<html><head><title>T</title></head><body><script>x()</script></body></html>", ""),
    "only marked text": (f'<div class="comments"><p>{P}</p></div>', ONE),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    page, want = CASES[name]
    assert main_text(page) == want


@pytest.mark.parametrize("unit", ["<div>word ", "<b>word ", "<p>word ", "<li>word ", "<b><div><i>x ", "</div><div class=share>x "])
def test_unclosed_tags_take_linear_time(unit):
    began = time.time()
    assert main_text(unit * 40_000)
    assert time.time() - began < 20


def test_table_of_pages(spark):
    made = [(1, "u", BARE), (1, "u", BARE), (None, None, BARE), (2, "v", None), (3, "v", ""), (4, "w", f"<p>{P * 500}")]
    pages = spark.createDataFrame([(*x, "t", 5) for x in made], "page_id long, url string, html string, text string, n_chars long").repartition(2)
    got = htmltext.extract_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter((r.page_id, r.url, r.text, r.n_chars) for r in got.collect()) == Counter((i, u, main_text(h or ""), len(main_text(h or ""))) for i, u, h in made)
    assert htmltext.extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 4, 8, 12, 20])
def test_one_long_paragraph_does_not_hide_the_article(n):
    menu = '<div><a href="/">Home</a></div><div><a href="/n">News</a></div>'
    line = lambda k: "<p>" + ("word " * 700)[: k - 1] + ".</p>"
    body = line(300) * n + line(3000) + line(300) * n
    text = htmltext.main_text(f"<html><body>{menu}<div><h1>Title</h1>{body}</div></body></html>")
    assert text.split("\n")[0] == "Title" and len(text.split("\n")) == 2 * n + 2 and "News" not in text


def test_pages_whose_element_names_say_nothing(spark):
    """With all sectioning elements renamed, ratios alone choose: no page loses its article, and most are exactly the same."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    exact = 0
    for html in pages:
        want = htmltext.main_text(html)
        got = htmltext.main_text(re.sub(r"<(/?)(article|main|nav|aside|footer|header)\b", r"<\1section", html))
        assert set(want.split("\n")) <= set(got.split("\n"))
        exact += got == want
    assert exact >= 0.8 * len(pages)
