import time
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideloom.llm.html_extract import DEFAULT, MARKS, blocks_of, extract, features, fit, label, min_cut
from tideloom.llm.registry import QUERIES, table

COSTS = st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=7)


def cut_cost(labels, content, boiler, edges):
    own = sum(b if x else c for x, c, b in zip(labels, content, boiler))
    return own + sum(w for a, b, w in edges if labels[a] != labels[b])


@settings(max_examples=150, deadline=None)
@given(COSTS, st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(0, 5)), max_size=12))
def test_the_cut_is_the_cheapest_labelling(costs, edges):
    n = len(costs)
    content, boiler = np.array(costs, float).T
    edges = [(a % n, b % n, float(w)) for a, b, w in edges if a % n != b % n]
    got = min_cut(content, boiler, edges)
    every = [cut_cost(labels, content, boiler, edges) for labels in product([False, True], repeat=n)]
    assert cut_cost(got, content, boiler, edges) == pytest.approx(min(every))


def test_the_cut_of_a_long_chain():
    n = 20_000
    content = np.where(np.arange(n) % 7 == 3, 0.0, 2.0)
    got = min_cut(content, np.where(np.arange(n) % 7 == 3, 1.0, 0.0), [(i, i + 1, 0.7) for i in range(n - 1)])
    assert got.all()


def test_blocks():
    html = (
        "<title>T</title><p>a &amp;\n <b>b</b>&#x263A;<br>c<p>d<!-- x --><script>var t='</p>'</script>"
        "<ul><li>e<li>f &eacute</ul><div class='ad'>g"
    )
    assert [b.text for b in blocks_of(html)] == ["a & b☺ c", "d", "e", "f é", "g"]
    assert [b.boiler for b in blocks_of(html)] == [False, False, False, False, True]
    assert blocks_of(None) == blocks_of("") == blocks_of(" <p> </p><script>x</script>") == []


@pytest.mark.parametrize(
    "html, texts",
    [
        ("<html><head><title>T</title><meta charset=utf-8><body><p>a</p><p>b</p></body></html>", ["a", "b"]),
        ("<head><title>T</title><script>x</script><p>a</p>", ["a"]),
        ("<head><link rel=x>\n bare text", ["bare text"]),
        ("<head><title>T<body><p>a", ["a"]),
        ("<head><title>T<body><p>a<title>U</title><p>b", ["a", "b"]),
        ("<head><title>The <b> tag</title></head><p>a", ["a"]),
        ("<p>a</p><![foo]><p>b</p>", ["a", "b"]),
        ("<p>a</p><![ x ]><p>b</p>", ["a", "b"]),
        ("<p>a</p><![endif]--><p>b</p><![if x]><p>c</p>", ["a", "b", "c"]),
        ("<p>a</p><p>b &#" + "9" * 5000 + "; c</p><p>&#" + "0" * 5000 + "65;</p>", ["a", "b \ufffd c", "A"]),
    ],
)
def test_the_whole_page_is_read(html, texts):
    assert [b.text for b in blocks_of(html)] == texts


def test_edge_cases(spark):
    prose = "The river rose in the night, and the people of the town left their houses. They came back in spring."
    page = f"<nav><a href=x>Home</a></nav><article><h1>Flood</h1><p>{prose}</p></article><footer>Imprint</footer>"
    long = "<article>" + f"<p>{prose}</p>" * 3000 + "</article>"
    deep = "<div>" * 5000 + f"<p>{prose}</p>"
    rows = [(1, page), (1, page), (2, None), (3, ""), (4, "<nav>Home</nav><footer>Imprint</footer>"), (5, long), (None, page), (6, deep)]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, html string, _text string, _page_id int")
    beta = fit(pages)
    assert beta.shape == DEFAULT.shape
    got = extract(pages, beta, keep=["_text"]).collect()
    assert len(got) == len(rows) and {r["_kept"]["_text"] for r in got} == {"k"}
    by = {r["_page_id"]: r["_text"] for r in got}
    assert by[1] == by[None] == f"Flood {prose}"
    assert by[2] == by[3] == by[4] == ""
    assert by[5] == " ".join([prose] * 3000)
    assert by[6] == prose
    assert extract(pages.limit(0), beta).count() == 0
    assert (fit(pages.limit(0)) == DEFAULT).all()


def test_articles_of_the_given_pages(spark):
    """Pages that mark their article give its blocks outside marked chrome, and nothing else."""
    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r for r in QUERIES["op10_html_extract"](spark, sf).collect()}
    pages = table(spark, sf, "pages").collect()
    assert len(got) == len(pages)
    right = marked = 0
    for page in pages:
        found = got[page["page_id"]]
        assert found["n_chars"] == len(found["text"]) and found["url"] == page["url"]
        blocks = blocks_of(page["html"])
        if any(b.main for b in blocks):
            marked += 1
            right += found["text"] == " ".join(b.text for b in blocks if b.main and not b.boiler)
    assert marked and right >= 0.99 * marked


def labels_of(html, beta=DEFAULT):
    blocks = blocks_of(html)
    alone = features(blocks) @ beta > 0
    return [b.text for b in blocks], label(blocks, beta).tolist(), alone.tolist()


PROSE = "The river rose in the night, and the people of the town left their houses. They came back in spring."


def test_the_cut_keeps_what_the_threshold_would_lose():
    """A page without marks: a short line amid paragraphs is content, a list of links far away is not."""
    menu = "<div><ul>" + "".join(f"<li><a href=x>Page {i}</a>" for i in range(5)) + "</ul></div>"
    html = f"{menu}<div><div><p>{PROSE}</p><p>No one</p><p>{PROSE}</p><p>{PROSE}</p></div></div>{menu}"
    texts, cut, alone = labels_of(html)
    at = texts.index("No one")
    assert cut[at] and not alone[at]
    assert [t for t, kept in zip(texts, cut) if kept] == [PROSE, "No one", PROSE, PROSE]


def test_an_unmarked_advert_inside_an_article_goes():
    advert = "<div><div><a href=x>Buy now cheap</a></div></div>"
    texts, cut, _ = labels_of(f"<article><p>{PROSE}</p>{advert}<p>{PROSE}</p></article>", np.array([3.14, -9.0, 1.5, -4, 4, 5.2, -1.1, 3.6, -1, 0, -1, -3.1]))
    assert [t for t, kept in zip(texts, cut) if kept] == [PROSE, PROSE]


def test_pages_without_their_marks(spark):
    """Learned from pages with marks, the cut finds the same articles in pages stripped of them."""
    sf = "/root/testdata/sf0.01"
    beta = fit(table(spark, sf, "pages"))
    assert (beta[MARKS] == DEFAULT[MARKS]).all()
    hits = alike = total = 0
    for page in table(spark, sf, "pages").collect():
        blocks = blocks_of(page["html"])
        want = [b.main and not b.boiler for b in blocks]
        for b in blocks:
            b.main = b.boiler = False
        found = label(blocks, beta)
        hits += sum(f == w for f, w in zip(found, want))
        alike += sum(f == (x > 0) for f, x in zip(found, features(blocks) @ beta))
        total += len(blocks)
    assert hits >= 0.99 * total


def test_deep_pages_take_linear_time():
    start = time.perf_counter()
    assert len(blocks_of("<div>x" * 24_000)) == 24_000
    assert len(blocks_of("<div>" * 24_000 + "</p>x" * 24_000)) == 24_000
    assert time.perf_counter() - start < 3
