import itertools
import math
import random

import numpy as np
import pytest

from plateview.llm import maintext
from plateview.llm.maintext import Page

SITE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";track(0);</script></head><body>
<div class="cookie-notice"><p>We use cookies.</p></div><header><h1>Site &amp; name</h1></header><nav><ul><li><a href="/a">Menu</a></li><li><a href="/b">More</a></li></ul></nav><!-- ad <p>x</p> -->
<div class="ad">Buy this now.</div><article><h1>Title of the  article</h1><p><b>First&nbsp;para&#x67;raph
of it, with some words.<br><p>Second one, which goes on for a while and says more.<p>Third &lt;here&gt; ends.</article>
<section class="comments"><h2>Comments</h2><div class="comment"><p>I do not agree at all with that.</p></div></section>
<aside class="sidebar"><p>Other things that may be of interest to you.</p></aside><form><p>Your mail</p><input><button>Go</button></form><footer>&copy; all rights</footer></body></html>"""


def _texts(html):
    p = Page(html)
    return list(zip(p.run_text, [p.tag[i] for i in p.run_node]))


def test_parsing():
    assert [t for t, _ in _texts("a<p>b <b>c</b>d<div>e<br>f</div>g")] == ["a", "b cd", "e f", "g"]
    assert [t for t, _ in _texts("<ul><li>a<li>b <i>c</ul>d")] == ["a", "b c", "d"]
    assert [t for t, _ in _texts("x<script>if (a<b) '</p>'</script>y<STYLE>p</STYLE>z")] == ["xyz"]
    assert [t for t, _ in _texts("<p title='a>b'>c</p><!-- <p>d</p> -->e<!-- open")] == ["c", "e"]
    assert [t for t, _ in _texts("1 < 2 &amp; 3<p>&eacute;&#233;&nbsp; \n x")] == ["1 < 2 & 3", "éé x"]
    assert [t for t, _ in _texts('<p>a</p><div class="open>b</div><p>c</p>')][0] == "a"
    assert [t for t, _ in _texts("<table><tr><td>a<td>b<tr><td>c</table>d")] == ["a", "b", "c", "d"]
    assert [t for t, _ in _texts("<select><option>no</select><textarea><p>no</textarea>yes")] == ["yes"]
    assert _texts("") == [] and _texts("<<<>") != []
    deep = Page("<div>" * 3000 + "x" + "</div>" * 3000)
    assert len(deep.tag) == 3001 and deep.run_text == ["x"]


def test_omitted_end_tags_hide_no_text():
    assert [t for t, _ in _texts("<html><head><title>T</title><meta charset=utf-8><body><p>a</p><p>b</p></html>")] == ["a", "b"]
    assert [t for t, _ in _texts("<head><link href=x><script>s</script><p>a<div>b</div>")] == ["a", "b"]
    assert [t for t, _ in _texts("<head><base href=x><span>a</span> b")] == ["a b"]
    assert [t for t, _ in _texts("<head><noscript>x</noscript></head>a")] == ["a"]
    for name in ("button", "object", "canvas", "svg", "audio", "select"):
        assert [t for t, _ in _texts(f"<div><{name}><p>a</p>b</div><{name}>no</{name}>c")] == ["a", "b", "c"]
    assert [t for t, _ in _texts("<div><button>no</div><p>a</p>")] == ["a"]
    assert [t for t, _ in _texts("<ul><li>x <button>no<ul><li>y</ul>z</ul>")] == ["x", "y", "z"]
    assert [t for t, _ in _texts("<p>x <canvas id=c>y</p>z")] == ["x y", "z"]
    assert [t for t, _ in _texts("<button>no<p>no</p>no</button>a<!-- <button> --><p>b")] == ["a", "b"]


def test_subtrees_are_closed_intervals():
    for seed in range(30):
        page = Page(maintext.rule_page(seed))
        for i in range(1, len(page.tag)):
            assert i < page.stop[i] <= page.stop[page.parent[i]] and page.parent[i] < i
        x = maintext.features([page, Page(""), page])
        assert np.allclose(x[: len(page.tag)], x[len(page.tag) + 1:]) and np.isfinite(x).all()


def test_decoding_is_the_best_consistent_labelling():
    rng = random.Random(1)
    page = Page("<div><p>a</p><div><p>b</p><p>c</p></div></div><div>d<p>e</p></div>")
    n = len(page.tag)
    for _ in range(40):
        margin = [rng.uniform(-2, 2) for _ in range(n)]

        def score(open_):
            return sum(-math.log1p(math.exp(-2 * margin[i] if open_[i] else 2 * margin[i])) for i in range(1, n))

        every = (c for c in itertools.product([True, False], repeat=n) if c[0] and all(c[page.parent[i]] or not c[i] for i in range(1, n)))
        assert maintext.decoded(page, margin) == list(max(every, key=score))


@pytest.fixture(scope="module")
def trees(spark):
    pages = spark.createDataFrame([(i, SITE) for i in range(3)], "page_id long, html string")
    return maintext.fit(pages, rule_pages=500)


def test_main_text_of_a_page(trees):
    text = maintext.extracted([Page(SITE)], trees)[0]
    assert text == ("Title of the article\nFirst paragraph of it, with some words.\n"
                    "Second one, which goes on for a while and says more.\nThird <here> ends.")


def test_blocks_of_unseen_pages(trees):
    right = total = 0
    for seed in range(10_000, 10_120):
        page = Page(maintext.rule_page(seed))
        open_ = maintext.decoded(page, trees.margin(maintext.features([page])).tolist())
        for node in page.run_node:
            total += 1
            right += open_[node] == page.main[node]
            assert not open_[node] or open_[page.parent[node]]
    assert right / total > 0.95


def test_special_pages(spark, trees):
    rows = [(1, None, "x"), (2, "", "x"), (3, SITE, None), (3, SITE, None), (None, "<p>", "y"), (4, "<nav><a href='/'>Home</a></nav>", "z")]
    table = spark.createDataFrame(rows, "page_id long, html string, text string")
    found = [tuple(r) for r in maintext.extract(table, trees, ["page_id"]).collect()]
    assert [r[1] for r in found if r[0] in (1, 2, 4, None)] == ["", "", "", ""]
    assert len({r for r in found if r[0] == 3}) == 1 and len(found) == 6
    assert maintext.extract(table.limit(0), trees, ["page_id"]).collect() == []


def test_weak_labels_need_an_article():
    assert all(math.isnan(v) for v in maintext.labelled_nodes(Page("<div><p>a</p></div>"), False))
    page = Page("<article><p>a</p><nav><p>b</p></nav></article><footer>c</footer>")
    assert [v for v in maintext.labelled_nodes(page, False)] == [1.0, 1.0, 1.0, 0.0, 0.0, 0.0]
