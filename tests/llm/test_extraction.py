"""Main text of pages of several makes; the method's parts by themselves."""

import html
import random
import re

import numpy as np
import pytest

from tallyard.llm import extraction as X

L = "This is a long sentence of the article that goes on and on with many words in it, so it counts as content."
MENU = '<nav><ul><li><a href="/a">Alpha</a></li><li><a href="/b">Beta</a></li></ul></nav>'
CASES = {
    "divisions": (f'<html><head><title>T</title></head><body class="has-sidebar"><div id="header"><a href="/">Home</a> Site</div><div class="topmenu"><a href=a>A</a><a href=b>B</a></div><div id="content"><h1>Head</h1><p>{L}</p><p>Short.</p><p>{L} {L}<p>{L}</div>'
                  f'<div class="sidebar"><p>{L}</p></div><div id="comments"><p>{L}</p></div><div>Copyright <a href=x>x</a> 2024</div></body></html>', f"Head\n{L}\nShort.\n{L} {L}\n{L}"),
    "short article": (f'{MENU}<div class="ad">buy buy buy this now and more and more</div><article><h1>Hi</h1><p>Of.</p></article><footer>&copy; x</footer>', "Hi\nOf."),
    "parts of an article": (f'<article><header><h2>Title</h2><span>By me</span></header><p>{L}<aside>{L}</aside><form>Sub<input></form><section class="comments"><article class="comment"><p>{L}</p></article></section><footer>F</footer></article>', f"Title\n{L}"),
    "two articles": (f"<main><article><h1>A</h1><p>{L}</p></article><article><h1>B</h1><p>{L} {L}</p></article></main><div class=cookie-notice>{L}</div>", f"A\n{L}\nB\n{L} {L}"),
    "references and space": ("<article><p>a &amp;&lt;b&gt;\n\t <b>c</b>d<br>e&nbsp;&eacute;</p></article>", "a &<b> cd e é"),
    "script": ('<article><p>a<script>if (a<b) write("</p>")</script>b</p><style>p{}</style></article>', "a b"),
    "unclosed": ("<article><p>abc <b>bold<p>next</b> more</p></p></div>tail</article>after", "abc bold\nnext more\ntail"),
    "inline advert": (f'<article><p>{L}<span class="advert">buy</span> end</p><p><span class="ad">never closed<p>again</article>', f"{L} end\nagain"),
    "table": ("<article><table><tr><td>a</td><td>b</td></tr><tr><td>c<td>d</table></article>", "a b\nc d"),
    "ends within a comment": (f"<article><p>{L}</p><!-- never <p>{L}</p>", L),
    "ends within a tag": (f"<article><p>{L}</p><p class='x", L),
    "odd declaration": (f"<!DOCTYPE html><article><p>{L}</p><![odd[ x ]><?php y ?><p>z</p>", f"{L}\nz"),
    "only marked": (MENU, ""), "text": ("just  text &amp; more", "just text & more"), "empty": ("", ""), "heading alone": ("<article><h1>x</h1></article>", "x"),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    page, text = CASES[name]
    assert X.main_text(page) == text


def test_the_threshold_selects_and_smoothing_decides():
    """Loose boilerplate that no name marks goes by its ratio; a short line amid long ones stays through the smoothing."""
    links = "".join(f'<div><a href="/{k}">Link {k}</a> <a href="/{k}">x</a> -</div>' for k in range(8))
    page = f"<body>{links}<div>{L}</div><div>So.</div><div>{L}</div>{links}</body>"
    assert X.main_text(page) == f"{L}\nSo.\n{L}"
    x = np.log1p(np.array([1.0, 1, 1, 50, 1, 50, 1, 1, 1]))
    even = X.smoothed(x)
    assert even[4] >= X.threshold(even) and x[4] < X.threshold(x) and even[0] < X.threshold(even)


def test_smoothing_keeps_what_is_even_and_threshold_what_is_alike():
    assert np.allclose(X.smoothed(np.ones(5)), 1.0) and np.allclose(X.smoothed(np.array([2.0])), 2.0)
    assert X.threshold(np.array([3.0, 3.0])) == 3.0 and X.threshold(np.array([1.0, 9.0, 1.2, 8.0])) == 8.0


def test_any_markup_is_read():
    rng = random.Random(1)
    parts = ["<p>", "</p>", "<div class=ad>", "</div>", "<article>", "</article>", "<!--", "-->", "<b>", "</b>", "<script>", "</script>", "x y", "&amp", "&#1;", "<![", "<!", "<?", "</", "<", ">", "<td>", "<li>", "<ul>", "</ul>", "<head>", "<a href=x>", "</a>", '"', "=", "<br/>", "<svg/>", "<form>"]
    for _ in range(3000):
        text = X.main_text("".join(rng.choices(parts, k=rng.randrange(30))))
        assert all(line == " ".join(line.split()) and line for line in text.split("\n")) or text == ""


def test_rows(spark):
    long_ = "<article>" + f"<p>{L}</p>" * 20_000 + "</article>"
    rows = [(1, "u", CASES["table"][0], 7), (1, "u", CASES["table"][0], 7), (None, None, None, 1), (2, "v", "", 1), (3, "w", long_, 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted(map(tuple, X.extract(spark, df).collect()), key=str)
    want = [(1, "u", "a b\nc d", 7)] * 2 + [(None, None, "", 0), (2, "v", "", 0), (3, "w", "\n".join([L] * 20_000), 20_000 * (len(L) + 1) - 1)]
    assert got == sorted(want, key=str)
    assert X.extract(spark, df.limit(0)).count() == 0


def test_given_pages_against_their_template(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in X.extract(spark, pages).collect()}
    for page_id, _, page in map(tuple, pages.select("page_id", "url", "html").collect()):
        body = re.sub(r"<!--.*?-->", "", re.search(r"<article>(.*)</article>", page, re.S)[1], flags=re.S)
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body.replace("<br>", " ")))
        assert got[page_id] == "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
