"""Main text of pages: the parser on odd pages, and template removal over sites against the text that was put in."""

import html
import random
import re

import pytest

from tests.conftest import TINY
from tidemark.llm import templates
from tidemark.llm.templates import Page

SCHEMA = "page_id long, url string, html string, text string, key string, host string, hits int, subtree string"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<nav><a>x</a></nav><article><h1>T &amp; U</h1><p>a<br>b \n c<p>d <b>e</b>f</article><footer>z</footer>", "T & U|a b c|d ef"),
        ("<body><form id=f><div class='header'>H</div><main><p>text</p></main><input></form></body>", "text"),
        ("<article><header><h1>T</h1><p>By X</p></header><p>body</p><footer>s</footer><section id='comments'><h2>C</h2><article><p>nice</p></article></section></article>", "T|body"),
        ("<nav><ul><li><a>m</a></ul><article><p>yes</p></article>", "yes"),
        ("<div id=wrap><div class='top-menu'><a>1</a></div><div class='content'><h2>Head</h2>loose<p>one</p><table><tr><td>c1</td><td>c2</td></tr></table></div><div class='sidebar'>s</div><div class='cookie-notice'>we</div></div>", "Head|loose|one|c1 c2"),
        ("<article><p>a<script>var t=\"</p><p>no\";</script>b</p><style>x{}</style><!-- c --><p>q</p></article>", "ab|q"),
        ("<article><p>abc &am", "abc &am"), ("<article><p>abc <a href=\"x", "abc"), ("<article>x<script>never closed", "x"), ("<article>x<!-- never closed", "x"),
        ("<main><article><p>1</p></article><article><p>2</p></article></main>", "1|2"),
        ("<article><p>the article's own long text</p><article><p>reader's comment</p></article></article>", "the article's own long text"),
        ("", ""), ("just text &lt; 3", "just text < 3"), ("<p>&#8364;&nbsp;5 &notin; &#x41;</p>", "€ 5 ∉ A"),
        ("<article><ul><li>a<li>b<ul><li>c</ul><li>d</ul></article>", "a|b|c|d"),
        ("<ARTICLE><P CLASS=AD>buy</P><P title='a>b'>kept</P><aside>s</aside><form>f</form><div hidden>h</div></ARTICLE>", "kept"),
        ("<body class='no-sidebar'><div class='with-ads'><p>kept</p></div><div role=navigation>n</div></body>", "kept"),
        ("<div><ul><li><a>one</a><li><a>two</a><li><a>three</a></ul><p>prose with <a>a link</a> in it</p></div>", "prose with a link in it"),
        ("<article><blockquote>q</blockquote><pre>x\n  y</pre><figure><img alt=n><figcaption>cap</figcaption></figure></article>", "q|x y|cap"),
        ("<title>t</title><article>café x</article>", "café x"),
    ],
)
def test_op13_text_of_a_page(page, text):
    assert Page(page, "h").text()[0] == text.replace("|", "\n\n")


@pytest.mark.parametrize("page", ["<div>" * 50000, "<p><b>" * 20000 + "</i>" * 20000, "<a \"" * 20000, "<article>" * 20000 + "x", "<b>" * 20000 + "<div>" + "</b>" * 20000, "<span>" * 20000 + "</td></li><li>" * 20000, "&" * 100000, "<" * 100000, "<!-" * 50000])
def test_op13_hostile_pages_take_linear_time(page):
    Page(page, "h").text()


def site(seed, host, n, declared):
    """Pages of a host with unmarked parts on all of them, and the text that each must give."""
    rng = random.Random(seed)
    prose = lambda k: " ".join("".join(rng.choices("abcdefg", k=rng.randint(2, 8))) for _ in range(k))
    menu, strip, plea, shared = prose(9), prose(12), prose(7), prose(30)
    out = []
    for i in range(n):
        own = [prose(rng.randint(15, 60)) for _ in range(rng.randint(2, 5))] + ([shared] if i % 4 == 0 else [])
        inner = "".join(f"<p>{html.escape(p)}</p>" for p in own[:1]) + f"<div><span>{plea}</span></div>" + "".join(f"<p>{html.escape(p)}</p>" for p in own[1:])
        body = f"<article>{inner}</article>" if declared else f"<div class=c{i}>{inner}</div>"
        out.append((f"https://{host}/{i}", f"<html><body><div><div>{menu}</div></div>{body}<div><p>{strip}</p></div></body></html>", "\n\n".join(own)))
    return out


@pytest.mark.parametrize("declared, most", [(True, 1000), (False, 1000), (True, 0), (False, 0)])
def test_op13_templates_go_and_articles_stay(spark, declared, most):
    """Parts that no tag or name marks go by their counts; a passage on a quarter of the pages, and copies of a page, stay."""
    pages = [*site(1, "a.example", 40, declared), *site(2, "b.example", 25, declared)]
    pages += [pages[3]] * 30
    rows = [(i, u, h, "t", "k", "h", 1, "s") for i, (u, h, _) in enumerate(pages)]
    got = templates.extract(spark.createDataFrame(rows, SCHEMA).repartition(6), most_broadcast=most).collect()
    assert {r.page_id: r.text for r in got} == {i: t for i, (_, _, t) in enumerate(pages)}
    assert all(r.n_template >= 1 and r.n_chars == len(r.text) for r in got)


def test_op13_odd_rows(spark):
    page = "<article><p>same</p></article>"
    rows = [(1, None, page), (1, None, page), (None, "http://x/1", page), (2, "no host", None), (3, "", ""), (4, "http://x/2", "<p>é" * 20000)]
    df = spark.createDataFrame([(*r, "t", "k", "h", 1, "s") for r in rows], SCHEMA)
    got = sorted(((r.page_id, r.url, r.n_chars) for r in templates.extract(df).collect()), key=repr)
    assert got == sorted([(1, None, 4), (1, None, 4), (None, "http://x/1", 4), (2, "no host", 0), (3, "", 0), (4, "http://x/2", 59998)], key=repr)
    assert templates.extract(df.limit(0)).count() == 0


def test_op13_given_pages_keep_their_articles(spark):
    """On the given table the article stands in its element; its paragraphs stay however often they recur."""
    df = spark.read.parquet(f"{TINY}/pages.parquet")
    want = {}
    for r in df.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        want[r.page_id] = (r.url, "\n\n".join(b for b in blocks if b))
    assert {r.page_id: (r.url, r.text) for r in templates.extract(df).collect()} == want
