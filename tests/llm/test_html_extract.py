import html
import re

import pytest

from statekit.llm import html_extract as op
from statekit.llm.common import table

SF = "/root/testdata/sf0.01"
NAV = '<nav><ul><li><a href="/x">Home</a><li><a href="/y">About</a></ul></nav>'


def text(source, paths=()):
    return op.Page(source).text(list(paths))


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<article><p>One  two<p>Three<br>four</article><p>out</p>", "One two Three four"),
        ("<article><h1>T</h1><p>a<b>b</b>c <i>d</i></p><script>var x='</p>';</script><style>p{}</style></article>", "T abc d"),
        ("<body>" + NAV + "<header>H</header><div class=content><p>" + "word " * 50 + "</p></div><aside>S</aside><footer>F</footer></body>", ("word " * 50).strip()),
        ("<article><p>text</p><div class='comments'><p>me too</p></div><form><label>x</label><input></form><div id=cookie-notice>ok</div></article>", "text"),
        ("<article>caf&eacute;&nbsp;&#8212; &lt;b&gt; &copy;<p>x</article", "café — <b> © x"),
        ("<article><p>1 < 2 and <!-- no --> 3</p><![CDATA[no]]><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "1 < 2 and 3 a b c d"),
        ("<ARTICLE><P CLASS='x>y'>up</P></ARTICLE><article><p>2</p></article>", "up"),
        ("<article><p><b>bold<p>next</article>", "bold next"),
    ],
)
def test_pages(source, want):
    assert text(source) == want


def test_like_the_article_of_the_given_pages(spark):
    """Brute force for these pages: the article element with its tags removed."""
    rows = table(spark, SF, "pages")
    got = {r.page_id: r for r in op.extract(spark, rows).collect()}
    for r in rows.collect():
        inner = re.search("<article>(.*?)(</article>|$)", r.html, re.S)[1]
        inner = re.sub("<(p|br|h1|/p|/h1)>", " ", inner)
        want = " ".join(html.unescape(re.sub("<[^>]*>", "", inner)).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url
        assert got[r.page_id].path.endswith(">article")


def test_votes_beat_a_loud_page(spark):
    usual = "<body><div class='post-{0}'><p>{1}</p></div><div class='extra'><p>{2}</p></div></body>"
    rows = [(i, "http://h.org/1", usual.format(i, "good " * 60, "more " * 5)) for i in range(9)]
    rows += [(9, "http://h.org/2", usual.format(9, "good " * 5, "more " * 90)), (10, None, None), (11, "http://g.org", ""), (11, "http://g.org", ""), (12, "x", "<p>" * 5000 + "deep")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = sorted((r.page_id, r.text) for r in op.extract(spark, df).collect())
    assert [t for _, t in got] == [("good " * 60).strip()] * 9 + [("good " * 5).strip(), "", "", "", "deep"]
    assert op.extract(spark, df.where("false")).count() == 0


LONG = " ".join(["word"] * 60)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (f"<article><h1>Title</h1><p>{LONG}</p><div class=body>{LONG * 4}</div></article>", f"Title {LONG} {LONG * 4}"),
        (f"<body><main><p>{LONG}</p><div><div>{LONG * 4}</div></div></main></body>", f"{LONG} {LONG * 4}"),
        (f"<body><div class=a><h1>T</h1></div><div class=b>{LONG}</div></body>", f"T {LONG}"),
        (f"<body><div class=a>{LONG}</div><div class=b>{LONG * 9}</div></body>", f"{LONG} {LONG * 9}"),
        (f"<body><div class=a><p><a href=x>{LONG}</a></p></div><div class=b>{LONG}</div></body>", LONG),
        (f"<div>{LONG}</div><p>loose {LONG}</p><article>{LONG}!</article>", f"{LONG} loose {LONG} {LONG}!"),
        (f"<body><div>{LONG}</div></body><p>after {LONG}", f"{LONG} after {LONG}"),
    ],
)
def test_no_article_text_is_left_beside(source, want):
    assert text(source) == want


def test_whole_pages_of_a_host(spark):
    rows = [(i, "http://h.org", f"<div class=x{i}>{LONG}</div><div>end {LONG}</div>") for i in range(5)] + [(9, "http://h.org", f"<body><nav>n</nav><div>short</div><article>{LONG}</article></body>")]
    got = {r.page_id: (r.text, r.path) for r in op.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: (f"{LONG} end {LONG}", "") for i in range(5)}, 9: (LONG, ">body>article")}
