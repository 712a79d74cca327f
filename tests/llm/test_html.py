"""Main text of pages: zones, blocks, references, and boilerplate by repetition."""

import pytest

from corpusaudit.llm.html_text import blocks_of, extract_text, main_text

CASES = [
    ("<article><h1>A &amp; B</h1><p>one<br>two  \n three</p><p>x<b>y</b>z</article>", "A & B\none two three\nxyz"),
    ("<nav>menu</nav><main><p>text<footer>foot</footer></main><aside>side</aside>", "text"),
    ("<article><header><h1>Title</h1></header><p>a</p><div class='ad'>buy</div><p class=\"share-bar\">share<p>b</article>", "Title\na\nb"),
    ("<article><p>a<section id=comments><p>reader</p></section><p>c</article>", "a\nc"),
    ("<header>site</header><p>free &lt;text&gt;</p><script>var a='<p>';</script><style>p{}</style><!-- <p>no</p> -->", "free <text>"),
    ("<form><input value='x'><article><p>inside</p></article><p>field</p></form>", "inside"),
    ("<div class='cookie-notice'>we use cookies</div><div class='content'>body</div>", "body"),
    ("<body class='with-sidebar'><p>stays</p><div hidden>no</div><div style='display: none'>no</div></body>", "stays"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>", "one\ntwo\nc1\nc2"),
    ("<ARTICLE><P>Upper &copy &#65;&#x42; &nosuch;</P></ARTICLE>", "Upper © AB &nosuch;"),
    ("<article><p>a</div></span>b</p><p title='a > b'>c</p>", "a\nb\nc"),
    ("<title>t</title><head><title>x</title></head>", ""),
    ("", ""),
    ("no markup at all < 3", "no markup at all < 3"),
    ("<article><span class=ad>x<span>y</span>z</span> after</article>", "after"),
    ("<article><p>a</p></article><article class='comment'>reader</article><article id=related-teaser>more</article>", "a"),
    ("<article class='post share-enabled'><p>a</p></article><main class='no-sidebar'>b</main>", "a\nb"),
    ("<p title=\"open>a</p><b>x</b>", "a\nx"),
    ("<p>a</p><script>x<p>never closed", "a"),
    ("<p>a<svg>x<p>b", "a\nb"),
    ("a <1 b </ c> d <!x> e <?php f", "a <1 b d e <?php f"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_blocks(page, want):
    assert main_text(blocks_of(page), []) == want


@pytest.mark.parametrize("page", [
    "<b" * 5_000_000, "<script>" * 1_250_000, "<b \"" * 2_500_000, "<b '" * 2_500_000 + ">", "<" + "a" * 10_000_000, "<!--" * 2_500_000, "<![" * 3_000_000,
    "<p>" + "<svg " * 2_000_000, "<" * 10_000_000,
])
def test_broken_pages_take_linear_time(page):
    import time

    start = time.time()
    blocks_of(page)
    assert time.time() - start < 4


@pytest.mark.parametrize("unit", ["<div>", "<span class=ad>", "</div>", "<p>x", "<svg>x", "<div></span>", "<span class=ad></b>", "<b><div></b>", "<li>x</i>", "<a href='>"])
def test_time_follows_length(unit):
    import time

    def spent(n):
        start = time.time()
        blocks_of(unit * n)
        return time.time() - start

    spent(1000)
    assert spent(80_000) < 8 * spent(20_000) + 0.2


def test_repeated_boilerplate(spark):
    notice = "<div>All our pages tell you at great length about the terms under which we write them.</div>"
    own = lambda i: " ".join(f"{(i + 3) * 7919 * k % 99991:x}" for k in range(1, 12))
    page = lambda i: f"{notice}<div>{own(i)}</div>"
    rows = [(i, f"https://a.example/{i}", page(i)) for i in range(6)]
    rows += [(20, "https://b.example/x", page(99)), (21, None, page(98)), (22, "https://a.example/22", None), (23, "https://A.example:80/23", "<article>" + notice + "</article>")]
    rows += [(24, "https://c.example/1", page(24)), (25, "https://c.example/2", page(24)), (None, "https://a.example/n", page(40)), (20, "https://b.example/x", page(99))]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    both = "All our pages tell you at great length about the terms under which we write them."
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i].text == own(i) for i in range(6)) and by[None].text == own(40)
    assert by[20].text == f"{both}\n{own(99)}"  # seen on one page of that host only
    assert by[21].text == f"{both}\n{own(98)}"
    assert (by[22].text, by[22].n_chars) == ("", 0)
    assert by[23].text == both
    assert by[24].text == by[25].text == f"{both}\n{own(24)}"  # a copied page is no boilerplate
    assert all(r.n_chars == len(r.text) for r in got)


def test_empty(spark):
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_given_pages(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    given = {r.page_id: r.html for r in pages.collect()}
    for r in extract_text(pages).collect():
        inside = re.search("<article>(.*)</article>", given[r.page_id], re.S)[1]
        parts = re.split("</?(?:p|h1)>", re.sub("</?b>", "", inside.replace("<br>", " ")))
        assert r.text == "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
