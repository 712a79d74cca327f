import random

from pyspark.sql import functions as F

from corpusaudit.functions import paths
from corpusaudit.functions import text as tx
from corpusaudit.operators import links
from tests.conftest import rows


def test_extract(files):
    df = files(("c", "a.md", "see [x](y.md) and ![i](p.png)\n[z](#top)\nno"))
    got = rows(links.markdown_links(df), "line_no", "link_no", "text", "url", "is_image")
    assert got == [(1, 1, "x", "y.md", False), (1, 2, "i", "p.png", True), (2, 1, "z", "#top", False)]


def test_check(files):
    df = files(
        ("c", "a.md", "[ok](d/b.md)\n[bad](none.md)\n[h](d/b.md#my-title)\n[h2](d/b.md#nope)\n[e](http://x)\n[self](#here)\n# Here"),
        ("c", "d/b.md", "# My Title\n[up](../a.md) [dir](../d) [root](/a.md) [t](../a.md \"title\")\n[diranchor](../d#x)"),
        ("other", "none.md", "x"),
    )
    got = rows(links.check_links(df), "path", "line_no", "url", "reason")
    assert got == [
        ("a.md", 2, "none.md", "file not found"),
        ("a.md", 4, "d/b.md#nope", "anchor not found"),
        ("d/b.md", 3, "../d#x", "cannot read target"),
    ]
    assert links.check_links(df, ignore=["none*", "d/*", "../d*"]).count() == 0


def test_any_file_is_a_target(files):
    df = files(("c", "a.md", "[i](img/x.png) [j](img/y.png) [k](b.txt#h) [d](img)"), ("c", "img/x.png", "[not](a link)"), ("c", "b.txt", "# H"))
    assert rows(links.check_links(df), "url", "reason") == [("b.txt#h", "anchor not found"), ("img/y.png", "file not found")]


def test_fenced_links_are_optional(files):
    df = files(("c", "a.md", "```\n[x](gone.md)\n```"))
    assert links.check_links(df).count() == 1
    assert links.check_links(df, skip_fences=True).count() == 0


def test_index(files):
    df = files(("c", "index.md", "[a](m/a.md#x) [b](m/b.md) [m](mailto:x) [h](https://x)"), ("c", "m/a.md", ""))
    assert rows(links.check_index_links(df), "target_path") == [("m/b.md",)]


def test_reverse_links(files):
    df = files(
        ("c", "diagrams/app-architecture.svg", ""),
        ("c", "diagrams/app-feat-login.svg", ""),
        ("c", "diagrams/app-feat-pay.svg", ""),
        ("c", "diagrams/app-context.svg", ""),
        ("c", "diagrams/app-seq-x.svg", ""),
        ("c", "diagrams/unruly.svg", ""),
        ("c", "manual/app/01-overview.md", "no image"),
        ("c", "manual/app/03-features.md", "x"),
        ("c", "manual/app/features/login.md", "![](../../../diagrams/app-feat-login.svg)"),
        ("c", "architecture/app.md", "![](../diagrams/app-context.svg)"),
    )
    assert rows(links.unreferenced_images(df)) == [
        ("c", "app-architecture.svg", "manual/app/01-overview.md"),
        ("c", "app-feat-pay.svg", "manual/app/03-features.md,manual/app/features/*.md"),
    ]


def test_page_links_from_the_folder_of_the_page(spark):
    pages = spark.createDataFrame(
        [(1, "https://s/a/b.html", '<a href="c.html"></a><a href="/c.html"></a><a href="../a/c.html#x"></a><a href="?q=1"></a><a href="d/"></a>'), (2, "https://s/a/c.html", ""), (3, "https://s/a/d/", "")],
        "page_id INT, url STRING, html STRING",
    )
    assert rows(links.broken_page_links(pages), "page_id", "link_no", "target_path") == [(1, 2, "c.html")]


def test_prose_of_whole_texts_is_that_of_their_lines(spark, files):
    """Links outside code and headings, found in the whole text, are those of its lines, whatever ends a line."""
    rng = random.Random(3)
    parts = ["```", " ```sql", "x ```", "# A b", "## C -- d_e!", "#no", "#\n", "### É 日本 - ", "# t\u2028", "# t\u2028u", "#\x0b q", "[a](b.md) [c](d.md#e)", "![i](p.png) ```", "", "  "]
    texts = ["".join(rng.choice(parts) + rng.choice(["\n", "\r\n", "\r"]) for _ in range(rng.randint(0, 12))) for _ in range(120)] + ["```", "", "# end", None]
    df = files(*[("c", f"{k}.md", t) for k, t in enumerate(texts)])
    prose = tx.with_prose(tx.with_lines(df))
    by_line = prose.select("path", F.posexplode("prose").alias("n", "line")).where(F.contains("line", F.lit("](")))
    by_line = by_line.select("path", "n", F.posexplode(F.regexp_extract_all("line", F.lit(links.LINK), F.lit(2))).alias("k", "url"))
    found = links.markdown_links(df, skip_fences=True)
    assert rows(found, "path", "line_no", "link_no", "url") == rows(by_line.selectExpr("path", "n + 1", "k + 1", "url"))
    heads = F.filter("prose", lambda l: F.coalesce(l.rlike(tx.HEADING), F.lit(False)))
    slugs = F.array_distinct(F.transform(heads, lambda l: tx.slug(F.regexp_extract(l, tx.HEADING, 1))))
    want = prose.select("path", F.coalesce(slugs, F.array().cast("array<string>")).alias("slugs"))
    assert rows(links.page_targets(df), "target_path", "slugs") == rows(want)
    assert "rlike" not in links.page_targets(df)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_paths_as_by_patterns(spark):
    names = ["", "a", "/", "a/", "/a", "a//b", "./a", "a/.", "..", "a/..", "../..", "a./b", "a.", ".a/b", "a/b/c.md", "é/日.md", "a\n/b\n", "x/..y/z", None]
    df = spark.createDataFrame([(n,) for n in names], "p STRING")
    old_plain = ~F.col("p").rlike(r"(^|/)(\.{1,2})?(/|$)")
    folded = F.array_join(F.aggregate(F.split("p", "/"), F.array().cast("array<string>"), paths._push), "/")
    for new, old in ((paths.dirname(F.col("p")), F.regexp_extract("p", "(?s)^(.*)/[^/]*$", 1)), (paths.normalise(F.col("p")), F.when(old_plain, F.col("p")).otherwise(folded))):
        assert df.select(new.eqNullSafe(old).alias("same"), "p").where("NOT same").collect() == []
    urls = ["a.md \"t\"", "a.md#b 'x", "a#", "#", "a#b#c", "x\n'y'", "it's", "q  \"a\nb", ""]
    got = links.resolve_links(spark.createDataFrame([("c", "d/p.md", u) for u in urls], "corpus STRING, path STRING, url STRING"))
    bare = F.regexp_replace("url", r"\s+[\"'].*$", "")
    anchor = F.when(F.contains(bare, F.lit("#")), F.regexp_extract(bare, "(?s)^[^#]*#(.*)$", 1))
    want = F.when(anchor != "", F.lower(anchor))
    assert got.where(~F.col("anchor").eqNullSafe(want) | ~F.col("target_path").eqNullSafe(paths.resolve(F.col("path"), F.substring_index(bare, "#", 1)))).collect() == []
