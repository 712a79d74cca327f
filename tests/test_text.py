import time

from pyspark.sql import functions as F

from corpusaudit.functions import globs, paths
from corpusaudit.functions import text as tx
from corpusaudit.operators import lines as ln
from tests.conftest import rows


def values(spark, items, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i INT, v STRING")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_slug(spark):
    got = values(spark, ["Hello World", " API (v2)! ", "日本語 見出し", "a -- b", "-x-"], tx.slug)
    assert got == ["hello-world", "api-v2", "日本語-見出し", "a-b", "x"]


def test_paths(spark):
    assert values(spark, ["m/a/./../b.md", "a//b", "../x", "a/../../b", "a/b", ".", "a/b/.."], paths.normalise) == [
        "m/b.md", "a/b", "../x", "../b", "a/b", "", "a",
    ]
    assert values(spark, ["a/b.tar.gz", ".env", "x", "a/.x.yml", "A.JS"], paths.extension) == [".gz", "", "", ".yml", ".js"]
    assert values(spark, ["a/b.tar.gz", ".env", "d/x"], paths.stem) == ["b.tar", ".env", "x"]
    assert values(spark, ["a/b", "b", "x/y/z"], paths.dirname) == ["a", "", "x/y"]
    got = values(spark, ["../c.md", "d.md", "/top.md", ""], lambda v: paths.resolve(F.lit("a/b.md"), v))
    assert got == ["c.md", "a/d.md", "top.md", "a/b.md"]
    assert values(spark, ["a/b/c.md", "x.md"], paths.parents) == [["a", "a/b"], []]


def test_globs(spark):
    def hit(pattern, *names):
        return values(spark, names, lambda v: v.rlike(globs.path_suffix(pattern)))

    assert hit("*.json", "package.json", "a/b.json", "a.jsonx") == [True, True, False]
    assert hit("Controllers/API/*Controller.php", "app/Http/Controllers/API/BillingController.php", "xControllers/API/AController.php") == [True, False]
    assert hit("pages/**/*.vue", "pages/dashboard/index.vue", "pages/index.vue") == [True, False]
    assert hit("config/*", "config/app.php", "a/config/b/c", "aconfig/x") == [True, True, False]
    assert values(spark, ["img/x.png", "a?b"], lambda v: v.rlike(globs.any_of(["img/*", "a[?]b"]))) == [True, True]


def test_route_and_names(spark):
    got = values(spark, ["/a/{id}?x=1", "/a/:id/", "/a/[id]", "/", "/b//"], tx.normalise_route)
    assert got == ["/a/{_}", "/a/{_}", "/a/{_}", "/", "/b"]
    assert values(spark, ["DashBillingHTTPServer", "UserSettings"], tx.kebab) == ["dash-billing-http-server", "user-settings"]
    assert values(spark, ["userSettings"], lambda v: tx.kebab(v, False)) == ["user-settings"]
    assert values(spark, ["^2.15.8", "~3", "workspace:*"], tx.clean_version) == ["2.15.8", "3", ""]
    assert values(spark, ["ab", "日本x"], tx.display_width) == [2, 5]
    assert values(spark, ["12", "x", ""], tx.safe_integer) == [12, None, None]
    assert values(spark, ["ok", "a/b", "..", "\\x"], tx.is_safe_name) == [True, False, False, False]
    assert values(spark, ["a_1", "1a", "a-b"], tx.is_safe_identifier) == [True, False, False]
    assert values(spark, ["<!-- c\n -->a\n\n\n\nb \n"], tx.tidy_page) == ["a\n\nb"]
    titles = values(spark, ["x\n# My title\n", "## no\n"], lambda v: tx.title_of(v, F.lit("user-guide_x")))
    assert titles == ["My title", "User Guide X"]
    assert values(spark, ["a b c"], lambda v: tx.replace_all(v, [("a", "b"), ("b", "z")])) == ["z z c"]


def test_lines(files):
    df = files(("c", "p", "a\r\nb\n\nc\n"), ("c", "e", ""), ("c", "n", "x\n\n"))
    assert rows(ln.explode_lines(df), "path", "line_no", "line") == [
        ("n", 1, "x"), ("n", 2, ""), ("p", 1, "a"), ("p", 2, "b"), ("p", 3, ""), ("p", 4, "c"),
    ]


def test_fences(files):
    df = files(("c", "p", "a\n```js\nb\n```\nc\n  ```\nd"))
    got = rows(ln.explode_fenced_lines(df), "line_no", "is_marker", "in_fence", "fence_no")
    assert got == [
        (1, False, False, None), (2, True, False, 1), (3, False, True, 1), (4, True, False, 1),
        (5, False, False, None), (6, True, False, 2), (7, False, True, 2),
    ]
    assert rows(ln.prose_lines(df), "line_no", "line") == [(1, "a"), (5, "c")]


def test_sections_and_headings(files):
    df = files(("c", "p", "intro\n# A\nx\n```\n# not\n```\n#### deep\n## B"))
    assert rows(ln.headings(df), "line_no", "level", "heading", "slug") == [(2, 1, "A", "a"), (7, 4, "deep", "deep"), (8, 2, "B", "b")]
    got = rows(ln.sections(df, 1, 3), "section_no", "level", "heading", "first_line", "body")
    assert got == [(0, None, None, 1, "intro"), (1, 1, "A", 2, "x\n```\n# not\n```\n#### deep"), (2, 2, "B", 8, "")]


def test_slides(files):
    df = files(("c", "f", "---\nmarp: true\n---\n# 1\n---\n# 2\n"), ("c", "p", "# 1\n---\n---\nx"))
    assert rows(ln.slides(df), "path", "first_line", "lines") == [
        ("f", 4, ["# 1"]), ("f", 6, ["# 2"]), ("p", 1, ["# 1"]), ("p", 4, ["x"]),
    ]


def test_long_document_is_linear(spark):
    text = "\n".join("```" if i % 50 == 0 else f"line {i}" for i in range(200_000))
    df = spark.createDataFrame([("c", "p", text)], "corpus STRING, path STRING, content STRING")
    start = time.time()
    assert ln.explode_fenced_lines(df).where("in_fence").count() == 2000 * 49
    assert ln.sections(df).count() == 1
    assert time.time() - start < 20
