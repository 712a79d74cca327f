from pyspark.sql import functions as F

from corpusaudit.operators import citations, endpoints, modules, tables
from tests.conftest import rows


def test_citations(files, spark):
    docs = files(
        ("c", "d.md", "see (src/a.py:3) and (src/a.py:3-9) <!-- source: gone.py:1 --> (src/a.py:3) (x y:1)"),
        ("c", "e.md", "(src/a.py:3)"),
    )
    src = files(("c", "src/a.py", "1\n2\n3\n4"))
    got = citations.verify_citations(citations.citations(docs), citations.file_lengths(src))
    assert rows(got, "status", "label") == [("FAIL", "gone.py:1"), ("OK", "src/a.py:3"), ("WARN", "src/a.py:3-9")]
    totals = rows(citations.verdict_totals(got), "check", "ok", "fail", "warn")
    assert totals == [("citation", 1, 1, 1), (None, 1, 1, 1)]


DOC = """| No | テーブル名 | x |
|---|---|---|
| 1 | `m_user` | a |
| 2 | orders |
text `t_log` `is_active_users` `user_id` `order_items` `abs`
| 3 | not_in_table |
```mermaid
erDiagram
  Customer {
    int id
  }
  Customer ||--o{ Order : has
```
"""


def test_tables(files, spark):
    docs = files(("c", "d.md", DOC), ("z", "d.md", "`t_only`"))
    found = tables.documented_tables(docs)
    assert rows(found) == [
        ("c", "Customer"), ("c", "Order"), ("c", "m_user"), ("c", "order_items"), ("c", "orders"), ("c", "t_log"), ("z", "t_only"),
    ]
    src = files(
        ("c", "database/migrations/1.php", "Schema::create('orders'"), ("c", "prisma/schema.prisma", 'model Customer {\n @@map("m_user")'),
        ("c", "app/Models/A.php", "$table = 'order_items'; $table='no'"), ("c", "other.php", "Schema::create('x'"),
    )
    known = tables.declared_tables(src)
    assert rows(known) == [("c", "Customer"), ("c", "m_user"), ("c", "order_items"), ("c", "orders")]
    got = rows(tables.verify_tables(found, tables.known_tables(known)), "corpus", "status", "label")
    assert ("c", "FAIL", "t_log") in got and ("c", "OK", "orders") in got and ("z", "WARN", "1 names") in got
    assert len(got) == 7


def test_endpoints(files, spark):
    doc = "GET /users/{id}?x=1 and POST /none `PUT /a`\n| メソッド | パス |\n|--|--|\n| `get` | `/tab/[k]` |\n| FOO | /x |\nend\n| GET | /outside |"
    docs = files(("c", "d.md", doc), ("z", "d.md", "GET /q"))
    found = endpoints.endpoints(docs)
    assert rows(found) == [
        ("c", "GET", "/tab/[k]"), ("c", "GET", "/users/{id}?x=1"), ("c", "POST", "/none"), ("c", "PUT", "/a"), ("z", "GET", "/q"),
    ]
    routes = spark.createDataFrame([("c", "GET", "/users/:uid"), ("c", "GET", "/tab/{k}"), ("c", "PUT", "/a/")], "corpus STRING, method STRING, path STRING")
    got = rows(endpoints.verify_endpoints(found, routes), "corpus", "status", "label", "counts_as_failure")
    assert got == [
        ("c", "OK", "GET /tab/[k]", False), ("c", "OK", "GET /users/{id}?x=1", False), ("c", "OK", "PUT /a", False),
        ("c", "WARN", "POST /none", True), ("z", "WARN", "1 endpoints", False),
    ]


LARAVEL = """
Route::group(['prefix' => '/v1/'], function () {
  Route::get('users', 'A');
  Route::group(['prefix' => 'admin'], function () { Route::any('/', 'B'); });
  Route::post('x', 'C');
});
Route::delete('top', 'D');
"""


def test_source_routes(spark):
    df = spark.createDataFrame(
        [
            ("e", "routes/index.js", "router.get('/'); app.POST('/users')", ["express"]),
            ("e", "node_modules/x.js", "app.get('/no')", ["express"]),
            ("n", "app/api/users/[id]/route.ts", "export async function GET() {} export function POST", ["nextjs"]),
            ("n", "app/route.ts", "export function PUT", ["nextjs"]),
            ("u", "server/api/a/[b].get.ts", "", ["nuxt"]),
            ("u", "server/api/all.ts", "", ["nuxt"]),
            ("l", "routes/api.php", LARAVEL, ["laravel"]),
            ("l", "routes/web.php", "Route::get('/', 'H');", ["laravel"]),
        ],
        "corpus STRING, path STRING, content STRING, project_types ARRAY<STRING>",
    )
    got = rows(endpoints.source_routes(df))
    want = {
        ("e", "GET", "/"), ("e", "POST", "/users"), ("n", "GET", "/api/users/{id}"), ("n", "POST", "/api/users/{id}"), ("n", "PUT", "/."),
        ("u", "GET", "/api/a/{b}.get"), ("l", "GET", "/api/v1/users"), ("l", "POST", "/api/v1/x"), ("l", "DELETE", "/api/top"), ("l", "GET", "/"),
        *[("u", v, "/api/all") for v in endpoints.VERBS], *[("l", v, "/api/v1/admin") for v in endpoints.VERBS],
    }
    assert set(got) == want


def test_routes_and_report(files, spark):
    r = spark.createDataFrame([("/a", "a", True), ("/b", "b", None), ("/c", "c", False)], "path STRING, name STRING, auth_required BOOLEAN")
    assert rows(endpoints.filter_routes(r, False), "path") == [("/b",), ("/c",)]
    assert endpoints.filter_routes(r, True).count() == 3
    flow = files(("c", "02-screen-flow.md", 'login["/login<br>x"] --> d["/dash/summary"]\ne("/e") `/inline/x` `/login`'))
    assert rows(endpoints.screen_paths(flow), "path", "name") == [
        ("/dash/summary", "dash-summary"), ("/e", "e"), ("/inline/x", "inline-x"), ("/login", "login"), ("/login<br>x", "login<br>x"),
    ]
    res = spark.createDataFrame([("c", True, 5), ("c", False, 7), ("c", True, 1)], "corpus STRING, success BOOLEAN, size BIGINT")
    assert rows(endpoints.capture_report(res)) == [("c", 2, 1, 6)]


def test_modules(files, spark):
    docs = files(
        ("c", "f.md", "# Tier 1\n| 機能名 | d |\n|---|---|\n| Mod Comments View | x |\n| Sales | y |\n# Other\n| Hidden | z |"),
        ("z", "f.md", "nothing"),
    )
    feats = modules.feature_names(docs)
    assert rows(feats) == [("c", "Mod Comments View"), ("c", "Sales")]
    off = spark.createDataFrame([("c", "mod comments"), ("c", "Hidden"), ("z", "A")], "corpus STRING, name STRING")
    assert rows(modules.verify_modules(feats, off), "corpus", "status", "label") == [
        ("c", "FAIL", "mod comments"), ("c", "OK", "Hidden"), ("z", "WARN", "no tier table"),
    ]
    assert rows(modules.modules_in_pages(docs, off)) == [("c", "f.md", "hidden"), ("c", "f.md", "mod comments")]
    r = spark.createDataFrame([("c", "/x/Hidden/y", "n"), ("c", "/hiddens", "n"), ("c", "/q", "HIDDEN")], "corpus STRING, path STRING, name STRING")
    assert rows(modules.drop_disabled_routes(r, off), "path") == [("/hiddens",)]


def test_url_policy(spark):
    df = spark.createDataFrame([("http://a/b",), ("ftp://a",), ("https://169.254.169.254/x",), ("nope",)], "u STRING")
    got = df.select("u", endpoints.is_allowed_url(F.col("u")).alias("ok"), endpoints.capture_path(F.lit("d"), F.col("u")).alias("p"))
    assert rows(got, "ok", "p") == [(False, "d/a.png"), (False, "d/nope.png"), (False, "d/x.png"), (True, "d/b.png")]
    names = spark.createDataFrame([("../../x",), (".h",), ("a/",)], "n STRING").select(endpoints.capture_path(F.lit("d"), F.col("n")).alias("p"))
    assert rows(names) == [("d/x.png",), (None,), (None,)]
