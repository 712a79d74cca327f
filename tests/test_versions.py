import datetime as dt

from pyspark.sql import functions as F

from corpusaudit.operators import freshness, impact, versions
from tests.conftest import rows


def test_snapshots(files, spark):
    old = versions.snapshot(files(("c", "a", "1"), ("c", "b", "2"), ("c", "d", "same"), ("q", "a", "x")))
    new = versions.snapshot(files(("c", "b", "3"), ("c", "e", "4"), ("c", "d", "same"), ("q", "a", "x")))
    every = versions.compare(old, new, keep_same=True)
    assert rows(every) == [("c", "a", "removed"), ("c", "b", "changed"), ("c", "d", "same"), ("c", "e", "added"), ("q", "a", "same")]
    assert rows(versions.change_summary(every)) == [("c", 1, 1, 1, True), ("q", 0, 0, 0, False)]
    assert versions.compare(old, old).count() == 0
    assert old.where("path = 'd'").collect()[0].sha256 == "0967115f2813a3541eaef77de9d9d5773f1c0c04314b0bbfe4ff3b3b1c55b5d5"
    assert rows(versions.copies(versions.snapshot(files(("c", "a", "1"), ("c", "b", "1"), ("c", "z", "2")))), "copies", "first_path") == [(2, "a")]


def test_ledger(spark):
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    led = spark.createDataFrame(
        [("k1", "a", "c1", t(10), 1, 1), ("k1b", "a", "c2", t(11, 30), 1, 1), ("k2", "b", "c1", t(11, 30), 1, 1), ("k3", "c", "", t(11, 30), 1, 1), ("k4", "d", "c1", t(5), 1, 1)],
        "cache_key STRING, corpus STRING, commit STRING, generated_at TIMESTAMP, file_count BIGINT, facts_version INT",
    )
    now = F.lit(t(12))
    cur = spark.createDataFrame([("a", "c2"), ("b", "c9"), ("c", "c1"), ("d", "c1"), ("e", "c1")], "corpus STRING, commit STRING")
    assert rows(versions.still_valid(led, cur, now), "corpus") == [("a",), ("c",)]
    assert rows(versions.facts_state(cur, led)) == [("a", "unchanged"), ("b", "changed"), ("c", "no commit"), ("d", "unchanged"), ("e", "no cache")]
    work = spark.createDataFrame([("k1b",), ("k4",), ("new",)], "cache_key STRING")
    assert rows(versions.to_do(work, led, now)) == [("k4",), ("new",)]
    keep, dropped = versions.expire(led, now, 3600)
    assert keep.count() == 3 and rows(dropped) == [(2,)]
    assert versions.ledger_entry(led, "none").count() == 0


def test_freshness(spark):
    m = dt.datetime(2024, 5, 5)
    df = spark.createDataFrame(
        [("last_updated: '2024-01-02'", m), ("生成日: 2024-01-03", m), ("Generated: 2024-01-04", m), ("last_updated: 2024-99-99", m), ("x" * 2000 + "Generated: 2024-01-04", m), ("none", None)],
        "content STRING, modified_at TIMESTAMP",
    )
    got = [r[0] for r in df.select(freshness.document_date(F.col("content"), F.col("modified_at")).cast("string")).collect()]
    assert got == ["2024-01-02", "2024-01-03", "2024-01-04", "2024-05-05", "2024-01-04", None]
    d = dt.date
    docs = spark.createDataFrame(
        [("c", "a", d(2024, 1, 1), d(2024, 1, 8)), ("c", "b", d(2024, 1, 1), d(2024, 1, 9)), ("c", "x", None, d(2024, 1, 9)), ("c", "n", d(2024, 2, 1), None)],
        "corpus STRING, path STRING, doc_date DATE, source_date DATE",
    )
    judged = freshness.freshness(docs)
    assert rows(judged, "path", "state", "age_days") == [("a", "fresh", 7), ("b", "stale", 8), ("n", "unknown", None), ("x", "unknown", None)]
    assert [r.path for r in freshness.stale_first(judged).collect()] == ["b"]
    text = [r[0] for r in docs.orderBy("path").select(freshness.badge(F.col("doc_date"), F.col("source_date"))).collect()]
    assert text[1] == "> 📊 鮮度: ⚠️ 要更新（生成日: 2024-01-01, ソース最終更新: 2024-01-09 — 8日経過）"
    assert text[2] == "> 📊 鮮度: ✅ 最新（生成日: 2024-02-01, ソース最終更新: 不明）"
    assert text[3] == "> 📊 鮮度: ❓ 不明（ファクトキャッシュが見つかりません）"


def test_badge_upsert(spark):
    b = "> 📊 鮮度: new"
    df = spark.createDataFrame([("# T\nbody",), ("x\n> 📊 鮮度: old $1\ny",), ("no title",), ("intro\n# T\n# U",)], "c STRING")
    got = [r[0] for r in df.select(freshness.with_badge(F.col("c"), F.lit(b))).collect()]
    assert got == [f"# T\n\n{b}\nbody", f"x\n{b}\ny", f"{b}\n\nno title", f"intro\n# T\n\n{b}\n# U"]


def test_impact(spark):
    paths = [
        "app/Http/Controllers/API/DashUserSettingsController.php", "app/Models/User.php", "pages/dashboard/index.vue", "pages/x.vue",
        "store/userSettings.js", "routes/api.php", "config/app.php", "package.json", "README.md", "docs/something.md", "config/a.json",
    ]
    got = rows(impact.affected_documents(spark.createDataFrame([("c", p) for p in paths], "corpus STRING, path STRING")), "path", "doc")
    want = [
        (paths[0], "04-api-reference.md"), (paths[0], "features/dash-user-settings.md"), (paths[1], "05-data-model.md"),
        (paths[2], "02-screen-flow.md"), (paths[2], "06-screen-specs.md"), (paths[4], "features/user-settings.md"),
        (paths[5], "02-screen-flow.md"), (paths[5], "04-api-reference.md"), (paths[6], "01-overview.md"), (paths[7], "01-overview.md"),
        (paths[10], "01-overview.md"),
    ]
    assert got == sorted(want, key=str)
    plan = impact.update_plan(impact.affected_documents(spark.createDataFrame([("c", p) for p in paths], "corpus STRING, path STRING")))
    assert ("c", "01-overview.md", 3, "config/a.json") in rows(impact.plan_summary(plan))
    assert ("User.php changed",) in rows(plan, "reason")
