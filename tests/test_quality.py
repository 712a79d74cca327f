from corpusaudit.operators import classify, diagrams, leakage, quality
from corpusaudit.plans import audit
from pyspark.sql import functions as F
from tests.conftest import rows


def perfect(name):
    sec = "".join(f"## S{i}\n(a.py:{i})\n" for i in range(16))
    links = "".join(f"[l{i}](x{i}.md)\n" for i in range(20))
    out = []
    for t in quality.EXPECTED_FILES:
        text = sec
        if t.endswith("00-index.md"):
            text = "文書番号 バージョン 承認者\nステータス: ok\n# 改訂履歴\n(a:1)\n" + links + sec
        if t.endswith("01-overview.md"):
            text = sec + "```mermaid\nx\n```\n" * 10 + "無効化モジュール active: true Tier 1 Tier 2 Tier3\n"
        if t.endswith("04-api-reference.md"):
            text = sec + "| a | b |\n|--|--|\n" + "| x | y |\n" * 20
        out.append(("c", t.replace("{name}", name), text))
    return out


def test_scorecard(files):
    df = files(*perfect("app"), ("c", "architecture/poor.md", "# t\n【推測】" + "【推測】" * 6), ("c", "README.md", "x"))
    owned = df.withColumn("project", classify.project_of(F.col("path")))
    axes = quality.axis_scores(quality.project_metrics(owned)).cache()
    grades = {(r.project, r.axis): r.grade for r in axes.collect()}
    assert {g for (p, _), g in grades.items() if p == "app"} == {"A"}
    assert grades["poor", "speculation"] == "C" and grades["poor", "completeness"] == "C"
    cards = {r.project: r for r in quality.scorecards(axes, "B").collect()}
    assert (cards["app"].numeric_score, cards["app"].grade, cards["app"].passed, cards["app"].suggestions) == (100, "A", True, 0)
    assert cards["poor"].numeric_score == 33 and cards["poor"].grade == "C" and not cards["poor"].passed
    miss = quality.missing_files(owned)
    assert miss.where("project = 'app'").count() == 0 and miss.where("project = 'poor'").count() == 14
    told = quality.suggestions(miss).orderBy("rank").collect()
    assert [t.rank for t in told] == list(range(1, 15)) and {t.missing for t in told} == {14}


def test_ratio_limits(spark):
    df = spark.createDataFrame([(f"p{n}", 10, n) for n in (8, 5, 4)], "project STRING, sections BIGINT, cited BIGINT").withColumn("corpus", F.lit("c"))
    for c in quality.SUMS + ["expected_found", "low_citation_files"]:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0).cast("bigint"))
    for c in quality.FLAGS:
        df = df.withColumn(c, F.lit(False))
    got = quality.axis_scores(df).where("axis = 'grounding'")
    assert rows(got, "project", "grade") == [("p4", "C"), ("p5", "B"), ("p8", "A")]


def test_half_even(spark):
    df = spark.createDataFrame([("c", "p", 1)] * 7 + [("c", "p", 2)] * 1, "corpus STRING, project STRING, score INT").withColumn("suggestion", F.lit(None).cast("string"))
    assert rows(quality.scorecards(df), "numeric_score") == [(38,)]  # 37.5


def test_fixed_checks(files):
    df = files(("c", "a.rag.md", "\n".join(f"## {s}" for s in quality.RAG_SECTIONS[1:])))
    assert rows(quality.missing_rag_sections(df), "section") == [("SYSTEM_OVERVIEW",)]
    df = files(("c", "1", "flowchart LR\na"), ("c", "2", "stateDiagram-v2"), ("c", "3", "graphic x"), ("c", "4", " \n"))
    assert rows(quality.diagram_syntax(df), "path", "problem") == [("1", None), ("2", None), ("3", "invalid diagram type"), ("4", "file is empty")]
    df = files(("c", "a.yaml", "openapi: 3\ninfo:\n  paths: 1"), ("c", "b.json", '{"openapi": 1, "info": 2, "paths": 3}'), ("c", "c.json", "{}"))
    assert rows(quality.missing_openapi_fields(df), "path", "field") == [("a.yaml", "paths"), ("c.json", "info"), ("c.json", "openapi"), ("c.json", "paths")]
    df = files(("c", "d", "未確認 確認済み 未確認"), ("c", "e", "a\n" * 90))
    assert rows(quality.unconfirmed_decisions(df)) == [("c", 2)]
    assert rows(quality.page_estimates(df)) == [("c", 2, 92, 192, 2)]


SLIDES = """---
marp: true
---
# ok
- a
- b
---
- 1
- 2
* 3
- 4
- 5
- 6
---
| h | h |
|---|---|
| 1 | 1 |
| 1 | 1 |
| 1 | 1 |
| 1 | 1 |
| 1 | 1 |
| 1 | 1 |
---
<div class="fig-text">
<div class="left"></div>
<div class="right">
<div class="card">1</div>
<div class="card">2</div>
<div class="card">3</div>
<div class="card">4</div>
</div>
</div>
<div class="card">5</div>
"""


def test_overflow(files):
    chain = "flowchart TB\n" + "\n".join(f"  n{i}[x] --> n{i + 1}(y)" for i in range(4))
    ok = "flowchart TB\n" + "\n".join(f"  n{i} --> n{i + 1}" for i in range(3)) + "\nflowchart LR\n" + "\n".join(f"n{i} --> n{i + 1}" for i in range(9))
    seq = "sequenceDiagram\n" + "".join(f"  participant P{i}\n" for i in range(6)) + "".join(f"  P0->>P1: m{i}\n" for i in range(13))
    er = "erDiagram\n" + "".join(f"  E{i} ||--o{{ F{i} : has\n" for i in range(4)) + "  E9 {\n    int id\n  }\n"
    df = files(("c", "a.mmd", chain), ("c", "b.mmd", ok), ("c", "c.mmd", seq), ("c", "d.mmd", er), ("c", "s.md", SLIDES), ("c", "t.md", "- a\n" * 9))
    assert rows(diagrams.diagram_overflow(df), "path", "line_no", "rule", "count") == [
        ("a.mmd", 1, "flowchart_vertical_nodes", 5), ("c.mmd", 1, "sequence_messages", 13),
        ("c.mmd", 1, "sequence_participants", 6), ("d.mmd", 1, "er_entities", 9),
    ]
    assert rows(diagrams.slide_overflow(df), "line_no", "rule", "count") == [
        (24, "fig_text_cards", 4), (24, "slide_cards", 5), (8, "slide_bullets", 6), (15, "slide_table_rows", 6),
    ] or rows(diagrams.slide_overflow(df), "line_no", "rule", "count") == sorted([
        (24, "fig_text_cards", 4), (24, "slide_cards", 5), (8, "slide_bullets", 6), (15, "slide_table_rows", 6),
    ], key=str)


def test_whole_audit(files):
    df = files(
        ("c", "a.md", "recieve [x](no.md) /infor/ `t_x` (gone.py:2)"), ("c", "diagrams/app-context.svg", ""), ("c", "architecture/app.md", "# t"),
        ("c", "database/migrations/1.php", "Schema::create('orders'"),
    )
    found = audit.findings(df, audit.AuditConfig(leak_rules=[leakage.LeakRule("specific-url-path", "/infor/", "HIGH")]))
    assert rows(found, "check", "rule") == [("image", "not shown"), ("leak", "specific-url-path"), ("link", "file not found"), ("term", "recieve")]
    assert sum(r.findings for r in audit.summary(found).collect()) == 4
    assert rows(audit.verdicts(df.where("path like '%.md'"), df), "check", "status") == [("citation", "FAIL"), ("table", "FAIL")]
    assert audit.scores(df, "C").count() == 1


def test_partitioning_does_not_matter(files):
    df = files(*perfect("app"), ("c", "a.md", "recieve [x](no.md) /infor/"))
    assert rows(audit.findings(df.repartition(1))) == rows(audit.findings(df.repartition(64)))


def test_cover_and_dates_anywhere(files, spark):
    from corpusaudit.operators import freshness

    cover = "\n" * 51 + " ".join(quality.COVER_MARKERS)
    m = quality.file_metrics(files(("c", "manual/p/00-index.md", cover)).withColumn("project", F.lit("p")))
    assert m.select("has_cover").first()[0]
    df = spark.createDataFrame([("x" * 2100 + "\nGenerated: 2024-05-06", None)], "content STRING, at TIMESTAMP")
    assert str(df.select(freshness.document_date(F.col("content"), F.col("at"))).first()[0]) == "2024-05-06"
