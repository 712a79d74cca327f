"""Quality axes of a documentation set and the scorecard built from them.

All counts of a file are taken in its own row, in one pass over the text; only the numbers are summed per
corpus, so a corpus of any size is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions import text as tx
from corpusaudit.operators.citations import LOOSE
from corpusaudit.operators.lines import with_sections

# Fixed values.
EXPECTED_FILES = [
    "architecture/{name}.md", "manual/{name}/00-index.md", "manual/{name}/01-overview.md",
    "manual/{name}/02-screen-flow.md", "manual/{name}/03-features.md", "manual/{name}/04-api-reference.md",
    "manual/{name}/05-data-model.md", "manual/{name}/06-screen-specs.md", "manual/{name}/07-walkthrough.md",
    "manual/{name}/08-review.md", "explanations/{name}/pro.md", "explanations/{name}/beginner.md",
    "explanations/{name}/sales.md", "decisions/{name}.md", "{name}-index.md",
]
SPECULATION = "【推測】"
UNCONFIRMED = "未確認"
COVER_MARKERS = ["文書番号", "バージョン", "承認者"]
REVISION_HEADING = r"(?m)^#{1,3}\s*.*改訂履歴"
STATUS_TEXT = "ステータス:"
DISABLED_SECTION = "(?i)(disabled.modules|無効化モジュール|無効モジュール)"
ACTIVE_MENTION = r"(active:\s*(true|false)|presence\s*=\s*[01]|INSTALLED_APPS)"
INTERNAL_LINK = r"\[([^\]]+)\]\((?!https?://)(?!#)([^)]+)\)"
SEPARATOR_LINE = r"^\s*\|[\s\-:]+\|"
GRADE_POINTS = {"A": 3, "B": 2, "C": 1}
LETTERS = [(90, "A"), (80, "A-"), (70, "B+"), (60, "B"), (50, "B-"), (40, "C+")]
RAG_SECTIONS = [
    "SYSTEM_OVERVIEW", "COMPONENTS", "FLOW", "DEPENDENCY", "ERROR_HANDLING", "BUSINESS_RULES", "CONSTRAINTS", "KEYWORDS",
]
DIAGRAM_TYPES = [
    "flowchart", "sequenceDiagram", "erDiagram", "stateDiagram", "C4Context", "C4Container", "C4Component",
    "C4Deployment", "classDiagram", "gantt", "pie", "gitgraph",
]
OPENAPI_FIELDS = ["openapi", "info", "paths"]


def file_metrics(docs: DataFrame) -> DataFrame:
    """One row of counts per file: corpus, project, path and the numbers the axes need.

    ``docs`` has corpus, project, path, content. No shuffle.
    """
    df = with_sections(tx.with_lines(docs.select("corpus", "project", "path", "content")), 1, 3, "parts")
    df = tx.with_prose(df)
    body = F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))
    cited = F.size(F.filter(body, lambda p: F.array_join(F.slice(p["lines"], F.lit(2), F.greatest(F.size(p["lines"]) - 1, F.lit(0))), "\n").rlike(LOOSE)))
    path, text = F.col("path"), F.col("content")
    hits = lambda c, ok: F.size(F.filter(c, lambda l: F.coalesce(ok(l), F.lit(False))))
    separator = lambda l: l.rlike(SEPARATOR_LINE)
    cover = F.lit(True)
    for m in COVER_MARKERS:
        cover = cover & F.contains(text, F.lit(m))
    rows = hits("lines", lambda l: l.rlike(r"^\s*\|") & ~separator(l) & ~F.contains(l, F.lit("---")))
    is_manual, is_named = path.rlike("^manual/"), path.rlike("^(manual|architecture)/")
    scored = is_named & path.endswith(".md")
    page = lambda name: path.rlike(rf"^manual/[^/]+/{name}$")
    zero = F.lit(0)
    sections = F.when(scored, F.size("parts") - 1).otherwise(zero)
    return df.select(
        "corpus",
        "project",
        "path",
        sections.alias("sections"),
        F.when(scored, cited).otherwise(zero).alias("cited"),
        F.when(path.rlike(r"^diagrams/.*\.mmd$"), 1).otherwise(zero).alias("mmd"),
        F.when(path.rlike(r"^diagrams/.*\.svg$"), 1).otherwise(zero).alias("svg"),
        F.when(is_manual, F.regexp_count(text, F.lit("```mermaid"))).otherwise(zero).alias("inline"),
        F.regexp_count(text, F.lit(INTERNAL_LINK)).alias("links"),
        F.when(page(r"04-api-reference\.md"), F.greatest(zero, rows - hits("lines", separator))).alias("api_rows"),
        (path.rlike(r"^manual/[^/]+/openapi\.yaml$")).alias("has_openapi"),
        F.when(page(r"05-data-model\.md"), hits("prose", lambda l: l.rlike(r"^#{2,4}\s+.+"))).alias("model_headings"),
        F.when(page(r"06-screen-specs\.md"), hits("prose", lambda l: l.rlike(r"^#{2,3}\s+.+"))).alias("screen_headings"),
        F.regexp_count(text, F.lit(SPECULATION)).alias("speculation"),
        F.regexp_count(text, F.lit(UNCONFIRMED)).alias("unconfirmed"),
        text.rlike(DISABLED_SECTION).alias("has_disabled"),
        text.rlike(ACTIVE_MENTION).alias("has_active"),
        *[text.rlike(rf"Tier\s*{t}").alias(f"has_tier{t}") for t in (1, 2, 3)],
        (page(r"00-index\.md") & cover).alias("has_cover"),
        (is_manual & text.rlike(REVISION_HEADING)).alias("has_revision"),
        (is_manual & F.contains(text, F.lit(STATUS_TEXT))).alias("has_status"),
        is_manual.alias("in_manual"),
    )


SUMS = ["sections", "cited", "mmd", "svg", "inline", "links", "api_rows", "model_headings", "screen_headings", "speculation", "unconfirmed"]
FLAGS = ["has_openapi", "has_disabled", "has_active", "has_tier1", "has_tier2", "has_tier3", "has_cover", "has_revision", "has_status", "in_manual"]
PROJECT = ["corpus", "project"]


def expected_present(project: Column, path: Column) -> Column:
    """The expected file a path is, by template, or NULL."""
    generic = F.when(
        F.startswith(path, F.concat(project, F.lit("-"))),
        F.concat(F.lit("{name}"), F.substring(path, F.length(project) + 1, F.length(path))),
    ).otherwise(
        F.regexp_replace(
            path,
            F.concat(F.lit(r"^(architecture|manual|explanations|decisions)/\Q"), project, F.lit(r"\E(?=[/.])")),
            F.lit("$1/{name}"),
        )
    )
    return F.when(generic.isin(EXPECTED_FILES), generic)


def missing_files(docs: DataFrame) -> DataFrame:
    """Expected files that a project lacks: corpus, project, expected.

    The list is fixed, so a project's present files are at most that many distinct names; the difference
    is taken in the row of the project, without a join.
    """
    present = F.collect_set(expected_present(F.col("project"), F.col("path")))
    wanted = F.array(*[F.lit(e) for e in EXPECTED_FILES])
    return (
        docs.where(F.col("project").isNotNull())
        .groupBy(*PROJECT)
        .agg(present.alias("present"))
        .select(*PROJECT, F.explode_outer(F.array_except(wanted, F.col("present"))).alias("expected")).where(F.col("expected").isNotNull())
        .select(*PROJECT, F.replace("expected", F.lit("{name}"), F.col("project")).alias("expected"))
    )


def suggestions(missing: DataFrame) -> DataFrame:
    """Every missing file with its rank in the project and the number of them: corpus, project, rank, expected, missing.

    A project misses at most the fixed list of expected files, so its list is one short array.
    """
    names = F.array_sort(F.collect_list("expected"))
    each = missing.groupBy(*PROJECT).agg(names.alias("n")).select(*PROJECT, F.size("n").alias("missing"), F.posexplode("n").alias("at", "expected"))
    return each.select(*PROJECT, (F.col("at") + 1).alias("rank"), "expected", "missing")


def low_citation_files(docs: DataFrame) -> DataFrame:
    """Files of which less than half of the sections cite a source: corpus, project, path, sections, cited."""
    # a filter on the columns themselves would be pushed below the projection, with a copy of all that they are made of
    counts = F.inline_outer(F.array(F.struct("sections", "cited")))
    m = file_metrics(docs.where(F.col("project").isNotNull())).select("corpus", "project", "path", counts)
    return m.where((F.col("sections") > 0) & (F.col("cited") * 2 < F.col("sections")))


def project_metrics(docs: DataFrame) -> DataFrame:
    """Sums and flags per (corpus, project), with the number of expected files found."""
    m = file_metrics(docs.where(F.col("project").isNotNull())).withColumn(
        "expected_name", expected_present(F.col("project"), F.col("path"))
    )
    return m.groupBy(*PROJECT).agg(
        *[F.sum(c).alias(c) for c in SUMS],
        *[F.bool_or(c).alias(c) for c in FLAGS],
        F.count_distinct("expected_name").alias("expected_found"),
        F.count_if((F.col("sections") > 0) & (F.col("cited") * 2 < F.col("sections"))).alias("low_citation_files"),
    )


def _grade(value: Column, a: float, b: float) -> Column:
    return F.when(value >= a, "A").when(value >= b, "B").otherwise("C")


def axis_scores(metrics: DataFrame) -> DataFrame:
    """Long form: corpus, project, axis, grade, score, value, suggestion (NULL when there is nothing to do)."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    ratio = F.when(n("sections") > 0, n("cited") / n("sections")).otherwise(F.lit(0.0))
    diagrams = n("mmd") + n("svg") + n("inline")
    found = n("expected_found") / F.lit(len(EXPECTED_FILES))
    tiers = flag("has_tier1") & flag("has_tier2") & flag("has_tier3")
    valid = sum((c.cast("int") for c in (flag("has_disabled"), flag("has_active"), tiers)), F.lit(0))
    formal = sum((flag(c).cast("int") for c in ("has_cover", "has_revision", "has_status")), F.lit(0))
    spec = n("speculation")
    axes = [
        ("grounding", _grade(ratio, 0.8, 0.5), ratio, n("low_citation_files") > 0, "add citations to sections"),
        ("completeness", _grade(found, 0.9, 0.7), found, n("expected_found") < len(EXPECTED_FILES), "add missing files"),
        ("diagrams", _grade(diagrams, 10, 5), diagrams, diagrams < 5, "add diagrams"),
        ("cross_references", _grade(n("links"), 20, 10), n("links"), n("links") < 10, "add internal links"),
        ("api", F.when(flag("has_openapi"), "A").otherwise(_grade(n("api_rows"), 20, 5)), n("api_rows"), n("api_rows") < 5, "add API rows"),
        ("tables", _grade(n("model_headings"), 10, 5), n("model_headings"), n("model_headings") < 5, "add table sections"),
        ("screens", _grade(n("screen_headings"), 15, 5), n("screen_headings"), n("screen_headings") < 5, "add screen sections"),
        ("speculation", F.when(spec == 0, "A").when(spec <= 5, "B").otherwise("C"), spec, spec > 0, "resolve speculation"),
        ("modules", _grade(valid, 3, 1), valid, valid < 3, "document module validity"),
        ("formal", _grade(formal, 3, 2), formal, formal < 3, "add cover, history and status"),
    ]
    rows = [
        F.struct(
            F.lit(name).alias("axis"),
            grade.alias("grade"),
            F.round(value.cast("double"), 6).alias("value"),
            F.when(todo, hint).alias("suggestion"),
        )
        for name, grade, value, todo, hint in axes
    ]
    points = F.element_at(F.create_map(*[F.lit(x) for kv in GRADE_POINTS.items() for x in kv]), F.col("a.grade"))
    return metrics.select(*PROJECT, F.explode_outer(F.array(*rows)).alias("a")).where(F.col("a").isNotNull()).select(
        *PROJECT, "a.axis", "a.grade", points.alias("score"), "a.value", "a.suggestion"
    )


def letter(score: Column) -> Column:
    chain = None
    for low, name in LETTERS:
        chain = F.when(score >= low, name) if chain is None else chain.when(score >= low, name)
    return chain.otherwise("C")


def scorecards(axes: DataFrame, threshold: str | None = None) -> DataFrame:
    """Per project: numeric 0-100 (half to even), letter, number of suggestions, and the gate."""
    points = F.sum("score") / (F.count("*") * max(GRADE_POINTS.values())) * 100
    df = axes.groupBy(*PROJECT).agg(
        F.bround(points).cast("int").alias("numeric_score"), F.count("suggestion").alias("suggestions")
    )
    df = df.withColumn("grade", letter(F.col("numeric_score")))
    if threshold is not None:
        low = {name: low for low, name in LETTERS} | {"C": 0}
        df = df.withColumn("passed", F.col("numeric_score") >= low[threshold])
    return df


def table_coverage(metrics: DataFrame, catalog: DataFrame) -> DataFrame:
    """Documented table sections against the tables of the catalog, per corpus."""
    documented = metrics.groupBy("corpus").agg(F.sum("model_headings").alias("documented"))
    known = catalog.groupBy("corpus").agg(F.count("*").alias("known"))
    return documented.join(known, "corpus").select("corpus", "documented", "known", (F.col("documented") < F.col("known")).alias("short"))


def missing_rag_sections(files: DataFrame) -> DataFrame:
    """Required sections that a page lacks: corpus, path, section. Fixed list, tested in the row."""
    tests = [F.when(~F.col("content").rlike(rf"##\s*{s}"), F.lit(s)) for s in RAG_SECTIONS]
    return files.select("corpus", "path", F.explode_outer(F.array_compact(F.array(*tests))).alias("section")).where(F.col("section").isNotNull())


def diagram_syntax(files: DataFrame) -> DataFrame:
    """corpus, path, diagram_type (first word), problem: NULL when the file starts with a known type."""
    body = F.regexp_replace("content", r"^\s+|\s+\z", "")
    word = F.regexp_extract(body, r"^(\S+)", 1)
    known = word.rlike("^(" + "|".join(DIAGRAM_TYPES) + ")(-.*)?$")
    problem = F.when(body == "", "file is empty").when(~known, "invalid diagram type")
    return files.select("corpus", "path", word.alias("diagram_type"), problem.alias("problem"))


def missing_openapi_fields(files: DataFrame) -> DataFrame:
    """Required top-level fields a specification lacks, JSON or YAML: corpus, path, field."""
    text = F.col("content")
    json_keys = F.json_object_keys(text)
    is_json = F.regexp_like(text, F.lit(r"^\s*\{"))
    has = lambda f: F.when(is_json, F.coalesce(F.array_contains(json_keys, f), F.lit(False))).otherwise(
        text.rlike(rf"(?m)^['\"]?{f}['\"]?\s*:")
    )
    return files.select(
        "corpus", "path", F.explode_outer(F.array_compact(F.array(*[F.when(~has(f), F.lit(f)) for f in OPENAPI_FIELDS]))).alias("field")
    ).where(F.col("field").isNotNull())


def unconfirmed_decisions(files: DataFrame) -> DataFrame:
    return files.groupBy("corpus").agg(F.sum(F.regexp_count("content", F.lit(UNCONFIRMED))).alias("unconfirmed"))


def page_estimates(files: DataFrame) -> DataFrame:
    """Merged size of the chapters of a corpus: chapters, lines, bytes, pages of 40 lines."""
    lines = F.sum(tx.line_count(F.col("content")))
    return files.groupBy("corpus").agg(
        F.count("*").alias("chapters"),
        lines.alias("lines"),
        F.sum(F.length("content")).alias("chars"),
        F.greatest(F.lit(1), F.floor(lines / 40)).cast("bigint").alias("pages"),
    )
