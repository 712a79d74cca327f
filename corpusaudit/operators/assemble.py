"""Documents put together from many files: merged manuals, navigation, page exports.

A corpus may have any number of chapters, so the merged document is a table of blocks with a sort key.
It is never gathered into one row; the sink writes the blocks in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions import paths
from corpusaudit.functions import text as tx
from corpusaudit.operators.classify import project_of
from corpusaudit.operators.joins import join_per_corpus

# Fixed values.
PAGE_BREAK = "\n\n---\n\n"
FEATURE_CHAPTER = "03-features.md"
MANUAL_TITLES = {
    "00-index.md": "マニュアル目次", "01-overview.md": "システム概要", "02-screen-flow.md": "画面遷移図",
    "03-features.md": "機能カタログ", "04-api-reference.md": "APIリファレンス", "05-data-model.md": "データモデル",
    "06-screen-specs.md": "画面詳細設計", "07-walkthrough.md": "ウォークスルー", "08-review.md": "設計評価",
    "09-user-guide.md": "操作ガイド", "10-quick-reference.md": "クイックリファレンス",
}
EXPLANATION_TITLES = {"pro.md": "エンジニア向け", "sales.md": "営業向け", "beginner.md": "初心者向け"}
NAV_TITLES = {
    "index": "目次", "arc42": "arc42 ドキュメント", "rag": "RAG用", "feature": "機能: ", "decisions": "意思決定記録",
    "llms": "llms.txt", "agents": "AGENTS.md",
}
SECTION_ORDER = ["index", "Architecture", "Manual", "User Guide", "Explanations", "decisions", "AI Docs"]
TOC_TITLE = "# Table of Contents\n"


def chapter_key(path: Column) -> Column:
    """Chapters by file name; features right after the chapter that lists them."""
    feature = path.rlike(r"(^|/)features/[^/]+$")
    name = paths.basename(path)
    return F.struct(
        F.when(feature, FEATURE_CHAPTER).otherwise(name).alias("chapter"),
        feature.alias("is_feature"),
        name.alias("name"),
    )


def toc_title(content: Column, path: Column) -> Column:
    """First title of a chapter, else the name of its file."""
    found = F.trim(F.regexp_extract(content, r"(?m)^#\s+(.+)", 1))
    return F.when(found != "", found).otherwise(paths.stem(path))


def merged_blocks(files: DataFrame, include_toc: bool = True) -> DataFrame:
    """The merged manual as rows: corpus, part (0 title, 1 contents, 2 their end, 3 chapters), key, block.

    In the order ``corpus, part, key`` the blocks, one newline between them, are the document. Features
    without the chapter that lists them are left out, as there is no place for them.
    """
    key = chapter_key(F.col("path"))
    body = F.regexp_replace("content", r"\s+\z", "")
    chapters = files.select("corpus", key.alias("key"), "path", "content", body.alias("body"))
    has_list = files.where(paths.basename(F.col("path")) == FEATURE_CHAPTER).select("corpus").distinct()
    features = join_per_corpus(chapters.where(F.col("key.is_feature")), has_list, ["path"], "left_semi")
    both = chapters.where(~F.col("key.is_feature")).unionByName(features)
    first = both.groupBy("corpus").agg(F.min("key").alias("first"))
    lead = PAGE_BREAK.removeprefix("\n")
    if not include_toc:
        # the first chapter has nothing before it
        opening = first.select("corpus", F.col("first").alias("key"), F.lit(True).alias("opens"))
        head = F.when(F.col("opens"), "").otherwise(lead)
        return both.join(opening, ["corpus", "key"], "left").select(
            "corpus", F.lit(3).alias("part"), "key", F.concat(head, "body").alias("block")
        )
    entry = F.concat(F.lit("- "), toc_title(F.col("content"), F.col("path")))
    fixed = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(t).alias("block")) for p, t in ((0, TOC_TITLE), (2, ""))]))
    frame = first.select("corpus", "first", fixed.alias("f")).select("corpus", "f.part", F.col("first").alias("key"), "f.block")
    toc = both.select("corpus", F.lit(1).alias("part"), "key", entry.alias("block"))
    return (
        frame.unionByName(toc)
        .unionByName(both.select("corpus", F.lit(3).alias("part"), "key", F.concat(F.lit(lead), "body").alias("block")))
    )


def in_order(blocks: DataFrame) -> DataFrame:
    """Range-partitioned sort: a long document spreads over many tasks."""
    return blocks.orderBy("corpus", "part", "key")


def navigation(files: DataFrame) -> DataFrame:
    """Navigation as rows: corpus, project, section_rank, section, rank, title, path.

    Read in the order of the ranks and then the path this is the tree; sections without pages have no row.
    """
    path = F.col("path")
    name = paths.basename(path)
    number = F.regexp_extract(name, "^([0-9]{2})-", 1).try_cast("int")
    pick = lambda table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), name)
    row = lambda section, rank, title: F.struct(
        F.lit(section).alias("section"), rank.cast("int").alias("rank"), title.alias("title")
    )
    project = project_of(path)
    feature_title = F.concat(F.lit(NAV_TITLES["feature"]), tx.title_of(F.col("content"), paths.stem(path)))
    known = name.isin(list(MANUAL_TITLES))
    numbered = path.rlike("^manual/[^/]+/[^/]+$") & known
    entry = (
        F.when(path.rlike("^[^/]+-index\\.md$"), row("index", F.lit(0), F.lit(NAV_TITLES["index"])))
        .when(path.rlike(r"^architecture/[^/]+\.rag\.md$"), row("Architecture", F.lit(1), F.lit(NAV_TITLES["rag"])))
        .when(path.rlike(r"^architecture/[^/]+\.md$"), row("Architecture", F.lit(0), F.lit(NAV_TITLES["arc42"])))
        .when(numbered & (number <= 3), row("Manual", number, pick(MANUAL_TITLES)))
        .when(path.rlike(r"^manual/[^/]+/features/[^/]+\.md$"), row("Manual", F.lit(50), feature_title))
        .when(numbered & number.between(4, 8), row("Manual", number + 100, pick(MANUAL_TITLES)))
        .when(numbered & (number >= 9), row("User Guide", number, pick(MANUAL_TITLES)))
        .when(
            path.rlike("^explanations/[^/]+/[^/]+$") & name.isin(list(EXPLANATION_TITLES)),
            row("Explanations", F.array_position(F.array(*[F.lit(k) for k in EXPLANATION_TITLES]), name), pick(EXPLANATION_TITLES)),
        )
        .when(path.rlike(r"^decisions/[^/]+\.md$"), row("decisions", F.lit(0), F.lit(NAV_TITLES["decisions"])))
        .when(path.rlike(r"^[^/]+-llms\.txt$"), row("AI Docs", F.lit(0), F.lit(NAV_TITLES["llms"])))
        .when(path.rlike(r"^[^/]+-AGENTS\.md$"), row("AI Docs", F.lit(1), F.lit(NAV_TITLES["agents"])))
    )
    order = F.array(*[F.lit(s) for s in SECTION_ORDER])
    return (
        files.select("corpus", project.alias("project"), entry.alias("e"), "path")
        .where(F.col("e").isNotNull() & F.col("project").isNotNull())
        .select(
            "corpus",
            "project",
            F.array_position(order, F.col("e.section")).cast("int").alias("section_rank"),
            "e.section",
            "e.rank",
            "e.title",
            "path",
        )
    )


def export_pages(files: DataFrame) -> DataFrame:
    """Flat export: corpus, path, page_name, content (comments dropped, blank lines folded)."""
    flat = F.regexp_replace("path", r"[/\\]", "_")
    name = F.when(flat.endswith(".md"), flat).otherwise(F.concat(paths.stem(flat), F.lit(".md")))
    return files.where(F.col("path").rlike(r"\.(md|txt)$")).select(
        "corpus", "path", name.alias("page_name"), tx.tidy_page(F.col("content")).alias("content")
    )


def export_index(pages: DataFrame) -> DataFrame:
    """Lines of the index page as rows: corpus, page_name, line; ordered by page name when written."""
    title = F.replace(paths.stem(F.col("page_name")), F.lit("_"), F.lit(" / "))
    return pages.select(
        "corpus",
        "page_name",
        F.concat(F.lit("- ["), title, F.lit("]("), F.col("page_name"), F.lit(")")).alias("line"),
    ).distinct()


def archive_name(name: Column, day: Column) -> Column:
    return F.concat_ws("-", name, F.lit("docs"), F.date_format(day, "yyyy-MM-dd"))
