"""Links of Markdown and HTML pages, and the check that their targets exist."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions import globs, paths
from corpusaudit.functions import text as tx
from corpusaudit.operators.classify import with_suffix
from corpusaudit.operators.joins import join_by_hash
from corpusaudit.operators.lines import KEY

# Suffix of pages, form of a link, prefixes of external addresses.
PAGE = [".md"]
LINK = r"!?\[([^\]]*)\]\(([^)]+)\)"
EXTERNAL = "^(https?://|mailto:|ftp://)"

# Which page is expected to show a generated image, first match wins.
IMAGE_RULES = [
    (r"^(.+)-screen-flow\.svg$", ["manual/{name}/02-screen-flow.md"]),
    (r"^(.+)-architecture\.svg$", ["manual/{name}/01-overview.md"]),
    (r"^(.+)-data-flow\.svg$", ["manual/{name}/05-data-model.md"]),
    (r"^(.+)-er-\w+\.svg$", ["manual/{name}/05-data-model.md"]),
    (r"^(.+)-feat-\w+\.svg$", ["manual/{name}/features/*.md", "manual/{name}/03-features.md"]),
    (r"^(.+)-seq-\w+\.svg$", ["manual/{name}/07-walkthrough.md"]),
    (r"^(.+)-context\.svg$", ["architecture/{name}.md"]),
    (r"^(.+)-container\.svg$", ["architecture/{name}.md"]),
    (r"^(.+)-component\.svg$", ["architecture/{name}.md"]),
    (r"^(.+)-deployment\.svg$", ["architecture/{name}.md"]),
]


def is_external(url: Column) -> Column:
    return url.rlike(EXTERNAL)


def matches_any(url: Column, patterns: Iterable[str]) -> Column:
    """Ignore list of globs, tested as one expression."""
    patterns = list(patterns)
    return url.rlike(globs.any_of(patterns)) if patterns else F.lit(False)


def markdown_links(files: DataFrame, skip_fences: bool = False) -> DataFrame:
    """corpus, path, line_no, link_no, text, url, is_image; several links on a line are several rows."""
    df = files.select(*KEY, "content").where(F.contains("content", F.lit("](")))
    if skip_fences:
        df = df.withColumn("content", tx.prose_text(F.col("content")))
    line = df.select(*KEY, F.posexplode_outer(tx.split_lines(F.col("content"))).alias("pos", "line")).where(F.col("pos").isNotNull()).where(F.contains("line", F.lit("](")))
    raw = line.select(
        *KEY,
        (F.col("pos") + 1).alias("line_no"),
        F.posexplode_outer(F.regexp_extract_all("line", F.lit(LINK), F.lit(0))).alias("n", "raw"),
    ).where(F.col("n").isNotNull())
    return raw.select(
        *KEY,
        "line_no",
        (F.col("n") + 1).alias("link_no"),
        F.regexp_extract("raw", LINK, 1).alias("text"),
        F.regexp_extract("raw", LINK, 2).alias("url"),
        F.startswith("raw", F.lit("!")).alias("is_image"),
    )


def html_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every ``href`` of a page: the columns of ``pages`` but the text, plus link_no and url."""
    keep = [c for c in pages.columns if c != html]
    found = F.regexp_extract_all(F.col(html), F.lit('href="([^"]*)"'), F.lit(1))
    return pages.select(*keep, F.posexplode_outer(found).alias("n", "url")).where(F.col("n").isNotNull()).select(
        *keep, (F.col("n") + 1).alias("link_no"), "url"
    )


def resolve_links(links: DataFrame) -> DataFrame:
    """Add target_path and anchor. A title after the address is not part of it."""
    quoted = F.contains("url", F.lit('"')) | F.contains("url", F.lit("'"))
    bare = F.when(quoted, F.regexp_replace("url", r"\s+[\"'].*$", "")).otherwise(F.col("url"))
    anchor = F.when(F.contains(bare, F.lit("#")), F.substr(bare, F.instr(bare, "#") + 1))
    df = links.withColumn("_file", F.substring_index(bare, "#", 1)).withColumn(
        "anchor", F.when(anchor != "", F.lower(anchor))
    )
    # a column of its own, so that it is put together once
    df = df.withColumn("_joined", paths.joined(F.col("path"), F.col("_file")))
    return df.withColumn("target_path", paths.normalise(F.col("_joined"))).drop("_file", "_joined")


def folders_of(path: Column) -> Column:
    """All folders that a file lies in; the root is one of a file at the top."""
    folder = paths.dirname(path)
    return F.concat(paths.parents(folder), F.array(folder))


def page_targets(files: DataFrame) -> DataFrame:
    """One row per file: corpus, target_path, is_file, and the slugs of its headings.

    Only pages are read for headings; of other files the path is enough.
    """
    is_page = F.col("path").endswith(PAGE[0])
    # one pass: the text of what is no page is not looked at
    text = files.select(*KEY, F.when(is_page & F.contains("content", F.lit("#")), tx.prose_text(F.col("content"))).alias("text"))
    slugs = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(tx.in_text(tx.HEADING)), F.lit(1)), tx.slug))
    none = F.array().cast("array<string>")
    return text.select("corpus", F.col("path").alias("target_path"), F.lit(True).alias("is_file"), F.coalesce(slugs, none).alias("slugs"))


def targets(files: DataFrame) -> DataFrame:
    """What a link may point to: one row per file with the slugs of its headings, one per folder."""
    folders = (
        files.select("corpus", paths.dirname(F.col("path")).alias("folder"))
        .distinct()
        .select("corpus", F.explode_outer(F.concat(paths.parents(F.col("folder")), F.array("folder"))).alias("target_path"))
        .distinct()
    )
    none = F.array().cast("array<string>")
    return page_targets(files).unionByName(folders.select("corpus", "target_path", F.lit(False).alias("is_file"), none.alias("slugs")))


def local_links(files: DataFrame, ignore: Iterable[str] = (), skip_fences: bool = False) -> DataFrame:
    """Links of pages into their own corpus, with target_path and anchor."""
    links = markdown_links(with_suffix(files, PAGE), skip_fences)
    return resolve_links(links.where(~is_external(F.col("url")) & ~matches_any(F.col("url"), ignore)))


def link_fault() -> Column:
    """What is wrong with a link, by its ``anchor`` and the ``is_file`` and ``slugs`` of its target; null if nothing."""
    return (
        F.when(F.col("is_file").isNull(), "file not found")
        .when(F.col("anchor").isNotNull() & ~F.col("is_file"), "cannot read target")
        .when(F.col("anchor").isNotNull() & ~F.array_contains("slugs", F.col("anchor")), "anchor not found")
    )


def check_links(files: DataFrame, ignore: Iterable[str] = (), skip_fences: bool = False) -> DataFrame:
    """Broken links of pages: corpus, path, line_no, url, reason, target_path, anchor.

    One join: the headings of a target travel with the target as an array, so an anchor needs no second
    look-up. The target side is unique per key; a target that a third of all links point to is split by
    the skew join of AQE.
    """
    found = join_by_hash(local_links(files, ignore, skip_fences), targets(files), ["corpus", "target_path"], "left")
    return (
        found.withColumn("reason", link_fault())
        .where(F.col("reason").isNotNull())
        .select(*KEY, "line_no", "url", "reason", "target_path", "anchor")
    )


def check_index_links(files: DataFrame, index_path: str = "index.md") -> DataFrame:
    """Links of the index page that lead nowhere; targets are taken from the corpus root."""
    index = files.where(F.col("path") == index_path)
    links = markdown_links(index).where(~F.col("url").rlike("^(https?://|#|mailto:)"))
    aimed = links.withColumn("target_path", paths.normalise(F.substring_index("url", "#", 1))).where(
        F.col("target_path") != ""
    )
    known = targets(files).select("corpus", "target_path")
    return aimed.join(known, ["corpus", "target_path"], "left_anti").select(*KEY, "line_no", "url", "target_path")


def broken_page_links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Links of web pages with no page of the site at that path; paths are matched without query.

    An address that starts with a slash is taken from the root of the site, any other from the folder of its page.
    """
    site = F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)
    at = F.regexp_extract(url, "^[a-z]+://[^/?#]*([^?#]*)", 1)
    source = F.regexp_replace(at, "^/", "")
    file = F.regexp_extract("url", "^([^?#]*)", 1)
    aimed = (
        html_links(pages.select("page_id", site.alias("corpus"), source.alias("source"), F.col(html)), html)
        .where(~is_external(F.col("url")))
        .withColumn("target_path", paths.resolve(F.col("source"), file))
        .drop("source")
    )
    known = pages.select(site.alias("corpus"), paths.normalise(at).alias("target_path")).distinct()
    return aimed.join(known, ["corpus", "target_path"], "left_anti")


def _expected(name: Column) -> Column:
    """First rule that matches an image name: project and templates."""
    chain = None
    for regex, templates in IMAGE_RULES:
        hit = F.struct(
            F.regexp_extract(name, regex, 1).alias("name"), F.array(*[F.lit(t) for t in templates]).alias("templates")
        )
        chain = F.when(name.rlike(regex), hit) if chain is None else chain.when(name.rlike(regex), hit)
    return chain


def unreferenced_images(files: DataFrame) -> DataFrame:
    """Generated images that no expected page shows: corpus, image, expected (page or folder/*).

    A project may have many images and many feature pages, so images are never paired with pages: both
    sides meet on ``(corpus, page key)`` for existence and on ``(corpus, page key, image name)`` for the
    mention. Names are compared whole.
    """
    name = paths.basename(F.col("path"))
    images = (
        files.where(F.col("path").rlike(r"^diagrams/[^/]+\.svg$"))
        .select("corpus", name.alias("image"), _expected(name).alias("rule"))
        .where(F.col("rule").isNotNull())
        .select("corpus", "image", "rule.name", F.explode_outer("rule.templates").alias("template")).where(F.col("template").isNotNull())
        .select("corpus", "image", F.replace("template", F.lit("{name}"), F.col("name")).alias("key"))
    )
    pages = files.where(F.col("path").rlike(r"^(manual|architecture)/.*\.md$"))
    keys = F.explode(F.array(F.col("path"), F.concat(paths.dirname(F.col("path")), F.lit("/*.md")))).alias("key")
    page_keys = pages.select("corpus", keys).distinct().withColumn("has_page", F.lit(True))
    shown = F.regexp_extract_all("content", F.lit(r"([^/\\\s()\[\]\"'<>]+\.svg)"), F.lit(1))
    mentions = (
        pages.where(F.contains("content", F.lit(".svg")))
        .select("corpus", "path", F.explode_outer(F.array_distinct(shown)).alias("image")).where(F.col("image").isNotNull())
        .select("corpus", "image", keys)
        .distinct()
        .withColumn("shown", F.lit(True))
    )
    seen = images.join(page_keys, ["corpus", "key"], "left").join(mentions, ["corpus", "key", "image"], "left")
    return (
        seen.groupBy("corpus", "image")
        .agg(
            F.bool_or(F.coalesce("has_page", F.lit(False))).alias("has_page"),
            F.bool_or(F.coalesce("shown", F.lit(False))).alias("shown"),
            F.array_sort(F.collect_set(F.when(F.col("has_page"), F.col("key")))).alias("expected"),
        )
        .where(F.col("has_page") & ~F.col("shown"))
        .select("corpus", "image", F.array_join("expected", ",").alias("expected"))
    )
