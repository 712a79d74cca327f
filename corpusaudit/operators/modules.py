"""Disabled modules must not show up in feature lists, pages or routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions import text as tx
from corpusaudit.operators.joins import join_per_corpus
from corpusaudit.operators.lines import with_sections
from corpusaudit.operators.literals import find_literals

# Labels of the first column that are headers, not features.
HEADER_LABELS = ["機能名", "モジュール名", "feature", "module", "名前", "name"]
FIRST_CELL = r"^\|\s*([^|]+?)\s*\|"


def feature_names(docs: DataFrame) -> DataFrame:
    """First cells of table rows in sections that mention a tier: corpus, feature."""
    df = docs.where(F.col("content").rlike(r"(?i)Tier\s*[123]")).select("corpus", "path", "content")
    run = with_sections(tx.with_lines(df), 1, 4).select("corpus", F.explode_outer("parts").alias("p")).where(F.col("p").isNotNull())
    tiered = run.where(F.exists("p.lines", lambda l: l.rlike(r"(?i)Tier\s*[123]")))
    cell = tiered.select("corpus", F.explode_outer("p.lines").alias("line")).where(F.col("line").isNotNull()).select(
        "corpus", F.trim(F.regexp_extract("line", FIRST_CELL, 1)).alias("feature")
    )
    keep = (F.col("feature") != "") & ~F.col("feature").rlike("^[-:]") & ~F.lower("feature").isin(HEADER_LABELS)
    return cell.where(keep).distinct()


def verify_modules(features: DataFrame, disabled: DataFrame) -> DataFrame:
    """Verdict per disabled module: FAIL when some feature name contains it, case ignored."""
    mods = disabled.where(F.col("name") != "").select("corpus", "name", F.lower("name").alias("needle")).distinct()
    texts = features.select("corpus", F.lower("feature").alias("content")).distinct()
    # the feature name is its own key, so it rides along
    keyed = texts.withColumn("feature", F.col("content"))
    hits = find_literals(keyed, mods, ["corpus", "feature"], within=["corpus"]).select("corpus", "needle").distinct()
    listed = features.select("corpus").distinct().withColumn("listed", F.lit(True))
    judged = join_per_corpus(
        mods.join(hits.withColumn("found", F.lit(True)), ["corpus", "needle"], "left"), listed, ["name"]
    )
    each = judged.where(F.col("listed")).select(
        "corpus", F.when(F.col("found"), "FAIL").otherwise("OK").alias("status"), F.col("name").alias("label")
    )
    blind = (
        judged.where(F.col("listed").isNull())
        .select("corpus")
        .distinct()
        .select("corpus", F.lit("WARN").alias("status"), F.lit("no tier table").alias("label"))
    )
    message = F.when(F.col("status") == "FAIL", "disabled but listed").otherwise("")
    return each.unionByName(blind).select(F.lit("module").alias("check"), "corpus", "status", "label", message.alias("message"))


def modules_in_pages(pages: DataFrame, disabled: DataFrame) -> DataFrame:
    """Disabled modules named as whole words in a feature page: corpus, path, name."""
    texts = pages.select("corpus", "path", F.lower("content").alias("content"))
    mods = disabled.where(F.col("name") != "").select("corpus", F.lower("name").alias("needle")).distinct()
    return find_literals(texts, mods, ["corpus", "path"], within=["corpus"], words=True).select(
        "corpus", "path", F.col("needle").alias("name")
    )


def drop_disabled_routes(routes: DataFrame, disabled: DataFrame) -> DataFrame:
    """Routes whose name or some path segment is a disabled module are left out."""
    off = disabled.where(F.col("name") != "").select("corpus", F.lower("name").alias("word")).distinct()
    words = F.array_distinct(
        F.concat(
            F.array(F.lower(F.coalesce("name", F.lit("")))),
            F.split(F.regexp_replace(F.lower("path"), "^/+|/+$", ""), "/"),
        )
    )
    hit = (
        routes.select("corpus", "path", "name", F.explode_outer(words).alias("word")).where(F.col("word").isNotNull())
        .join(off, ["corpus", "word"], "left_semi")
        .select("corpus", "path", "name")
        .distinct()
    )
    same = (routes["corpus"] == hit["corpus"]) & (routes["path"] == hit["path"]) & routes["name"].eqNullSafe(hit["name"])
    return routes.join(hit, same, "left_anti")
