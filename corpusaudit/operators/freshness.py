"""Age of documents against their sources, and the badge that shows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD_DAYS = 7

# Date forms in a document or fact file, and the texts of the badge.
DOC_DATES = [r"last_updated:\s*[\"']?(\d{4}-\d{2}-\d{2})[\"']?", r"生成日:\s*(\d{4}-\d{2}-\d{2})", r"Generated:\s*(\d{4}-\d{2}-\d{2})"]
FACT_DATES = [r"generated_at:\s*[\"']?(\d{4}-\d{2}-\d{2})", r"date:\s*[\"']?(\d{4}-\d{2}-\d{2})[\"']?"]
BADGE = "> 📊 鮮度:"
BADGE_UNKNOWN = "❓ 不明（ファクトキャッシュが見つかりません）"
BADGE_FRESH = "✅ 最新（生成日: %s, ソース最終更新: %s）"
BADGE_STALE = "⚠️ 要更新（生成日: %s, ソース最終更新: %s — %s日経過）"
BADGE_NO_SOURCE = "不明"


def document_date(content: Column, modified_at: Column, forms: list[str] = DOC_DATES) -> Column:
    """First readable date in the text, else the day the file was changed."""
    found = [F.try_to_date(F.nullif(F.regexp_extract(content, f, 1), F.lit(""))) for f in forms]
    return F.coalesce(*found, F.to_date(modified_at))


def freshness(docs: DataFrame, threshold: int = THRESHOLD_DAYS) -> DataFrame:
    """Adds age_days and state (fresh / stale / unknown) to rows with doc_date and source_date."""
    age = F.date_diff(F.col("source_date"), F.col("doc_date"))
    state = (
        F.when(F.col("doc_date").isNull() | F.col("source_date").isNull(), "unknown")
        .when(age > threshold, "stale")
        .otherwise("fresh")
    )
    return docs.select("*", age.alias("age_days"), state.alias("state"))


def stale_first(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("state") == "stale").orderBy(F.desc("age_days"), "corpus", "path")


def badge(doc_date: Column, source_date: Column, threshold: int = THRESHOLD_DAYS) -> Column:
    age = F.date_diff(source_date, doc_date)
    day = lambda d: F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit(BADGE_NO_SOURCE))
    text = (
        F.when(doc_date.isNull(), BADGE_UNKNOWN)
        .when(age > threshold, F.format_string(BADGE_STALE, day(doc_date), day(source_date), age.cast("string")))
        .otherwise(F.format_string(BADGE_FRESH, day(doc_date), day(source_date)))
    )
    return F.concat(F.lit(BADGE + " "), text)


def with_badge(content: Column, line: Column) -> Column:
    """Page with the badge: in place of an old one, else below the first title, else on top."""
    old = rf"(?m)^[^\n]*{BADGE}[^\n]*$"
    quoted = F.regexp_replace(line, r"([\\$])", r"\\$1")
    titled = r"(?m)\A((?:(?!# )[^\n]*\n)*# [^\n]*(?:\n|\z))"
    return (
        F.when(content.rlike(old), F.regexp_replace(content, F.lit(old), quoted))
        .when(content.rlike(titled), F.regexp_replace(content, F.lit(titled), F.concat(F.lit("$1\n"), quoted, F.lit("\n"))))
        .otherwise(F.concat(line, F.lit("\n\n"), content))
    )
