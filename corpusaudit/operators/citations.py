"""Source citations in documents, checked against the files they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions.text import line_count

# The two forms of a citation.
INLINE = r"\(([a-zA-Z0-9_./-]+\.\w+):(\d+(?:-\d+)?)\)"
COMMENT = r"<!--\s*source:\s*([a-zA-Z0-9_./-]+\.\w+):(\d+(?:-\d+)?)\s*-->"
LOOSE = r"\([^)]*:\d+\)|<!-- source: [^>]+-->"
BARE = r"([a-zA-Z0-9_./-]+\.\w+):(\d+(?:-\d+)?)"


def citations(docs: DataFrame) -> DataFrame:
    """Distinct citations per corpus: corpus, cited_path, line_spec. Repeats are dropped before the shuffle."""
    found = F.regexp_extract_all("content", F.lit(f"{INLINE}|{COMMENT}"), F.lit(0))
    return (
        docs.where(F.col("content").rlike(r":\d"))
        .select("corpus", F.explode_outer(F.array_distinct(found)).alias("raw")).where(F.col("raw").isNotNull())
        .select(
            "corpus",
            F.regexp_extract("raw", BARE, 1).alias("cited_path"),
            F.regexp_extract("raw", BARE, 2).alias("line_spec"),
        )
        .distinct()
    )


def file_lengths(files: DataFrame) -> DataFrame:
    """corpus, path, line_count: all that the check needs of a source file."""
    return files.select("corpus", "path", line_count(F.col("content")).alias("line_count"))


def verify_citations(cited: DataFrame, lengths: DataFrame) -> DataFrame:
    """Verdicts: check, corpus, status, label, message."""
    end = F.regexp_extract("line_spec", r"(\d+)$", 1).try_cast("bigint")
    known = lengths.select("corpus", F.col("path").alias("cited_path"), "line_count")
    status = (
        F.when(F.col("line_count").isNull(), "FAIL")
        .when(end.isNull() | (end > F.col("line_count")), "WARN")
        .otherwise("OK")
    )
    message = (
        F.when(F.col("line_count").isNull(), "file does not exist")
        .when(end.isNull(), "line number cannot be read")
        .when(end > F.col("line_count"), F.concat(F.lit("line out of range, last is "), F.col("line_count")))
        .otherwise("")
    )
    return cited.join(known, ["corpus", "cited_path"], "left").select(
        F.lit("citation").alias("check"),
        "corpus",
        status.alias("status"),
        F.concat_ws(":", "cited_path", "line_spec").alias("label"),
        message.alias("message"),
    )


def verdict_totals(verdicts: DataFrame) -> DataFrame:
    """ok / fail / warn per check and, with check NULL, per corpus."""
    count = lambda s: F.count_if(F.col("status") == s)
    return verdicts.groupingSets(
        [[F.col("corpus"), F.col("check")], [F.col("corpus")]], "corpus", "check"
    ).agg(count("OK").alias("ok"), count("FAIL").alias("fail"), count("WARN").alias("warn"))
