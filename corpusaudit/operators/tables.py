"""Table names that documents and sources mention, and the check of one against the other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions import globs
from corpusaudit.operators.joins import join_per_corpus
from corpusaudit.operators.lines import cell_under, table_rows

# Fixed values.
TABLE_NAME_HEADER = "テーブル名"
NOT_A_TABLE_SUFFIX = [
    "_id", "_at", "_by", "_to", "_on", "_dir", "_key", "_name", "_type", "_date", "_path", "_size",
    "_code", "_flag", "_fee", "_sale", "_cost", "_amount", "_ratio", "_price", "_total", "_count",
    "_time", "_status",
]
NOT_A_TABLE_PREFIX = ["is_", "has_", "can_", "should_", "fk_", "idx_", "uk_"]
QUOTED_SNAKE = r"`([a-z][a-z0-9]*(?:_[a-z0-9]+)+)`"
ER_BLOCK = r"(?s)```mermaid\s*\n\s*erDiagram(.*?)```"
ER_ENTITY = r"(?m)^\s*([A-Za-z][A-Za-z0-9_]+)\s*\{"
ER_RELATION = r"([A-Za-z][A-Za-z0-9_]+)\s*[|}{o]+--[|}{o]+\s*([A-Za-z][A-Za-z0-9_]+)"
LARAVEL_TABLE = r"""(?:Schema::create|Schema::table)\s*\(\s*['"](\w+)['"]"""
PRISMA_MAP = r'@@map\s*\(\s*"(\w+)"\s*\)'
PRISMA_MODEL = r"model\s+(\w+)\s*\{"
MODEL_TABLE = r"""\$table\s*=\s*['"](\w+)['"]"""


def looks_like_table(name: Column) -> Column:
    """Snake-case identifier that reads like a table: ``m_ t_ r_ s_`` prefix, or a plural."""
    excluded = name.rlike(globs.suffix_of(NOT_A_TABLE_SUFFIX)) | name.rlike(globs.prefix_of(NOT_A_TABLE_PREFIX))
    return ~excluded & (name.rlike("^[mtrs]_") | (F.endswith(name, F.lit("s")) & (F.length(name) > 4)))


def _all(text: Column, regex: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(group))


def documented_tables(docs: DataFrame) -> DataFrame:
    """Distinct (corpus, table_name) from table cells, ER blocks and quoted identifiers."""
    is_header = lambda l: F.contains(l, F.lit("|")) & F.contains(l, F.lit(TABLE_NAME_HEADER))
    cell = table_rows(docs, is_header).select(
        "corpus", cell_under("header", "cells", TABLE_NAME_HEADER).alias("table_name")
    )
    cell = cell.where((F.col("table_name") != "") & ~F.startswith("table_name", F.lit("-")))
    block = docs.where(F.contains("content", F.lit("erDiagram"))).select(
        "corpus", F.explode_outer(_all(F.col("content"), ER_BLOCK)).alias("block")
    ).where(F.col("block").isNotNull())
    names = F.concat(
        _all(F.col("block"), ER_ENTITY), _all(F.col("block"), ER_RELATION, 1), _all(F.col("block"), ER_RELATION, 2)
    )
    entity = block.select("corpus", F.explode_outer(F.array_distinct(names)).alias("table_name")).where(F.col("table_name").isNotNull())
    quoted = (
        docs.where(F.contains("content", F.lit("`")))
        .select("corpus", F.explode_outer(F.array_distinct(_all(F.col("content"), QUOTED_SNAKE))).alias("table_name")).where(F.col("table_name").isNotNull())
        .where(looks_like_table(F.col("table_name")))
    )
    return cell.unionByName(entity).unionByName(quoted).distinct()


def declared_tables(files: DataFrame) -> DataFrame:
    """Distinct (corpus, table_name) declared in migrations, Prisma schemas and Laravel models."""
    p, c = F.col("path"), F.col("content")
    none = F.array().cast("array<string>")
    laravel = F.when(p.rlike("^database/migrations/[^/]+$"), _all(c, LARAVEL_TABLE)).otherwise(none)
    prisma = F.when(p == "prisma/schema.prisma", F.concat(_all(c, PRISMA_MAP), _all(c, PRISMA_MODEL))).otherwise(none)
    first = F.slice(_all(c, MODEL_TABLE), F.lit(1), F.lit(1))
    model = F.when(p.rlike(r"^app/Models/[^/]+\.php$"), first).otherwise(none)
    where = p.rlike(r"^(database/migrations/[^/]+|prisma/schema\.prisma|app/Models/[^/]+\.php)$")
    return (
        files.where(where)
        .select("corpus", F.explode_outer(F.concat(laravel, prisma, model)).alias("table_name")).where(F.col("table_name").isNotNull())
        .distinct()
    )


def known_tables(*sources: DataFrame) -> DataFrame:
    """Union of the table names of all sources (catalog, migrations, models)."""
    return reduce(DataFrame.unionByName, [s.select("corpus", "table_name") for s in sources]).distinct()


def verify_tables(documented: DataFrame, known: DataFrame) -> DataFrame:
    """Verdict per documented table; one WARN for a corpus whose tables are not known at all."""
    judged = documented.join(known.withColumn("found", F.lit(True)), ["corpus", "table_name"], "left")
    with_known = known.select("corpus").distinct().withColumn("checkable", F.lit(True))
    judged = join_per_corpus(judged, with_known, ["table_name"])
    status = F.when(F.col("found"), "OK").when(F.col("checkable"), "FAIL").otherwise("WARN")
    each = judged.where(F.col("checkable")).select(
        "corpus", status.alias("status"), F.col("table_name").alias("label")
    )
    blind = (
        judged.where(F.col("checkable").isNull())
        .groupBy("corpus")
        .agg(F.concat(F.count("*").cast("string"), F.lit(" names")).alias("label"))
        .select("corpus", F.lit("WARN").alias("status"), "label")
    )
    message = F.when(F.col("status") == "FAIL", "not in the sources").when(F.col("status") == "WARN", "no known tables").otherwise("")
    return each.unionByName(blind).select(F.lit("table").alias("check"), "corpus", "status", "label", message.alias("message"))
