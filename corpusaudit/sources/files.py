"""Readers that make ``files`` and rule tables from storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusaudit import schemas
from corpusaudit.operators.classify import is_excluded, kind_of, with_suffix  # noqa: F401
from corpusaudit.operators.impact import IMPACT_RULES
from corpusaudit.operators.leakage import TERM_RULES, LeakRule, TermRule

DOC_SUFFIXES = [".md"]
FRESHNESS_SUFFIXES = [".md", ".yaml", ".yml"]
EXPORT_SUFFIXES = [".md", ".txt", ".yaml"]


def decode(raw: Column, on_bad_utf8: str = "replace") -> Column:
    """Text of a binary column: bad bytes become U+FFFD, or the whole value NULL with ``drop``."""
    text = raw.cast("string")
    if on_bad_utf8 == "replace":
        return F.make_valid_utf8(text)
    if on_bad_utf8 == "drop":
        return F.try_validate_utf8(text)
    raise ValueError("on_bad_utf8 is 'replace' or 'drop'")


def scan_tree(
    spark: SparkSession,
    root: str,
    glob: str | None = None,
    on_bad_utf8: str = "replace",
    skip_excluded: bool = True,
) -> DataFrame:
    """``files`` of all corpora below ``root``: the first folder is the corpus, the rest the path.

    Paths are filtered before the content is selected. ``glob`` is applied while listing.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/")
    below = F.substring_index("path", base + "/", -1)
    df = reader.load(base).select(
        F.substring_index(below, "/", 1).alias("corpus"),
        F.regexp_extract(below, "(?s)^[^/]*/(.*)$", 1).alias("path"),
        "content",
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified_at"),
    )
    if skip_excluded:
        df = df.where(~is_excluded(F.col("path")))
    df = df.withColumn("content", decode(F.col("content"), on_bad_utf8))
    return df.where(F.col("content").isNotNull()) if on_bad_utf8 == "drop" else df


def from_table(df: DataFrame, corpus: Column, path: Column, text: Column, modified_at: Column | None = None) -> DataFrame:
    """``files`` from any table with a text column."""
    return df.select(
        corpus.cast("string").alias("corpus"),
        path.cast("string").alias("path"),
        text.alias("content"),
        F.octet_length(text).cast("bigint").alias("size"),
        (F.lit(None).cast("timestamp") if modified_at is None else modified_at).alias("modified_at"),
    )


def _json(spark: SparkSession, schema: object, path: str, lines: bool) -> DataFrame:
    """Objects of a JSON array in one file, or one object a line in any number of files, read by many tasks."""
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path)


TERM_RULE = "wrong STRING, correct STRING, context STRING, in_code BOOLEAN"
LITERAL_RULE = "name STRING, literal STRING, regex STRING, severity STRING, description STRING"


def read_rule_table(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """Rules one a line, as many as there are, for ``leakage.wrong_terms_of`` and ``leakage.scan_many``."""
    return _json(spark, schema, path, lines=True)


def read_leak_rules(spark: SparkSession, path: str, lines: bool = False) -> list[LeakRule]:
    """Rules of a JSON file. They are configuration and are unrolled into the plan."""
    schema = "name STRING, regex STRING, severity STRING, description STRING, allow_in ARRAY<STRING>, only_in ARRAY<STRING>"
    rows = _json(spark, schema, path, lines).collect()
    return [
        LeakRule(r.name, r.regex, r.severity, r.description or "", tuple(r.allow_in or ()), tuple(r.only_in or ()))
        for r in rows
    ]


def read_term_rules(spark: SparkSession, path: str | None = None, lines: bool = False) -> list[TermRule]:
    """Rules of a JSON file; the built-in ones without a file."""
    if path is None:
        return list(TERM_RULES)
    rows = _json(spark, TERM_RULE, path, lines).collect()
    return [TermRule(r.wrong, r.correct, r.context or "", bool(r.in_code)) for r in rows]


def read_impact_rules(spark: SparkSession, path: str | None = None, lines: bool = False) -> list[tuple[str, list[str]]]:
    if path is None:
        return list(IMPACT_RULES)
    rows = _json(spark, "source_pattern STRING, docs ARRAY<STRING>", path, lines).collect()
    return [(r.source_pattern, list(r.docs)) for r in rows]


def read_routes(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Route list: a JSON array of objects, or one object a line. Anything else fails when it is read."""
    return _json(spark, schemas.ROUTES, path, lines)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts documents in JSON, in the long form corpus, category, name, active, source.

    A document is an object ``{"corpus": ..., "facts": {category: [{name, active, source, ...}]}}``.
    """
    item = "ARRAY<STRUCT<name STRING, active STRING, source STRING, method STRING, path STRING>>"
    raw = spark.read.schema(f"corpus STRING, facts MAP<STRING, {item}>").option("multiLine", True).json(path)
    return (
        raw.select("corpus", F.explode_outer("facts").alias("category", "items")).where(F.col("category").isNotNull())
        .select("corpus", "category", F.explode_outer("items").alias("i")).where(F.col("i").isNotNull())
        .select("corpus", "category", F.coalesce("i.name", F.concat_ws(" ", "i.method", "i.path")).alias("name"), "i.active", "i.source")
    )
