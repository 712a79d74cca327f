"""Leak rules, wrong terms and project names found in the lines of a corpus."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions import globs
from corpusaudit.operators.lines import KEY, explode_lines, prose_lines
from corpusaudit.operators.literals import find_literals


@dataclass(frozen=True)
class LeakRule:
    name: str
    regex: str
    severity: str
    description: str = ""
    allow_in: Sequence[str] = field(default_factory=tuple)
    only_in: Sequence[str] = field(default_factory=tuple)


@dataclass(frozen=True)
class TermRule:
    wrong: str
    correct: str
    context: str = ""
    in_code: bool = False


# Fixed values of the static checks. Leak rules are configuration and come from rule files (``read_leak_rules``).
TERM_RULES = [
    TermRule("Seting", "Setting", "typo"),
    TermRule("recieve", "receive", "typo"),
    TermRule("occured", "occurred", "typo"),
    TermRule("caculate", "calculate", "typo"),
]
SKIP_PREFIXES = ["docs/", "site/", ".cache/", ".git/"]
SKIP_SUFFIXES = [".png", ".jpg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf"]
NAMES_ALLOWED_IN = ["docs/", "site/", ".cache/", ".gitignore"]
GENERIC_NAMES = ["my-app", "sample-app", "example", "test", "demo"]


def skipped(path: Column) -> Column:
    return path.rlike(globs.prefix_of(SKIP_PREFIXES)) | path.rlike(globs.suffix_of(SKIP_SUFFIXES))


def _applies(rule: LeakRule, path: Column) -> Column:
    ok = F.lit(True)
    if rule.only_in:
        ok = path.rlike(globs.prefix_of(rule.only_in))
    if rule.allow_in:
        ok = ok & ~path.rlike(globs.prefix_of(rule.allow_in))
    return ok


def scan(files: DataFrame, rules: Sequence[LeakRule]) -> DataFrame:
    """Findings: check, corpus, path, line_no, rule, severity, matched, message.

    All rules are unrolled into one projection: one pass, no join, no shuffle, patterns compiled once, each with its
    own groups. Works on a stream as it does on a table.
    """
    lines = explode_lines(files.where(~skipped(F.col("path"))))
    hits = [
        F.when(
            _applies(r, F.col("path")) & F.col("line").rlike(r.regex),
            F.struct(
                F.lit(r.name).alias("rule"),
                F.lit(r.severity).alias("severity"),
                F.regexp_extract("line", r.regex, 0).alias("matched"),
                F.lit(r.description).alias("message"),
            ),
        )
        for r in rules
    ]
    none = F.array().cast("array<struct<rule:string,severity:string,matched:string,message:string>>")
    found = lines.select(*KEY, "line_no", F.explode_outer(F.array_compact(F.array(*hits)) if hits else none).alias("h")).where(F.col("h").isNotNull())
    return found.select(F.lit("leak").alias("check"), *KEY, "line_no", "h.rule", "h.severity", "h.matched", "h.message")


def scan_many(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings like those of ``scan`` for any number of rules, given as a table.

    ``rules`` has ``name, literal, regex, severity, description``. A rule is looked for by its ``literal``, which all its
    matches contain, in one pass for all rules; its regex, if it has one, then decides on the lines that contain it.
    """
    lines = explode_lines(files.where(~skipped(F.col("path")))).select(*KEY, "line_no", "line")
    needles = rules.withColumnRenamed("literal", "needle")
    hits = find_literals(lines, needles, [*KEY, "line_no", "line"], "line", carry=["name", "regex", "severity", "description"])
    matched = F.when(F.col("regex").isNull(), F.col("needle")).otherwise(F.regexp_substr("line", F.col("regex")))
    found = hits.withColumn("matched", matched).where(F.col("matched").isNotNull())
    return found.select(
        F.lit("leak").alias("check"), *KEY, "line_no", F.col("name").alias("rule"), "severity", "matched", F.col("description").alias("message")
    )


def name_findings(files: DataFrame, names: DataFrame, allow_in: Sequence[str] = NAMES_ALLOWED_IN) -> DataFrame:
    """Project names (``name``) in the lines of files, without regard to case, as findings like those of ``scan``.

    Files under ``allow_in`` may name projects. A line is a finding of a name once, whole name and all.
    """
    scanned = files.where(~skipped(F.col("path")) & ~F.col("path").rlike(globs.prefix_of(allow_in)))
    lines = explode_lines(scanned).select(*KEY, "line_no", F.lower("line").alias("content"))
    hits = find_literals(lines, names.select(F.lower("name").alias("needle")), [*KEY, "line_no"])
    return hits.select(
        F.lit("leak").alias("check"), *KEY, "line_no", F.concat(F.lit("project-name:"), F.col("needle")).alias("rule"), F.lit("CRITICAL").alias("severity"),
        F.col("needle").alias("matched"), F.lit("name of an analysed project").alias("message"),
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("corpus", "severity").agg(F.count("*").alias("findings"))


def gate(findings: DataFrame) -> DataFrame:
    """Per corpus: counts per severity and whether anything CRITICAL or HIGH was found."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return findings.groupBy("corpus").agg(
        n("CRITICAL").alias("critical"),
        n("HIGH").alias("high"),
        n("MEDIUM").alias("medium"),
        F.count("*").alias("total"),
        (n("CRITICAL") + n("HIGH") > 0).alias("blocked"),
    )


def _holds_any(text: Column, words: Sequence[str]) -> Column:
    """Some word is in the text."""
    return text.rlike("|".join(globs.literal(w) for w in words)) if words else F.lit(False)


def wrong_terms(files: DataFrame, rules: Sequence[TermRule] = tuple(TERM_RULES)) -> DataFrame:
    """Wrong terms outside fenced code, one finding per line and rule, case-sensitive. One pass for all rules."""
    words = [r.wrong for r in rules]
    # a text without any of the words need not be split
    lines = prose_lines(files.where(_holds_any(F.col("content"), words)))
    hits = [
        F.when(
            F.contains("line", F.lit(r.wrong)),
            F.struct(
                F.lit(r.wrong).alias("matched"),
                F.lit(r.correct).alias("expected"),
                F.lit(r.context).alias("message"),
                F.lit("info" if r.in_code else "error").alias("severity"),
            ),
        )
        for r in rules
    ]
    none = F.array().cast("array<struct<matched:string,expected:string,message:string,severity:string>>")
    found = lines.where(_holds_any(F.col("line"), words)).select(*KEY, "line_no", F.explode_outer(F.array_compact(F.array(*hits)) if hits else none).alias("h"))
    return found.where(F.col("h").isNotNull()).select(F.lit("term").alias("check"), *KEY, "line_no", "h.severity", "h.matched", "h.expected", "h.message")


def wrong_terms_of(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``wrong_terms`` for any number of rules, given as a table ``wrong, correct, context, in_code``."""
    needles = rules.withColumnRenamed("wrong", "needle")
    hits = find_literals(prose_lines(files).select(*KEY, "line_no", "line"), needles, [*KEY, "line_no"], "line", carry=["correct", "context", "in_code"])
    severity = F.when(F.col("in_code"), "info").otherwise("error")
    return hits.select(
        F.lit("term").alias("check"), *KEY, "line_no", severity.alias("severity"), F.col("needle").alias("matched"), F.col("correct").alias("expected"), F.col("context").alias("message")
    )


def term_gate(findings: DataFrame) -> DataFrame:
    return findings.groupBy("corpus").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "info").alias("infos"),
        (F.count_if(F.col("severity") == "error") > 0).alias("blocked"),
    )


def project_names(files: DataFrame) -> DataFrame:
    """Names that must not leak: from fact files and the page folders, short and generic ones left out."""
    p = F.col("path")
    fact = F.regexp_extract(p, r"^\.cache/facts-(.+)\.yaml$", 1)
    folder = F.regexp_extract(p, r"^docs/(?:architecture|manual|explanations)/([^/]+)/", 1)
    page = F.regexp_extract(p, r"^docs/(?:architecture|manual|explanations)/([^/]+)\.md$", 1)
    kept_page = F.when((page != "index") & (F.length(page) > 2), page)
    kept_folder = F.when(folder != "stylesheets", folder)
    kept_fact = F.when(F.length(fact) > 2, fact)
    return (
        files.select(F.explode_outer(F.array_compact(F.array(kept_fact, kept_folder, kept_page))).alias("name")).where(F.col("name").isNotNull())
        .where((F.col("name") != "") & ~F.col("name").isin(GENERIC_NAMES))
        .distinct()
    )
