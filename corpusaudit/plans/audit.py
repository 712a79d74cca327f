"""The whole audit as one application: all checks write one findings table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.operators import citations, classify, diagrams, endpoints, leakage, links, quality, tables
from corpusaudit.operators.leakage import LeakRule, TermRule
from corpusaudit.operators.classify import with_suffix

COLUMNS = ["check", "corpus", "path", "line_no", "rule", "severity", "matched", "expected", "message"]


@dataclass(frozen=True)
class AuditConfig:
    leak_rules: Sequence[LeakRule] = ()
    term_rules: Sequence[TermRule] = field(default_factory=lambda: tuple(leakage.TERM_RULES))
    ignore_links: Sequence[str] = ()
    threshold: str | None = None


def _finding(df: DataFrame, **cols) -> DataFrame:
    null = {c: F.lit(None).cast("int" if c == "line_no" else "string") for c in COLUMNS}
    have = {c: F.col(c) for c in df.columns if c in COLUMNS}
    given = {k: (F.lit(v) if isinstance(v, str) else v) for k, v in cols.items()}
    pick = {**null, **have, **given}
    return df.select(*[pick[c].alias(c) for c in COLUMNS])


def findings(files: DataFrame, config: AuditConfig = AuditConfig()) -> DataFrame:
    """Leaks, wrong terms, broken links, unshown images, overflowing figures and slides, in one schema.

    With ``files`` stored by ``sinks.write_files`` each check reads only the partitions of its kinds.
    """
    docs, figures = with_suffix(files, [".md"]), with_suffix(files, [".mmd"])
    parts = [
        _finding(leakage.scan(files, config.leak_rules)),
        _finding(leakage.name_findings(files, leakage.project_names(files))),
        _finding(leakage.wrong_terms(docs, config.term_rules), rule=F.col("matched")),
        _finding(links.check_links(files, config.ignore_links), check="link", rule=F.col("reason"), severity="error", message=F.col("url")),
        _finding(links.unreferenced_images(with_suffix(files, [".md", ".svg"])), check="image", path=F.col("image"), rule="not shown", severity="warning", expected=F.col("expected")),
        _finding(diagrams.diagram_overflow(figures), severity="warning", message=F.concat_ws("/", "count", "max_allowed")),
        _finding(diagrams.slide_overflow(docs), severity="warning", message=F.concat_ws("/", "count", "max_allowed")),
    ]
    return reduce(DataFrame.unionByName, parts)


def verdicts(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations, table names and endpoints of documents against the sources of the same corpus."""
    parts = [
        citations.verify_citations(citations.citations(docs), citations.file_lengths(sources)),
        tables.verify_tables(tables.documented_tables(docs), tables.declared_tables(sources)),
        endpoints.verify_endpoints(endpoints.endpoints(docs), endpoints.source_routes(sources)).drop("counts_as_failure"),
    ]
    return reduce(DataFrame.unionByName, parts)


def scores(docs: DataFrame, threshold: str | None = None) -> DataFrame:
    """Scorecard of every project of every corpus."""
    owned = docs.withColumn("project", classify.project_of(F.col("path")))
    return quality.scorecards(quality.axis_scores(quality.project_metrics(owned)), threshold)


def summary(found: DataFrame) -> DataFrame:
    """Findings per check and severity."""
    return found.groupBy("check", "severity").agg(F.count("*").alias("findings"), F.count_distinct("corpus").alias("corpora"))
