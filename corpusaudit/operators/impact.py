"""Which documents a changed source file affects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions import globs, paths
from corpusaudit.functions import text as tx
from corpusaudit.operators.literals import find_literals
from corpusaudit.session import cut_lineage

# Source glob -> documents.
IMPACT_RULES = [
    ("Controllers/API/*Controller.php", ["features/*.md", "04-api-reference.md"]),
    ("Models/*.php", ["05-data-model.md"]),
    ("pages/**/*.vue", ["06-screen-specs.md", "02-screen-flow.md"]),
    ("store/*.js", ["features/*.md"]),
    ("routes/api.php", ["04-api-reference.md", "02-screen-flow.md"]),
    ("config/*", ["01-overview.md"]),
    ("*.json", ["01-overview.md"]),
]


def feature_page(path: Column) -> Column:
    """Concrete page for a wildcard: from a controller or a store file name; NULL for other sources."""
    name = paths.basename(path)
    controller = tx.kebab(F.replace(name, F.lit("Controller.php"), F.lit("")))
    store = tx.kebab(F.regexp_replace(name, r"\.[^.]*$", ""), acronyms=False)
    feature = F.when(F.contains(path, F.lit("Controller")), controller).when(F.contains(path, F.lit("store/")), store)
    return F.concat(F.lit("features/"), feature, F.lit(".md"))


def affected_documents(changed: DataFrame, rules: Sequence[tuple[str, list[str]]] = tuple(IMPACT_RULES)) -> DataFrame:
    """corpus, path, doc, rule_no: one row per source and document, the first rule kept.

    Rules are unrolled into the projection, so a changed path is tested where it is read; a path that no
    rule matches costs one alternation.
    """
    hits = [
        F.when(F.col("path").rlike(globs.path_suffix(glob)), F.struct(F.lit(i).alias("rule_no"), F.array(*[F.lit(d) for d in docs]).alias("docs")))
        for i, (glob, docs) in enumerate(rules)
    ]
    none = F.array().cast("array<struct<rule_no:int,docs:array<string>>>")
    matched = changed.select("corpus", "path", F.explode_outer(F.array_compact(F.array(*hits)) if hits else none).alias("h")).where(F.col("h").isNotNull())
    return _named(matched.select("corpus", "path", "h.rule_no", F.explode_outer("h.docs").alias("doc")))


def _named(hits: DataFrame) -> DataFrame:
    """Wildcard pages get their names, and of the rules that name a document the first stays."""
    out = hits.where(F.col("doc").isNotNull())
    page = F.when(F.col("doc").rlike(r"features/.*\*"), F.coalesce(feature_page(F.col("path")), F.col("doc")))
    named = out.withColumn("doc", F.coalesce(page, F.col("doc")))
    return named.groupBy("corpus", "path", "doc").agg(F.min("rule_no").alias("rule_no"))


def affected_by(changed: DataFrame, rules: DataFrame) -> DataFrame:
    """``affected_documents`` for any number of rules, given as a table ``rule_no, pattern, docs``.

    A path that fits a pattern contains the longest piece of it without wildcards, so all pieces are looked for in one
    pass over the paths, and a pattern is tested only where its piece is. A pattern of wildcards alone has none; of
    these there are as many as distinct lengths at most, and they are tested on every path.
    """
    regex = F.udf(globs.path_suffix, "string")  # once a rule
    pieces = F.split("pattern", r"\[.[^\]]*\]|[*?]", -1)
    longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    table = rules.where("pattern IS NOT NULL AND docs IS NOT NULL").select("rule_no", longest.alias("needle"), regex("pattern").alias("regex"), "docs")
    table = cut_lineage(table)
    paths_ = changed.select("corpus", "path").where("path IS NOT NULL")
    near = find_literals(paths_, table.where("needle <> ''"), ["corpus", "path"], "path", carry=["rule_no", "regex", "docs"]).drop("needle")
    loose = table.where("needle = ''").groupBy("regex").agg(F.min_by("docs", "rule_no").alias("docs"), F.min("rule_no").alias("rule_no")).collect()
    for r in loose:
        near = near.unionByName(paths_.select("corpus", "path", F.lit(r["rule_no"]).alias("rule_no"), F.lit(r["regex"]).alias("regex"), F.array(*map(F.lit, r["docs"])).alias("docs")))
    hit = near.where(F.regexp_like("path", F.col("regex"))).select("corpus", "path", "rule_no", F.explode_outer("docs").alias("doc"))
    return _named(hit)


def update_plan(affected: DataFrame) -> DataFrame:
    """The plan as rows, one per document and source: corpus, doc, source_file, reason.

    A document may depend on any number of sources, so they stay rows; ``plan_summary`` counts them.
    """
    return affected.select(
        "corpus",
        "doc",
        F.col("path").alias("source_file"),
        F.concat(paths.basename(F.col("path")), F.lit(" changed")).alias("reason"),
    )


def plan_summary(plan: DataFrame) -> DataFrame:
    """corpus, doc, sources, first_source: sorted by document when shown."""
    return plan.groupBy("corpus", "doc").agg(F.count("*").alias("sources"), F.min("source_file").alias("first_source"))
