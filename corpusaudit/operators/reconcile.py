"""Facts against documents: counts, tiers, names, and weighted scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Weights per kind of deliverable, in percent.
WEIGHT_AXES = ["accuracy", "coverage", "depth", "structure", "usability", "business", "modules", "formal"]
WEIGHTS = {
    "analyze": [30, 20, 20, 10, 10, 0, 10, 0],
    "manual": [25, 25, 10, 10, 20, 0, 10, 0],
    "slide": [20, 15, 10, 10, 25, 10, 5, 5],
    "rag": [30, 20, 5, 20, 15, 0, 10, 0],
    "user-guide": [25, 20, 0, 15, 30, 10, 0, 0],
}
TIER_BANDS = {"tier1": (20, 30), "tier2": (40, 50), "tier3": (20, 30)}


def reconcile_counts(facts: DataFrame, documented: DataFrame) -> DataFrame:
    """Rows of facts and of documents per (corpus, category): corpus, category, fact_count, doc_count, matches.

    Both sides are counted before they meet, so a corpus of any size is one row of each.
    """
    f = facts.groupBy("corpus", "category").agg(F.count("*").alias("fact_count"))
    d = documented.groupBy("corpus", "category").agg(F.count("*").alias("doc_count"))
    both = f.join(d, ["corpus", "category"], "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("corpus", "category", zero("fact_count"), zero("doc_count")).withColumn(
        "matches", F.col("fact_count") == F.col("doc_count")
    )


def tier_coverage(modules: DataFrame, tiers: DataFrame) -> DataFrame:
    """Per module that is not in exactly one tier, or is disabled and tiered: corpus, name, problem.

    ``modules`` has corpus, name, active; ``tiers`` has corpus, name, tier.
    """
    listed = tiers.groupBy("corpus", "name").agg(F.count("*").alias("listed"))
    known = modules.groupBy("corpus", "name").agg(F.bool_or("active").alias("active"))
    both = known.join(listed, ["corpus", "name"], "full_outer")
    n = F.coalesce("listed", F.lit(0))
    problem = (
        F.when(F.col("active").isNull(), "not in facts")
        .when(F.col("active") & (n == 0), "active but in no tier")
        .when(F.col("active") & (n > 1), "in several tiers")
        .when(~F.col("active") & (n > 0), "disabled but in a tier")
    )
    return both.select("corpus", "name", problem.alias("problem")).where(F.col("problem").isNotNull())


def tier_distribution(tiers: DataFrame) -> DataFrame:
    """Share of each tier per corpus in percent, whether all bands hold, and the two warnings."""
    n = F.count("*")
    share = lambda t: F.round(F.count_if(F.col("tier") == t) * 100.0 / n, 6)
    df = tiers.groupBy("corpus").agg(n.alias("features"), *[share(t).alias(f"{t}_pct") for t in TIER_BANDS])
    inside = F.lit(True)
    for t, (low, high) in TIER_BANDS.items():
        inside = inside & F.col(f"{t}_pct").between(low, high)
    return df.select(
        "*",
        inside.alias("in_bands"),
        (F.col("tier1_pct") > 40).alias("tier1_too_large"),
        (F.col("tier3_pct") == 0).alias("tier3_empty"),
    )


def unknown_names(documented: DataFrame, facts: DataFrame) -> DataFrame:
    """Names in documents that are not in the facts: corpus, name."""
    known = facts.select("corpus", "name").distinct()
    return documented.select("corpus", "name").distinct().join(known, ["corpus", "name"], "left_anti")


def weighted_scores(scores: DataFrame) -> DataFrame:
    """Weighted score per (corpus, deliverable). ``scores``: corpus, deliverable, axis, score.

    The weights are a fixed table, looked up in a literal map: no join.
    """
    flat = [F.lit(x) for d, ws in WEIGHTS.items() for a, w in zip(WEIGHT_AXES, ws) for x in (f"{d}/{a}", w)]
    weight = F.coalesce(F.try_element_at(F.create_map(*flat), F.concat_ws("/", "deliverable", "axis")), F.lit(0))
    return scores.groupBy("corpus", "deliverable").agg(F.round(F.sum(weight * F.col("score")) / 100.0, 6).alias("weighted"))
