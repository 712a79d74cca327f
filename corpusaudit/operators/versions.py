"""Snapshots, their comparison, and the ledger of what has been produced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_AGE = 3600


def snapshot(files: DataFrame, content: str = "content") -> DataFrame:
    """corpus, path, sha256 of the bytes of each file."""
    return files.select("corpus", "path", F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


def compare(old: DataFrame, new: DataFrame, keep_same: bool = False) -> DataFrame:
    """corpus, path, change: added / removed / changed (and same).

    Both sides are unique per key, so one full outer join on hashes is all that moves: no text.
    """
    o = old.select("corpus", "path", F.col("sha256").alias("old_sha"))
    n = new.select("corpus", "path", F.col("sha256").alias("new_sha"))
    change = (
        F.when(F.col("old_sha").isNull(), "added")
        .when(F.col("new_sha").isNull(), "removed")
        .when(F.col("old_sha") == F.col("new_sha"), "same")
        .otherwise("changed")
    )
    out = o.join(n, ["corpus", "path"], "full_outer").select("corpus", "path", change.alias("change"))
    return out if keep_same else out.where(F.col("change") != "same")


def change_summary(compared: DataFrame) -> DataFrame:
    """Per corpus: added, removed, changed, has_changes."""
    n = lambda s: F.count_if(F.col("change") == s).alias(s)
    return (
        compared.groupBy("corpus")
        .agg(n("added"), n("removed"), n("changed"))
        .withColumn("has_changes", F.col("added") + F.col("removed") + F.col("changed") > 0)
    )


def copies(snap: DataFrame) -> DataFrame:
    """Groups of equal files: sha256, copies, first path. Counted before the shuffle, never gathered."""
    first = F.min(F.struct("corpus", "path"))
    return (
        snap.groupBy("sha256")
        .agg(F.count("*").alias("copies"), first.alias("f"))
        .where(F.col("copies") > 1)
        .select("sha256", "copies", F.col("f.corpus").alias("first_corpus"), F.col("f.path").alias("first_path"))
    )


def cache_key(path: Column, commit: Column) -> Column:
    return F.sha2(F.concat_ws(":", path, F.coalesce(commit, F.lit(""))), 256)


def ledger_entry(ledger: DataFrame, key: str) -> DataFrame:
    """Latest entry of a key; no row when there is none."""
    return ledger.where(F.col("cache_key") == key).orderBy(F.desc("generated_at")).limit(1)


def latest_entries(ledger: DataFrame) -> DataFrame:
    """Latest entry per corpus."""
    rest = [c for c in ledger.columns if c != "corpus"]
    best = F.max_by(F.struct(*rest), F.struct("generated_at", "cache_key"))
    return ledger.groupBy("corpus").agg(best.alias("e")).select("corpus", "e.*")


def _fresh(now: Column, max_age: int) -> Column:
    return F.unix_timestamp("generated_at") >= F.unix_timestamp(now) - max_age


def still_valid(ledger: DataFrame, current: DataFrame, now: Column, max_age: int = DEFAULT_MAX_AGE) -> DataFrame:
    """Latest entries young enough whose commit is the current one; an unknown commit does not count against."""
    joined = latest_entries(ledger).where(_fresh(now, max_age)).join(
        current.select("corpus", F.col("commit").alias("current_commit")), "corpus", "left"
    )
    known = (F.coalesce("commit", F.lit("")) != "") & (F.coalesce("current_commit", F.lit("")) != "")
    return joined.where(~known | (F.col("commit") == F.col("current_commit"))).drop("current_commit")


def to_do(work: DataFrame, ledger: DataFrame, now: Column, max_age: int = DEFAULT_MAX_AGE) -> DataFrame:
    """Work whose key has no entry that is young enough."""
    done = ledger.where(_fresh(now, max_age)).select("cache_key").distinct()
    return work.join(done, "cache_key", "left_anti")


def changed_files(state: DataFrame, changes: DataFrame) -> DataFrame:
    """corpus, path, change of the files of the corpora that ``facts_state`` calls changed."""
    return changes.join(state.where(F.col("state") == "changed").select("corpus"), "corpus", "left_semi")


def facts_state(current: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per corpus: no cache / no commit / unchanged / changed, by the latest entry."""
    last = latest_entries(ledger).select("corpus", F.col("commit").alias("cached"), F.lit(True).alias("has_entry"))
    state = (
        F.when(F.col("has_entry").isNull(), "no cache")
        .when((F.coalesce("cached", F.lit("")) == "") | (F.coalesce("commit", F.lit("")) == ""), "no commit")
        .when(F.col("cached") == F.col("commit"), "unchanged")
        .otherwise("changed")
    )
    return current.join(last, "corpus", "left").select("corpus", state.alias("state"))


def expire(ledger: DataFrame, now: Column, max_age: int) -> tuple[DataFrame, DataFrame]:
    """Entries to keep, and how many are dropped."""
    keep = ledger.where(_fresh(now, max_age))
    dropped = ledger.agg(F.count_if(~_fresh(now, max_age)).alias("removed"))
    return keep, dropped
