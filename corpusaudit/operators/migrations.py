"""Migration history: which table was created, changed and dropped in which file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions import paths

# Statements in the migration languages. A guard such as IF NOT EXISTS is no table name.
GUARD = r"(?:IF\s+(?:NOT\s+)?EXISTS\s+)?"
CREATE = rf"""(?i)(?:Schema::create|CREATE\s+TABLE|create_table|createTable)\s*\(?\s*{GUARD}[:'"`]?(\w+)['"`]?"""
ALTER = rf"""(?i)(?:Schema::table|ALTER\s+TABLE|change_table)\s*\(?\s*{GUARD}[:'"`]?(\w+)['"`]?"""
DROP = rf"""(?i)(?:Schema::drop(?:IfExists)?|DROP\s+TABLE|drop_table|dropTable)\s*\(?\s*{GUARD}[:'"`]?(\w+)['"`]?"""
SUFFIXES = [".php", ".sql", ".py", ".rb", ".ts", ".js"]


def _events(action: str, order: int, regex: str) -> Column:
    return F.transform(
        F.regexp_extract_all("content", F.lit(regex), F.lit(1)),
        lambda t: F.struct(F.lit(order).alias("step"), F.lit(action).alias("action"), t.alias("table_name")),
    )


def migration_events(files: DataFrame) -> DataFrame:
    """corpus, file, step, action, table_name. Files are ordered by name; in a file create, alter, drop."""
    found = F.concat(_events("create", 0, CREATE), _events("alter", 1, ALTER), _events("drop", 2, DROP))
    return (
        files.where(paths.extension(F.col("path")).isin(SUFFIXES))
        .select("corpus", paths.basename(F.col("path")).alias("file"), F.explode_outer(F.array_distinct(found)).alias("e")).where(F.col("e").isNotNull())
        .select("corpus", "file", "e.step", "e.action", "e.table_name")
    )


def table_history(events: DataFrame) -> DataFrame:
    """Per table: created_in (first), how often changed after that, dropped, dropped_in (last).

    Two aggregations on (corpus, table) instead of a window: both combine before the shuffle, and the
    files of a table that is changed all the time are counted, not gathered. ``changes`` lists them.
    """
    at = F.struct("file", "step")
    created = (
        events.where(F.col("action") == "create")
        .groupBy("corpus", "table_name")
        .agg(F.min(at).alias("born"))
    )
    later = events.where(F.col("action") != "create").join(created, ["corpus", "table_name"])
    after = later.where(F.struct("file", "step") >= F.col("born"))
    # distinct first: a file that changes a table twice counts once
    steps = after.select("corpus", "table_name", "file", "action").distinct()
    tail = steps.groupBy("corpus", "table_name").agg(
        F.count_if(F.col("action") == "alter").alias("modified_files"),
        F.max(F.when(F.col("action") == "drop", F.col("file"))).alias("dropped_in"),
    )
    return created.join(tail, ["corpus", "table_name"], "left").select(
        "corpus",
        "table_name",
        F.col("born.file").alias("created_in"),
        F.coalesce("modified_files", F.lit(0)).alias("modified_files"),
        F.col("dropped_in").isNotNull().alias("dropped"),
        "dropped_in",
    )


def changes(events: DataFrame) -> DataFrame:
    """The files that change a table once it exists, one row each: corpus, table_name, file."""
    created = events.where(F.col("action") == "create").groupBy("corpus", "table_name").agg(F.min("file").alias("born"))
    return (
        events.where(F.col("action") == "alter")
        .join(created, ["corpus", "table_name"])
        .where(F.col("file") >= F.col("born"))
        .select("corpus", "table_name", "file")
        .distinct()
    )


def live_tables(history: DataFrame) -> DataFrame:
    """Tables that are not dropped, for use as a catalog of last resort."""
    return history.where(~F.col("dropped")).select("corpus", "table_name")
