"""Table catalogs: assembly, table kinds, flag counts, manifests, and schemas read from SQL dumps."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusaudit.functions import globs

# Fixed values.
ACTIVE_FLAGS = [
    "is_active", "is_enabled", "is_deleted", "active", "enabled", "disabled", "deleted", "status", "deleted_at",
    "deactivated_at", "archived", "is_archived", "is_visible", "visible", "hidden", "is_hidden",
]
LABEL_COLUMNS = [
    "name", "label", "title", "display_name", "display_title", "description", "caption", "heading", "text", "value",
]
SETTINGS_NAMES = "(?i)(settings?|configs?|configurations?|options?|feature_flags?|parameters?|preferences?|system_settings?|app_settings?)$"
SYSTEM_WORDS = [
    "migration", "session", "cache", "job", "failed_job", "password_reset", "personal_access_token", "oauth",
    "telescope", "horizon", "pulse",
]
TIME_FLAGS = ["deleted_at", "deactivated_at"]
NEGATIVE_FLAGS = ["is_deleted", "disabled", "is_archived", "hidden", "is_hidden", "deleted", "archived"]
KIND_ORDER = ["M", "T", "R", "S"]

TABLE = ["corpus", "table_name"]


def is_active_flag(name: Column) -> Column:
    return F.lower(name).isin(ACTIVE_FLAGS)


def is_label(name: Column) -> Column:
    return F.lower(name).isin(LABEL_COLUMNS)


def is_settings_table(name: Column) -> Column:
    return name.rlike(SETTINGS_NAMES)


def table_kind(name: Column, column_count: Column, fk_count: Column, has_flag: Column, has_name: Column) -> Column:
    """S system, R relation, M master, T transaction."""
    low = F.lower(name)
    return (
        F.when(low.rlike("|".join(globs.literal(w) for w in SYSTEM_WORDS)), "S")
        .when((fk_count >= 2) & (column_count <= fk_count + 3), "R")
        .when(has_flag | low.rlike("^(m_|mst_)") | (has_name & (fk_count == 0)), "M")
        .otherwise("T")
    )


def _ordered(order: Column, *fields: Column) -> Column:
    """Array of structs in the given order, without the order itself."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct(*fields).alias("v")))), lambda x: x["v"])


def assemble(tables: DataFrame, columns: DataFrame, fks: DataFrame, indexes: DataFrame) -> DataFrame:
    """One row per table from the four catalog tables.

    The nested lists are the columns, keys and indexes of one table; repeated catalog rows are dropped
    before they are gathered, and a database bounds how many distinct ones a table can have.
    """
    name = F.col("column_name")
    default = F.when(~F.col("column_default").isin("NULL", "None"), F.col("column_default"))
    field = [
        name.alias("name"),
        F.col("column_type").alias("type"),
        (F.upper(F.coalesce("is_nullable", F.lit("YES"))) == "YES").alias("nullable"),
        default.alias("default"),
    ]
    seq = F.struct("ordinal", "column_name")
    cols = columns.dropDuplicates([*TABLE, "ordinal", "column_name"]).groupBy(*TABLE).agg(
        _ordered(seq, *field).alias("columns"),
        F.count("*").alias("column_count"),
        _names(F.upper("column_key") == "PRI").alias("primary_key"),
        _names(is_active_flag(name)).alias("active_flag_columns"),
        _names(is_label(name)).alias("label_columns"),
        F.bool_or(F.lower("column_name") == "name").alias("has_name"),
    )
    refs = fks.distinct().groupBy(*TABLE).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    name.alias("column"),
                    F.col("referenced_table_name").alias("references_table"),
                    F.col("referenced_column_name").alias("references_column"),
                )
            )
        ).alias("foreign_keys"),
        F.count("*").alias("fk_count"),
    )
    each = indexes.dropDuplicates([*TABLE, "index_name", "seq"]).groupBy(*TABLE, "index_name").agg(
        _ordered(F.col("seq"), name).alias("cols"), (F.min("non_unique") == "0").alias("unique")
    )
    idx = each.groupBy(*TABLE).agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("index_name").alias("name"), F.col("cols.column_name").alias("columns"), "unique"))
        ).alias("indexes")
    )
    df = tables.join(cols, TABLE, "left").join(refs, TABLE, "left").join(idx, TABLE, "left")
    fk_count = F.coalesce("fk_count", F.lit(0))
    flags = F.coalesce("active_flag_columns", F.array().cast("array<string>"))
    kind = table_kind(
        F.col("table_name"),
        F.coalesce("column_count", F.lit(0)),
        fk_count,
        F.size(flags) > 0,
        F.coalesce("has_name", F.lit(False)),
    )
    return df.select(
        *TABLE,
        "columns",
        "primary_key",
        "foreign_keys",
        "indexes",
        kind.alias("kind"),
        (F.size(flags) > 0).alias("has_active_flag"),
        flags.alias("active_flag_columns"),
        F.coalesce("label_columns", F.array().cast("array<string>")).alias("label_columns"),
        is_settings_table(F.col("table_name")).alias("is_settings_table"),
        F.when(F.col("table_rows").rlike("^[0-9]+$"), F.col("table_rows").try_cast("bigint")).alias("row_count"),
        "table_comment",
    )


def _names(keep: Column) -> Column:
    """Names of the columns kept, in column order."""
    picked = F.collect_list(F.when(keep, F.struct(F.col("ordinal").alias("o"), F.col("column_name").alias("n"))))
    return F.transform(F.array_sort(picked), lambda x: x["n"])


def kind_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("corpus", "kind").agg(F.count("*").alias("tables"))


def manifest_rows(catalog: DataFrame) -> DataFrame:
    """Roll-ups of a catalog as rows: corpus, section, table_name, columns.

    Sections: active_flag_tables, settings_tables, label_sources, master_data_candidates.
    """
    pick = lambda ok, section, cols: F.when(
        ok, F.struct(F.lit(section).alias("section"), F.array_join(cols, ",").alias("columns"))
    )
    none = F.array().cast("array<string>")
    parts = F.array(
        pick(F.col("has_active_flag"), "active_flag_tables", F.col("active_flag_columns")),
        pick(F.col("is_settings_table"), "settings_tables", none),
        pick(F.size("label_columns") > 0, "label_sources", F.col("label_columns")),
        pick(F.col("kind") == "M", "master_data_candidates", none),
    )
    return catalog.select(*TABLE, F.explode_outer(F.array_compact(parts)).alias("m")).where(F.col("m").isNotNull()).select("corpus", "m.section", "table_name", "m.columns")


def entry_json(catalog: DataFrame) -> DataFrame:
    """One JSON document per table: corpus, table_name, entry."""
    body = [c for c in catalog.columns if c not in TABLE]
    return catalog.select(*TABLE, F.to_json(F.struct(*body)).alias("entry"))


def active_condition(column: str) -> Column:
    """When a flag means active: no time set, 0 for a negative flag, else 1."""
    low = column.lower()
    value = F.col(column)
    if low in TIME_FLAGS:
        return value.isNull()
    return value == (0 if low in NEGATIVE_FLAGS else 1)


def active_counts(df: DataFrame, table: str, flags: list[str]) -> DataFrame:
    """total, active and inactive rows per flag column in one pass; a NULL flag counts in neither."""
    aggs = [F.count("*").alias("total")]
    for f in flags:
        aggs += [F.count_if(active_condition(f)).alias(f"{f}__a"), F.count_if(~active_condition(f)).alias(f"{f}__i")]
    one = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(f).alias("flag"),
            F.col("total"),
            F.col(f"{f}__a").alias("active"),
            F.col(f"{f}__i").alias("inactive"),
            F.lit(i == 0).alias("is_primary_flag"),
        )
        for i, f in enumerate(flags)
    ]
    return one.select(F.lit(table).alias("table_name"), F.explode_outer(F.array(*rows)).alias("r")).where(F.col("r").isNotNull()).select("table_name", "r.*")


def label_values(df: DataFrame, labels: list[str], key: list[str]) -> DataFrame:
    """All rows of a table by key, with its label columns."""
    return df.select(*key, *labels).orderBy(*key)


def settings_values(df: DataFrame, key: list) -> DataFrame:
    """All rows of a settings table by key."""
    return df.orderBy(*key)


def pick_source(*catalogs: DataFrame) -> DataFrame:
    """Catalogs in order of trust (live, dump, migrations): per corpus only the best one is kept."""
    ranked = reduce(DataFrame.unionByName, [c.withColumn("source_rank", F.lit(i)) for i, c in enumerate(catalogs)])
    best = ranked.groupBy("corpus").agg(F.min("source_rank").alias("source_rank"))
    return ranked.join(best, ["corpus", "source_rank"], "left_semi")


# --- schemas from SQL dumps -------------------------------------------------------------------------

# Patterns of statements and of the lines of their bodies.
CREATE = r"""(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`"']?(\w+)[`"']?\s*\("""
Q, W = r"""[`"']?""", r"(\w+)"
CONSTRAINT = r"(?i)^\s*(PRIMARY\s+KEY|UNIQUE|INDEX|KEY|CONSTRAINT|FOREIGN\s+KEY|CHECK)"
PRIMARY = r"(?i)PRIMARY\s+KEY\s*\(([^)]+)\)"
FOREIGN = rf"(?i)FOREIGN\s+KEY\s*\({Q}{W}{Q}\)\s*REFERENCES\s+{Q}{W}{Q}\s*\({Q}{W}{Q}\)"
INDEX = rf"(?i)(?:UNIQUE\s+)?(?:INDEX|KEY)\s+{Q}{W}{Q}\s*\(([^)]+)\)"
COLUMN = rf"^{Q}{W}{Q}\s+(\w+(?:\([^)]*\))?)"
DEFAULT = r"""(?i)DEFAULT\s+(['"]?[^,'")]+['"]?)"""

_BODIES = T.ArrayType(T.StructType().add("table_name", T.StringType()).add("body", T.StringType()))


@F.pandas_udf(_BODIES)
def _table_bodies(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text between the matching parentheses of each CREATE TABLE."""
    import re

    head, paren = re.compile(CREATE), re.compile("[()]")

    def bodies(text: str) -> list[dict]:
        out = []
        for m in head.finditer(text):
            depth, stop = 1, len(text)
            for p in paren.finditer(text, m.end()):
                depth += 1 if p.group() == "(" else -1
                if depth == 0:
                    stop = p.start()
                    break
            out.append({"table_name": m.group(1), "body": text[m.end() : stop]})
        return out

    for dumps in batches:
        yield dumps.map(bodies)


def _name_list(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda c: F.regexp_replace(F.trim(c), """^[`"']+|[`"']+$""", ""))


def _extract(line: Column, regex: str, *groups: int) -> list[Column]:
    return [F.regexp_extract(line, regex, g) for g in groups]


def dump_catalog(dumps: DataFrame) -> DataFrame:
    """Catalog in the form of ``assemble`` from the CREATE TABLE statements of SQL dumps.

    A statement is whole in its dump, so its columns, keys and indexes are taken from the lines of its
    body in the row: one pass over the text, no join. Only finished entries are shuffled, to keep the last
    statement of a table.
    """
    body = (
        dumps.where(F.col("content").rlike(r"(?i)CREATE\s+TABLE"))
        .select("corpus", "path", F.posexplode_outer(_table_bodies("content")).alias("n", "t"))
        .where(F.col("n").isNotNull())
    )
    trim = lambda l: F.regexp_replace(F.regexp_replace(l, r"^\s+|\s+$", ""), ",+$", "")
    df = body.select("corpus", "path", "n", "t.table_name", F.transform(F.split("t.body", "\n"), trim).alias("all"))
    df = df.withColumn("keys", F.filter("all", lambda l: l.rlike(CONSTRAINT))).withColumn(
        "defs", F.filter("all", lambda l: l.rlike(COLUMN) & ~l.rlike(CONSTRAINT))
    )

    def column(line: Column) -> Column:
        name, kind = _extract(line, COLUMN, 1, 2)
        default = F.regexp_replace(F.trim(F.regexp_extract(line, DEFAULT, 1)), "^['\"]+|['\"]+$", "")
        return F.struct(
            name.alias("name"),
            kind.alias("type"),
            (~F.contains(F.upper(line), F.lit("NOT NULL"))).alias("nullable"),
            F.when(line.rlike(DEFAULT), default).alias("default"),
        )

    def foreign(line: Column) -> Column:
        here, there, column_there = _extract(line, FOREIGN, 1, 2, 3)
        return F.struct(here.alias("column"), there.alias("references_table"), column_there.alias("references_column"))

    def index(line: Column) -> Column:
        name, names = _extract(line, INDEX, 1, 2)
        unique = F.contains(F.upper(line), F.lit("UNIQUE"))
        return F.struct(name.alias("name"), _name_list(names).alias("columns"), unique.alias("unique"))

    having = lambda regex: F.filter("keys", lambda l: l.rlike(regex))
    primary = F.try_element_at(having(PRIMARY), F.lit(-1))
    none = F.array().cast("array<string>")
    df = df.select(
        "corpus",
        "path",
        "n",
        "table_name",
        F.transform("defs", column).alias("columns"),
        F.coalesce(F.filter(_name_list(F.regexp_extract(primary, PRIMARY, 1)), lambda c: c != ""), none).alias("primary_key"),
        F.transform(having(FOREIGN), foreign).alias("foreign_keys"),
        F.transform(having(INDEX), index).alias("indexes"),
    )
    named = lambda ok: F.transform(F.filter("columns", lambda c: ok(c["name"])), lambda c: c["name"])
    df = df.withColumn("active_flag_columns", named(is_active_flag)).withColumn("label_columns", named(is_label))
    has_flag = F.size("active_flag_columns") > 0
    has_name = F.exists("columns", lambda c: F.lower(c["name"]) == "name")
    kind = table_kind(F.col("table_name"), F.size("columns"), F.size("foreign_keys"), has_flag, has_name)
    entry = F.struct(
        "columns",
        "primary_key",
        "foreign_keys",
        "indexes",
        kind.alias("kind"),
        has_flag.alias("has_active_flag"),
        "active_flag_columns",
        "label_columns",
        is_settings_table(F.col("table_name")).alias("is_settings_table"),
        F.lit(None).cast("bigint").alias("row_count"),
        F.lit(None).cast("string").alias("table_comment"),
    )
    last = df.select(*TABLE, F.struct("path", "n").alias("at"), entry.alias("entry"))
    return last.groupBy(*TABLE).agg(F.max_by("entry", "at").alias("e")).select(*TABLE, "e.*")
