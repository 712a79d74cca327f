"""Catalog readers: the four tables of ``operators.catalog.assemble`` from a database or from Spark."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusaudit.functions.text import quote_identifier

# catalog tables per dialect; a JDBC source runs one query for each
CATALOG_QUERIES = {
    "mysql": {
        "tables": "SELECT TABLE_NAME AS table_name, TABLE_TYPE AS table_type, TABLE_ROWS AS table_rows, TABLE_COMMENT AS table_comment FROM information_schema.TABLES WHERE TABLE_SCHEMA = DATABASE()",
        "columns": "SELECT TABLE_NAME AS table_name, ORDINAL_POSITION AS ordinal, COLUMN_NAME AS column_name, COLUMN_TYPE AS column_type, IS_NULLABLE AS is_nullable, COLUMN_DEFAULT AS column_default, COLUMN_KEY AS column_key FROM information_schema.COLUMNS WHERE TABLE_SCHEMA = DATABASE()",
        "fks": "SELECT TABLE_NAME AS table_name, COLUMN_NAME AS column_name, REFERENCED_TABLE_NAME AS referenced_table_name, REFERENCED_COLUMN_NAME AS referenced_column_name FROM information_schema.KEY_COLUMN_USAGE WHERE TABLE_SCHEMA = DATABASE() AND REFERENCED_TABLE_NAME IS NOT NULL",
        "indexes": "SELECT TABLE_NAME AS table_name, INDEX_NAME AS index_name, SEQ_IN_INDEX AS seq, COLUMN_NAME AS column_name, NON_UNIQUE AS non_unique FROM information_schema.STATISTICS WHERE TABLE_SCHEMA = DATABASE()",
    },
    "postgresql": {
        "tables": "SELECT t.table_name, t.table_type, c.reltuples::bigint AS table_rows, obj_description(c.oid) AS table_comment FROM information_schema.tables t JOIN pg_class c ON c.relname = t.table_name AND c.relnamespace = t.table_schema::regnamespace WHERE t.table_schema = 'public'",
        "columns": "SELECT c.table_name, c.ordinal_position AS ordinal, c.column_name, c.data_type AS column_type, c.is_nullable, c.column_default, CASE WHEN k.column_name IS NULL THEN '' ELSE 'PRI' END AS column_key FROM information_schema.columns c LEFT JOIN (SELECT u.table_name, u.column_name FROM information_schema.table_constraints p JOIN information_schema.key_column_usage u USING (constraint_name, table_name) WHERE p.constraint_type = 'PRIMARY KEY') k USING (table_name, column_name) WHERE c.table_schema = 'public'",
        "fks": "SELECT k.table_name, k.column_name, u.table_name AS referenced_table_name, u.column_name AS referenced_column_name FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k USING (constraint_name) JOIN information_schema.constraint_column_usage u USING (constraint_name) WHERE c.constraint_type = 'FOREIGN KEY'",
        "indexes": "SELECT t.relname AS table_name, i.relname AS index_name, a.attnum AS seq, a.attname AS column_name, CASE WHEN x.indisunique THEN '0' ELSE '1' END AS non_unique FROM pg_index x JOIN pg_class t ON t.oid = x.indrelid JOIN pg_class i ON i.oid = x.indexrelid JOIN pg_attribute a ON a.attrelid = t.oid AND a.attnum = ANY(x.indkey) WHERE t.relkind = 'r'",
    },
}


def jdbc_options(dialect: str, part: str, options: Mapping[str, str]) -> dict[str, str]:
    """Options of the JDBC reader for one part of the catalog."""
    return {"queryTimeout": "30", **options, "query": CATALOG_QUERIES[dialect][part]}


def read_jdbc_catalog(spark: SparkSession, corpus: str, dialect: str, options: Mapping[str, str]) -> dict[str, DataFrame]:
    """tables, columns, fks, indexes of one database through the JDBC source."""
    out = {}
    for part in CATALOG_QUERIES[dialect]:
        df = spark.read.format("jdbc").options(**jdbc_options(dialect, part, options)).load()
        out[part] = df.select(F.lit(corpus).alias("corpus"), *[F.col(c).alias(c.lower()) for c in df.columns])
    return out


def jdbc_table(spark: SparkSession, table: str, dialect: str, options: Mapping[str, str]) -> DataFrame:
    """A table to profile; counts and limits on it are pushed down by the source."""
    return spark.read.format("jdbc").options(**{**options, "dbtable": quote_identifier(table, dialect)}).load()


def read_spark_catalog(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """tables and columns of a database of the session catalog; it knows no keys and no indexes."""
    found = spark.catalog.listTables(database)
    names = {t.name: t.name if t.isTemporary else f"{database}.{t.name}" for t in found}
    tables = [(database, n, "TABLE", None, None) for n in names]
    columns = [
        (database, n, i, c.name, c.dataType, "YES" if c.nullable else "NO", None, "")
        for n in names
        for i, c in enumerate(spark.catalog.listColumns(names[n]))
    ]
    from corpusaudit import schemas

    return {
        "tables": spark.createDataFrame(tables, schemas.CATALOG_TABLES),
        "columns": spark.createDataFrame(columns, schemas.CATALOG_COLUMNS),
        "fks": spark.createDataFrame([], schemas.CATALOG_FKS),
        "indexes": spark.createDataFrame([], schemas.CATALOG_INDEXES),
    }
