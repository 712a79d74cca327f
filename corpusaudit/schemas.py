"""Table contracts shared by the operators."""

from pyspark.sql import types as T

FILES = T.StructType(
    [
        T.StructField("corpus", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("modified_at", T.TimestampType()),
    ]
)

ROUTES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("auth_required", T.BooleanType()),
    ]
)

PACKAGE_MANIFEST = (
    "dependencies MAP<STRING,STRING>, devDependencies MAP<STRING,STRING>, "
    "peerDependencies MAP<STRING,STRING>, `require` MAP<STRING,STRING>, `require-dev` MAP<STRING,STRING>"
)

CATALOG_TABLES = "corpus STRING, table_name STRING, table_type STRING, table_rows STRING, table_comment STRING"
CATALOG_COLUMNS = (
    "corpus STRING, table_name STRING, ordinal INT, column_name STRING, column_type STRING, "
    "is_nullable STRING, column_default STRING, column_key STRING"
)
CATALOG_FKS = (
    "corpus STRING, table_name STRING, column_name STRING, "
    "referenced_table_name STRING, referenced_column_name STRING"
)
CATALOG_INDEXES = (
    "corpus STRING, table_name STRING, index_name STRING, seq INT, column_name STRING, non_unique STRING"
)

LEDGER = (
    "cache_key STRING, corpus STRING, commit STRING, generated_at TIMESTAMP, "
    "file_count BIGINT, facts_version INT"
)
RUN_LOG = (
    "name STRING, mode STRING, generated_at TIMESTAMP, commit STRING, corpus STRING, "
    "file_count BIGINT, duration_estimate STRING"
)
