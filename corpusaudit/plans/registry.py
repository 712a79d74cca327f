"""Registered queries, the SQL that checks them, and inputs derived from the given tables.

A ``Derived`` input is a projection of one table whose expressions mean the same in Spark SQL and in the
SQL of the oracle, so both sides start from the same rows and the work grows with the table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from corpusaudit.session import configure, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` and, where there is one, the SQL with the same result."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Derived:
    table: str
    columns: dict[str, str] = field(default_factory=dict)
    where: str | None = None
    text: bool = False

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, self.table)
        if self.where:
            df = df.where(self.where)
        if self.text:
            df = spread(df)
        return df.selectExpr(*[f"{e} AS {c}" for c, e in self.columns.items()])

    def sql(self) -> str:
        cols = ", ".join(f"{e} AS {c}" for c, e in self.columns.items())
        return f"SELECT {cols} FROM {self.table}" + (f" WHERE {self.where}" if self.where else "")


def files_of(table: str, corpus: str, path: str, content: str, where: str | None = None, **more: str) -> Derived:
    return Derived(table, {"corpus": corpus, "path": path, "content": content, **more}, where, text=True)


def s(column: str) -> str:
    """A number as text, in both dialects."""
    return f"CAST({column} AS STRING)"


def cat(*parts: str) -> str:
    """Concatenation; a bare newline part is written as NL."""
    return "concat(" + ", ".join(parts) + ")"


def q(text: str) -> str:
    """String literal without characters that either dialect escapes."""
    return "'" + text.replace("'", "''") + "'"


NL = "chr(10)"
FENCE = "'```'"


def lines_sql(source: str, keys: str = "corpus, path", content: str = "content") -> str:
    """Oracle for lines: numbered from 1, a final newline opens no further line."""
    unix = f"replace(replace({content}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return f"""
      SELECT {keys}, CAST(i AS INTEGER) AS line_no, ls[i] AS line FROM (
        SELECT {keys}, ls, unnest(generate_series(1, len(ls))) AS i FROM (
          SELECT {keys}, string_split(CASE WHEN ends_with(u, chr(10)) THEN left(u, length(u) - 1) ELSE u END, chr(10)) AS ls
          FROM (SELECT {keys}, {unix} AS u FROM ({source}) WHERE {content} <> '')))"""


def fences_sql(source: str) -> str:
    """Oracle for fences: running count of the marker lines."""
    return f"""
      SELECT *, coalesce(sum(CASE WHEN is_marker THEN 1 ELSE 0 END) OVER (
          PARTITION BY corpus, path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS seen
      FROM (SELECT *, regexp_matches(line, '^\\s*```') AS is_marker FROM ({lines_sql(source)}))"""


def prose_sql(source: str) -> str:
    return f"SELECT corpus, path, line_no, line FROM ({fences_sql(source)}) WHERE NOT is_marker AND seen % 2 = 0"
