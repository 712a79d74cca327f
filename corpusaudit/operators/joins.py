"""Join shapes shared by the checks, chosen so that one hot corpus, target or word does no harm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

# what may be broadcast, counted before it is: far below the memory of an executor
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# buckets of a corpus; each of them has a copy of its fact row
BUCKETS = 4


def hash_first(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_h``, a number for the values of ``keys``, to be the first key of a join or grouping.

    Rows are sorted for joins by their first key as far as that decides. Many texts begin alike, as do those of one corpus;
    numbers differ, so that whole texts are compared only where they are equal, or nearly always so.
    """
    return df.withColumn("_h", F.xxhash64(*keys))


def join_by_hash(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """The join on ``keys``, sorted by their number first."""
    return hash_first(left, keys).join(hash_first(right, keys), ["_h", *keys], how).drop("_h")


def group_by_hash(df: DataFrame, keys: list[str]) -> GroupedData:
    """The groups of ``keys``, sorted by their number first; ``_h`` stays in the result."""
    return hash_first(df, keys).groupBy("_h", *keys)


def join_per_corpus(rows: DataFrame, facts: DataFrame, spread: list[str], how: str = "left") -> DataFrame:
    """Join rows to a table with one row per corpus.

    The rows of a corpus are dealt to ``BUCKETS`` buckets by the columns in ``spread``, and its fact row is repeated for
    each. Their number is fixed: what is repeated, and broadcast where it is small, grows with the corpora only, not with
    the partitions of the session too. As both sides are dealt by corpus and bucket, the skew join of AQE splits a
    bucket that is still too large.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(BUCKETS)).cast("int"))
    repeated = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))))
    return salted.join(repeated, ["corpus", "_salt"], how).drop("_salt")


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table has at most ``rows`` rows and ``size`` bytes of text, by counting both."""
    texts = [F.octet_length(c) for c, kind in df.dtypes if kind == "string"]
    total = sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(0).cast("bigint"))
    got = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(total), F.lit(0)).alias("b")).first()
    return got["n"] <= rows and got["b"] <= size


def first_by(df: DataFrame, keys: list[str], order: Column, take: list[str]) -> DataFrame:
    """One row per key, the one with the smallest ``order``; combined before the shuffle."""
    best = F.min_by(F.struct(*take), order)
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")
