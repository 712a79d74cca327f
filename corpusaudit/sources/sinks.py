"""Writers for findings, manifests, logs and assembled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.operators.classify import kind_of


def write_files(files: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Files stored once after ingest, a partition per kind, so that a check reads only the kinds it is for."""
    files.withColumn("kind", kind_of(F.col("path"))).write.mode(mode).partitionBy("kind").parquet(path)


def write_findings(findings: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """One folder per check, so that a gate reads only its own."""
    findings.write.mode(mode).partitionBy("check").format(fmt).save(path)


def write_manifest(listed: DataFrame, path: str, mode: str = "overwrite") -> None:
    listed.write.mode(mode).partitionBy("category").parquet(path)


def append_run_log(entries: DataFrame, path: str) -> None:
    """Appended as new files; earlier entries are neither read nor rewritten."""
    entries.write.mode("append").json(path)


def write_blocks(blocks: DataFrame, path: str, order: list[str], text: str = "block", mode: str = "overwrite") -> None:
    """Assembled documents: one folder per corpus, blocks in order over as many files as they need.

    Each block is followed by one newline.

    The range partitioning includes the order, so a document with a third of all blocks is spread out.
    """
    ranged = blocks.repartitionByRange("corpus", *order).sortWithinPartitions("corpus", *order)
    ranged.select("corpus", F.col(text).alias("value")).write.mode(mode).partitionBy("corpus").text(path)
