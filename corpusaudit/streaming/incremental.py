"""Continuously arriving files: a stateless leak scan and a re-check of what changed.

A leak scan is row-local, so the batch operator runs on the stream as it is. Checks with joins run inside
``foreachBatch`` on the files of the batch that the ledger of hashes does not know yet.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusaudit import schemas
from corpusaudit.operators.leakage import LeakRule, scan
from corpusaudit.operators.versions import snapshot


def stream_files(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """A growing folder of Parquet files with the ``files`` schema."""
    return (
        spark.readStream.schema(schemas.FILES).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)
    )


def start_leak_scan(files: DataFrame, rules: Sequence[LeakRule], out: str, checkpoint: str) -> StreamingQuery:
    """Findings of every new file, appended exactly once by the file sink."""
    return (
        scan(files, rules)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_recheck(
    files: DataFrame,
    check: Callable[..., DataFrame],
    out: str,
    ledger: str,
    checkpoint: str,
) -> StreamingQuery:
    """Run ``check`` on files whose hash is new; results and hashes are written per batch.

    This is for checks that need nothing but the file itself. Links depend on other files: ``link_index`` keeps them.

    Folders are named after the batch, so a batch that is replayed after a failure overwrites its own
    output. The ledger is written last: a file counts as done only when its findings are there.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            hashes = snapshot(batch)
            before = known_hashes(spark, ledger, batch_id)
            fresh = hashes.join(before, ["corpus", "path", "sha256"], "left_anti") if before is not None else hashes
            todo = batch.join(fresh.select("corpus", "path"), ["corpus", "path"], "left_semi")
            check(todo).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            fresh.write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")
        finally:
            batch.unpersist()

    return (
        files.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def known_hashes(spark: SparkSession, ledger: str, before: int | None = None) -> DataFrame | None:
    """Latest hash per file in the ledger, of batches before ``before``; None while it is empty."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(ledger)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder) or not fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{ledger}/batch=*/*.parquet")):
        return None
    seen = spark.read.parquet(ledger)
    if before is not None:
        seen = seen.where(F.col("batch") < before)
    return seen.groupBy("corpus", "path").agg(F.max_by("sha256", "batch").alias("sha256"))
