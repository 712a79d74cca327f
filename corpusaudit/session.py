"""Session settings the operators rely on, and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only: all of them can be changed on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # one target, project or bucket may hold a third of the rows: let AQE split such partitions, also
    # when the split costs one more exchange further down
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3.0",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
    # shuffle files go when the execution that wrote them ends, not when the driver happens to collect its garbage
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows carry whole files, so Arrow batches are kept short for the few Python helpers
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan over all cores, when it has fewer splits than there are cores.

    Work on text is heavy per row, and a small table may be one row group. A table with at least as many
    splits as cores is returned as it is, so a large one is never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def by_key(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """Rows of equal keys in one partition, before they are taken apart into many.

    What is then counted, made distinct or put in windows on these and further keys stays in its partition, so whole rows are
    shuffled instead of their many parts. For keys with rows of bounded size only, such as a document or a file. ``least`` is
    the least number of partitions, for rows that become so many that a session's partitions would not be sorted in memory.
    """
    return df.repartition(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; a temporary one only for local runs without it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusaudit-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder, so that a lost executor does not replay all rounds."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as read back from Parquet in the checkpoint folder: for tables many times larger than their input.

    ``cut_lineage`` writes rows as they are in memory; here columns are encoded and compressed.
    """
    return stored_at(df)[0]


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``stored``, and its folder, for ``discard`` when nothing reads it any more."""
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/stored-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def discard(spark: SparkSession, folders: Iterable[str]) -> None:
    """Remove folders that ``stored_at`` wrote."""
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
