"""Links of a growing corpus, kept right as files arrive, change and go.

The index is a folder of small tables without texts: what each file offers as a target, how many files each folder
holds, which links each page has by target, and what the check of each link said. A batch adds to them and reads the
texts of its own files only. It checks the links of its changed pages and, found by their target, the links of all
other pages whose target has appeared, gone, or changed its headings: a text that changes below its headings has
nothing checked but its own links.

Each table has a folder per batch, which a replayed batch overwrites; a batch reads what batches before it wrote. A
row is current if its batch is the last one that changed its page. A file goes by a row without content and size.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusaudit.operators import links
from corpusaudit.operators.classify import with_suffix
from corpusaudit.operators.joins import fits_broadcast
from corpusaudit.operators.lines import KEY
from corpusaudit.session import discard, stored_at

LINK = "corpus STRING, path STRING, line_no INT, link_no INT, url STRING, target_path STRING, anchor STRING"
TABLES = {
    "files": "corpus STRING, path STRING, sha256 STRING, modified_at TIMESTAMP, is_there BOOLEAN, slugs ARRAY<STRING>",
    "folders": "corpus STRING, path STRING, change BIGINT",
    "links": LINK,
    "checks": f"{LINK}, page_batch BIGINT, reason STRING",
}
TARGET = ["corpus", "target_path"]


class LinkIndex:
    """The tables of an index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str, upto: int | None = None) -> DataFrame:
        """A table with its ``batch``; batches after ``upto`` are left out."""
        df = self.spark.read.schema(f"{TABLES[name]}, batch BIGINT").option("recursiveFileLookup", "false").parquet(f"{self.folder}/{name}")
        return df if upto is None else df.where(F.col("batch") <= upto)

    def write(self, name: str, df: DataFrame, batch: int) -> DataFrame:
        """What a batch adds to a table, as read back."""
        columns = [c.split()[0] for c in TABLES[name].replace("ARRAY<STRING>", "A").split(", ")]
        df.select(columns).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{name}/batch={batch}")
        return self.read(name).where(F.col("batch") == batch)

    def files(self, upto: int | None = None, among: DataFrame | None = None) -> DataFrame:
        """Last state of each file, of those in ``among`` (corpus, path) where it is given."""
        df = self.read("files", upto)
        if among is not None:
            df = df.join(among, KEY, "left_semi")
        last = F.max_by(F.struct("sha256", "modified_at", "is_there", "slugs", "batch"), "batch")
        return df.groupBy(*KEY).agg(last.alias("s")).select(*KEY, "s.*")

    def broken(self, upto: int | None = None) -> DataFrame:
        """Broken links as they are now: what ``links.check_links`` finds in the newest files."""
        checks = self.read("checks", upto)
        key = [*KEY, "page_batch", "line_no", "link_no"]
        # a link that is right goes without its address
        fault = F.when(F.col("reason").isNotNull(), F.struct("reason", "url", "target_path", "anchor"))
        last = checks.groupBy(*key).agg(F.max_by(fault, "batch").alias("c"))
        bad = last.where("c IS NOT NULL").select(*key, "c.*")
        pages = self.read("files", upto).groupBy(*KEY).agg(F.max("batch").alias("page_batch"))
        return bad.join(pages, [*KEY, "page_batch"], "left_semi").select(*KEY, "line_no", "url", "reason", "target_path", "anchor")


def hashed(batch: DataFrame) -> DataFrame:
    """Rows with their hash, their time and whether the file is there; no column is null but the content."""
    sha = F.coalesce(F.sha2(F.col("content").cast("binary"), 256), F.lit(""))
    time = F.coalesce("modified_at", F.lit(0).cast("timestamp"))
    there = F.col("content").isNotNull() | F.col("size").isNotNull()
    return batch.select(*KEY, "content", time.alias("modified_at"), sha.alias("sha256"), there.alias("is_there"))


def new_texts(batch: DataFrame, fresh: DataFrame) -> tuple[DataFrame, bool]:
    """Texts of the rows of a batch that are ``fresh``, and whether each file has one row at most.

    Texts are shuffled only if many rows are fresh and many are not. Where all rows are fresh there is nothing to join.
    """
    key = [*KEY, "sha256", "modified_at"]
    whole, fresh = batch.dropna(subset=KEY), fresh.dropna(subset=KEY)
    if fresh.count() == whole.count():  # fresh has a row a file
        return whole.select(*KEY, "content"), True
    if fits_broadcast(fresh):
        return whole.join(F.broadcast(fresh), key, "left_semi").select(*KEY, "content"), False
    stale = whole.select(key).join(fresh, key, "left_anti").distinct()
    if fits_broadcast(stale):
        return whole.join(F.broadcast(stale), key, "left_anti").select(*KEY, "content"), False
    return whole.join(fresh, key, "left_semi").select(*KEY, "content"), False


def add_batch(index: LinkIndex, batch: DataFrame, number: int, ignore: Iterable[str] = (), skip_fences: bool = False) -> None:
    """Add the files of one batch and check what that may have changed."""
    before = number - 1
    batch = hashed(batch)
    # of the rows of a file the last one, by time, then hash
    last = F.max(F.struct("modified_at", "is_there", "sha256"))
    rows = batch.groupBy(*KEY).agg(last.alias("l")).select(*KEY, "l.*")
    known = index.files(before, rows.select(KEY)) if number else rows.withColumns({"slugs": F.array().cast("array<string>"), "batch": F.lit(0)}).limit(0)
    known = known.select(*KEY, F.col("sha256").alias("old_sha"), F.col("modified_at").alias("old_time"), F.col("is_there").alias("was_there"), F.col("slugs").alias("old_slugs"))
    rows = rows.join(known, KEY, "left")
    was_there = F.coalesce("was_there", F.lit(False))
    news = (F.col("is_there") != was_there) | (F.col("is_there") & (F.col("sha256") != F.col("old_sha")))
    # written and not persisted, whose shuffle files would stay with the session
    rows, rows_at = stored_at(rows.where(news & (F.col("old_time").isNull() | (F.col("modified_at") >= F.col("old_time")))))
    try:
        # texts of this batch only, and of them those that are new
        fresh = rows.where("is_there").select(*KEY, "sha256", "modified_at")
        texts, once = new_texts(batch, fresh)
        heads = links.page_targets(texts).select("corpus", F.col("target_path").alias("path"), "slugs").distinct()
        files = index.write("files", rows.join(heads, KEY, "left"), number)
        found = links.local_links(texts, ignore, skip_fences)
        new_links = index.write("links", found if once else found.distinct(), number)

        state = files.join(rows.select(*KEY, was_there.alias("was_there"), "old_slugs"), KEY)
        moved = state.where(F.col("is_there") != F.col("was_there"))
        steps = moved.select("corpus", F.explode(links.folders_of(F.col("path"))).alias("path"), F.when(F.col("is_there"), 1).otherwise(-1).alias("step"))
        folders = index.write("folders", steps.groupBy(*KEY).agg(F.sum("step").alias("change")).where("change <> 0"), number)
        held = index.read("folders", number).join(folders.select(KEY), KEY, "left_semi").groupBy(*KEY)
        is_new = F.col("batch") == number
        held = held.agg(F.sum("change").alias("now"), F.coalesce(F.sum(F.when(~is_new, F.col("change"))), F.lit(0)).alias("then"))
        other = state.where((F.col("is_there") != F.col("was_there")) | ~F.col("slugs").eqNullSafe(F.col("old_slugs")))
        targets = other.select(*KEY).union(held.where("(now > 0) <> (then > 0)").select(*KEY)).select("corpus", F.col("path").alias("target_path")).distinct()

        todo = new_links
        if number:
            pointing = index.read("links", before).join(targets, TARGET, "left_semi")
            pages = index.read("files", number).join(pointing.select(KEY).distinct(), KEY, "left_semi")
            pages = pages.groupBy(*KEY).agg(F.max("batch").alias("batch"))
            todo = todo.unionByName(pointing.join(pages, [*KEY, "batch"], "left_semi"))
        asked = todo.select(TARGET).distinct().withColumnRenamed("target_path", "path")
        there = index.files(number, asked).where("is_there").select(*KEY, F.lit(True).alias("is_file"), "slugs")
        kept = index.read("folders", number).join(asked, KEY, "left_semi").groupBy(*KEY).agg(F.sum("change").alias("n")).where("n > 0")
        there = there.unionByName(kept.select(*KEY, F.lit(False).alias("is_file"), F.array().cast("array<string>").alias("slugs")))
        checked = todo.join(there.withColumnRenamed("path", "target_path"), TARGET, "left").withColumn("reason", links.link_fault())
        index.write("checks", checked.withColumn("page_batch", F.col("batch")), number)
    finally:
        discard(index.spark, [rows_at])


def start_link_check(files: DataFrame, folder: str, checkpoint: str, ignore: Iterable[str] = (), skip_fences: bool = False) -> StreamingQuery:
    """Keep the index in ``folder`` up with a stream of files; ``LinkIndex.broken`` reads the result."""
    ignore = list(ignore)

    def run(batch: DataFrame, number: int) -> None:
        add_batch(LinkIndex(batch.sparkSession, folder), batch, number, ignore, skip_fences)

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
