"""Documents larger than a row: text files of any size as chunks of whole lines, and bundles of files in such chunks.

A chunk is a row ``corpus, path, block, seq, content``; ``block`` and ``seq`` order the chunks of a document. Blocks are
the splits of a file that Spark reads at the same time, so a file of any size is read by many tasks, and no line is
moved to make a chunk. What a document carries from line to line is handled by ``operators.chunks``.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusaudit.operators.chunks import ORDER, with_carried
from corpusaudit.sources.bundles import MARKER

CHUNK_BYTES = 1 << 20
CHUNKS = "corpus STRING, path STRING, block BIGINT, seq INT, content STRING"


def read_chunks(spark: SparkSession, root: str, glob: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of all text files below ``root``: the first folder is the corpus, the rest the path.

    A chunk has the lines of one split until they reach ``chunk_bytes``; each line ends in a newline. Bad bytes become
    U+FFFD. A file without lines has no chunk.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/") + "/"
    lines = reader.text(root).select(F.make_valid_utf8("value").alias("line"), "_metadata.file_path", F.col("_metadata.file_block_start").alias("block"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq, held, size = None, 0, [], 0

        def chunk() -> pa.RecordBatch:
            corpus, _, path = unquote(at[0]).split(base)[-1].partition("/")
            return pa.RecordBatch.from_pydict(
                {"corpus": [corpus], "path": [path], "block": pa.array([at[1]], pa.int64()), "seq": pa.array([seq], pa.int32()), "content": ["\n".join(held) + "\n"]}
            )

        for batch in batches:
            for line, *place in zip(*(batch.column(c).to_pylist() for c in ("line", "file_path", "block"))):
                if held and (place != at or size >= chunk_bytes):
                    yield chunk()
                    seq, held, size = seq + 1, [], 0
                if place != at:
                    at, seq = place, 0
                held.append(line)
                size += len(line) + 1
        if held:
            yield chunk()

    return lines.mapInArrow(gather, CHUNKS)


def split_bundle_chunks(chunks: DataFrame) -> DataFrame:
    """Pieces of the files of bundles in chunks: corpus, bundle, file_no, path, block, seq, content.

    The pieces of a file, in the order of ``block`` and ``seq``, are its text, so a file may be larger than a row too. A
    marker stands on one line. What precedes the first marker of a bundle is dropped.
    """
    names = F.regexp_extract_all("content", F.lit(MARKER), F.lit(1))
    summary = chunks.select("corpus", "path", *ORDER, F.size(names).cast("long").alias("files"), F.try_element_at(names, F.lit(-1)).alias("name"))
    carried = with_carried(chunks, summary, sums=["files"], lasts=["name"])
    piece = F.arrays_zip(F.concat(F.array("name_before"), names).alias("name"), F.split("content", MARKER, -1).alias("body"))
    each = carried.select("corpus", F.col("path").alias("bundle"), *ORDER, "files_before", F.posexplode_outer(piece).alias("n", "f")).where(F.col("n").isNotNull())
    each = each.withColumn("file_no", F.col("files_before") + F.col("n")).where("file_no > 0 AND f.body <> ''")
    return each.select("corpus", "bundle", "file_no", F.trim("f.name").alias("path"), *ORDER, F.col("f.body").alias("content"))


def join_pieces(pieces: DataFrame) -> DataFrame:
    """Files of bundles as ``bundles.split_bundles`` gives them, for files that fit in a row: corpus, bundle, file_no, path, content."""
    parts = F.array_sort(F.collect_list(F.struct(*ORDER, "content")))
    body = F.array_join(F.transform("parts", lambda p: p["content"]), "")
    rows = pieces.groupBy("corpus", "bundle", "file_no").agg(F.first("path").alias("path"), parts.alias("parts"))
    return rows.select("corpus", "bundle", "file_no", "path", F.concat(F.regexp_replace(body, r"^\s+|\s+\z", ""), F.lit("\n")).alias("content"))
