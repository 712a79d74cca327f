"""Token ids in binary files: patched frame of reference.

Ids are cut into blocks of 128. A block stores its minimum and the differences from it, packed at a width that a
percentile of the differences fits; the few larger ones go to an exception list with their positions. The start
of each block is indexed, so any block can be read alone. A row of the files (Parquet is the container, so they
are written and committed by Spark and can lie in any store) is one segment of whole documents:

``part, segment``      place in the order of all documents
``doc_ids, n_ids``     ids of the documents and how many token ids each has (lists)
``minima, widths``     little-endian u32 and u8 for each block
``starts``             little-endian u32, first 64-bit word of each block in ``packed``
``packed``             blocks, each 2 x width little-endian 64-bit words, lowest bits first
``patch_starts``       little-endian u32, first exception of each block
``patch_at, patches``  u8 positions inside the block and little-endian u32 differences
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusaudit.llm.common import partitions, strings
from corpusaudit.llm.token_counts import ByteLevel, Pieces, cuts_at_blanks, is_byte_level

BLOCK = 128
#: The share of a block's differences that its width has to hold.
PERCENTILE = 0.9
#: Ids gathered before a segment is packed; a longer document makes a longer segment.
SEGMENT_IDS = 1 << 20
FIELDS = ["minima", "widths", "starts", "packed", "patch_starts", "patch_at", "patches"]
SCHEMA = "part int, segment int, doc_ids array<{kind}>, n_ids array<long>, total long, " + ", ".join(f"{f} binary" for f in FIELDS)


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> dict[str, bytes]:
    """Blocks of ids (u32); the last block is filled up with its own last id."""
    n = -(-len(ids) // BLOCK)
    full = np.concatenate([ids, np.full(n * BLOCK - len(ids), ids[-1] if len(ids) else 0, np.uint32)]).astype(np.uint32).reshape(n, BLOCK)
    minima = full.min(axis=1) if n else np.empty(0, np.uint32)
    diff = (full - minima[:, None]).astype(np.uint64)
    bits = np.frexp(diff.astype(np.float64))[1].astype(np.uint8)
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    widths = np.partition(bits, at, axis=1)[:, at] if n else np.empty(0, np.uint8)
    starts = np.concatenate([[0], np.cumsum(2 * widths.astype(np.int64))])
    block, place = np.nonzero(bits > widths[:, None])
    packed = np.zeros(starts[-1], np.uint64)
    for w in np.unique(widths[widths > 0]).tolist():
        rows = np.flatnonzero(widths == w)
        low = np.ascontiguousarray((diff[rows] & np.uint64((1 << w) - 1)).T)
        out = np.zeros((2 * w, len(rows)), np.uint64)
        for j in range(BLOCK):
            word, shift = divmod(j * w, 64)
            out[word] |= low[j] << np.uint64(shift)
            if shift + w > 64:
                out[word + 1] |= low[j] >> np.uint64(64 - shift)
        packed[starts[rows][:, None] + np.arange(2 * w)] = out.T
    patch_starts = np.searchsorted(block, np.arange(n))
    return {
        "minima": minima.astype("<u4").tobytes(),
        "widths": widths.astype(np.uint8).tobytes(),
        "starts": starts[:-1].astype("<u4").tobytes(),
        "packed": packed.astype("<u8").tobytes(),
        "patch_starts": patch_starts.astype("<u4").tobytes(),
        "patch_at": place.astype(np.uint8).tobytes(),
        "patches": diff[block, place].astype("<u4").tobytes(),
    }


def unpack(row: dict[str, bytes], first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of blocks ``first`` to ``last`` (exclusive; all by default), found through the index of block starts."""
    n = len(row["widths"])
    last = n if last is None else last
    widths = np.frombuffer(row["widths"], np.uint8)[first:last]
    starts = np.frombuffer(row["starts"], "<u4")[first:last].astype(np.int64)
    packed = np.frombuffer(row["packed"], "<u8")
    out = np.zeros((last - first, BLOCK), np.uint32)
    for w in np.unique(widths[widths > 0]).tolist():
        rows = np.flatnonzero(widths == w)
        words = np.ascontiguousarray(packed[starts[rows][:, None] + np.arange(2 * w)].T)
        low, mask = np.empty((BLOCK, len(rows)), np.uint32), np.uint64((1 << w) - 1)
        for j in range(BLOCK):
            word, shift = divmod(j * w, 64)
            x = words[word] >> np.uint64(shift)
            if shift + w > 64:
                x |= words[word + 1] << np.uint64(64 - shift)
            low[j] = x & mask
        out[rows] = low.T
    bounds = np.append(np.frombuffer(row["patch_starts"], "<u4"), len(row["patch_at"])).astype(np.int64)
    lo, hi = (bounds[first], bounds[last]) if last > first else (0, 0)
    block = np.repeat(np.arange(last - first), np.diff(bounds[first : last + 1]))
    out[block, np.frombuffer(row["patch_at"], np.uint8)[lo:hi]] = np.frombuffer(row["patches"], "<u4")[lo:hi]
    return (out + np.frombuffer(row["minima"], "<u4")[first:last, None]).ravel()


class Encoder:
    """Ids of whole texts as the tokenizers library gives them.

    Byte-level texts are cut at blanks, where pre-tokens begin. The ids of a piece are its whole tokens and what the
    library's merges give for its other pre-tokens; they are remembered. All other texts go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.level = ByteLevel(self.tok) if is_byte_level(self.tok) else None
        if self.level:
            whole = {p: np.uint32(i).tobytes() for p, i in self.level.whole.items()}
            self.pieces = Pieces(self.level, whole, lambda p: array("I", [t.id for t in self.level.merged(p)]).tobytes(), b"")

    def __call__(self, text: str) -> bytes:
        """Little-endian u32 ids."""
        if self.level is None or self.level.special and self.level.special.search(text) or not cuts_at_blanks(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        first, *rest = text.split(" ")
        return self.pieces.value(first) + b"".join(map(self.pieces.__getitem__, rest))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, append ``end_id`` to each document, write the files in ascending order of the ids.

    Documents are range-partitioned by id; rows of one id are spread by a hash of their text, so that neither a
    repeated id nor repeated rows gather in one task. A null text is empty (just the end id); null ids come first;
    equal ids are ordered by that hash, equal rows are alike in any order. An empty table writes no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    n = partitions(docs.sparkSession)
    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        end = np.array([end_id], np.uint32).tobytes()
        ids, counts, chunks, held = [], [], [], 0

        def row():
            r = pack(np.frombuffer(b"".join(chunks), np.uint32))
            values = [[part], [segment], [ids], [counts], [sum(counts)], *([r[f]] for f in FIELDS)]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=names)

        names = ["part", "segment", "doc_ids", "n_ids", "total", *FIELDS]
        for batch in batches:
            types = [pa.int32(), pa.int32(), pa.list_(batch.schema.field("id").type), pa.list_(pa.int64()), pa.int64(), *[pa.binary()] * len(FIELDS)]
            for i, x in zip(batch.column("id").to_pylist(), map(encode, strings(batch, "text"))):
                ids.append(i)
                chunks.append(x + end)
                counts.append(len(x) // 4 + 1)
                held += counts[-1]
                if held >= SEGMENT_IDS:
                    yield row()
                    segment += 1
                    ids, counts, chunks, held = [], [], [], 0
        if ids:
            yield row()

    ordered = cols.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie")
    # the packed words do not compress any further
    ordered.mapInArrow(run, SCHEMA.format(kind=kind)).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files: id, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    Starts come from sums: of the segments of a part, and of the parts; one row per part meets in one place.
    """
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = files.select("part", "segment", "total")
    parts = sizes.groupBy("part").agg(F.sum("total").alias("ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "segment", F.coalesce(F.sum("total").over(inside), F.lit(0)).alias("segment_start"))
    starts = starts.join(parts, "part").select("part", "segment", (F.col("part_start") + F.col("segment_start")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r)
                bounds = np.concatenate([[0], np.cumsum(r["n_ids"])]).astype(np.int64)
                raw, n = ids.astype("<u4").tobytes(), len(r["n_ids"])
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(r["doc_ids"], batch.schema.field("doc_ids").type.value_type),
                        pa.array([r["part"]] * n, pa.int32()),
                        pa.array([r["segment"]] * n, pa.int32()),
                        pa.array(bounds[:-1], pa.int64()),
                        pa.array(r["n_ids"], pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["id", "part", "segment", "inside", "n_tokens", "ids_crc32"],
                )

    docs = files.mapInArrow(run, f"id {kind}, part int, segment int, inside long, n_tokens long, ids_crc32 long")
    start = (F.col("first") + F.col("inside")).alias("start")
    return docs.join(starts, ["part", "segment"]).select(F.col("id").alias(id_col), start, "n_tokens", "ids_crc32")
