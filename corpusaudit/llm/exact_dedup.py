"""Exact deduplication with counting quotient filters.

Each partition builds a filter of its fingerprints: a fingerprint is cut into a quotient, which is a place, and a
remainder, which is stored there; bit vectors tell the occupied places and the ends of their runs, so nothing is
lost, and counters above one are kept beside. A filter travels as slices by the leading bits of its fingerprints.
Slices of one range merge by their sorted remainders, in as many tasks as there are ranges, and a fingerprint whose
count is above one sends its documents to the comparison of whole texts. A fingerprint that thousands of copies
share is one slot with a counter in each filter, so copies are counted before anything is shuffled.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import partitions, written


class CountingQuotientFilter:
    """Sorted 64-bit fingerprints with counts, as quotients and remainders."""

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray):
        self.fingerprints, self.counts = fingerprints.astype(np.uint64), counts.astype(np.int64)

    @classmethod
    def of(cls, fingerprints: np.ndarray) -> CountingQuotientFilter:
        return cls(*np.unique(fingerprints.astype(np.uint64), return_counts=True))

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Runs of sorted remainders merged, counts of equal ones added; nothing is lost."""
        both = np.concatenate([f.fingerprints for f in filters]) if filters else np.empty(0, np.uint64)
        counts = np.concatenate([f.counts for f in filters]) if filters else np.empty(0, np.int64)
        order = np.argsort(both, kind="stable")  # merges runs that are sorted
        both, counts = both[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.empty(0, np.int64)
        return cls(both[first], np.add.reduceat(counts, first) if len(first) else counts)

    def slices(self, bits: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """The filter by the leading ``bits`` of its fingerprints."""
        tops = (self.fingerprints >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(self.fingerprints), np.int64)
        for top in np.unique(tops).tolist():
            a, b = np.searchsorted(tops, [top, top + 1])
            yield top, CountingQuotientFilter(self.fingerprints[a:b], self.counts[a:b])

    def to_bytes(self, bits: int = 0) -> bytes:
        """Quotient filter of the fingerprints below their leading ``bits``, which all share."""
        n = len(self.fingerprints)
        q = max(1, int(n).bit_length())
        r = 64 - bits - q
        low = self.fingerprints & np.uint64((1 << (64 - bits)) - 1)
        quotient = (low >> np.uint64(r)).astype(np.int64)
        width = -(-r // 8)
        remainders = (low & np.uint64((1 << r) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        run_end = np.concatenate([quotient[1:] != quotient[:-1], [True]]) if n else np.empty(0, bool)
        more = np.flatnonzero(self.counts > 1)
        parts = [np.packbits(occupied), np.packbits(run_end), np.ascontiguousarray(remainders), more.astype("<u4"), self.counts[more].astype("<i8")]
        return struct.pack("<IBBI", n, q, width, len(more)) + b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, data: bytes, top: int = 0, bits: int = 0) -> CountingQuotientFilter:
        n, q, width, n_more = struct.unpack_from("<IBBI", data)
        at = struct.calcsize("<IBBI")

        def take(kind: str, size: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(data, kind, size, at)
            at += a.nbytes
            return a

        occupied = np.unpackbits(take("u1", -(-(1 << q) // 8)), count=1 << q)
        run_end = np.unpackbits(take("u1", -(-n // 8)), count=n)
        remainders = np.zeros((n, 8), np.uint8)
        remainders[:, :width] = take("u1", n * width).reshape(n, width)
        more, counted = take("<u4", n_more), take("<i8", n_more)
        run = np.cumsum(run_end) - run_end  # which run a slot is in
        quotient = np.flatnonzero(occupied)[run].astype(np.uint64)
        shared = np.uint64(top << (64 - bits)) if bits else np.uint64(0)
        counts = np.ones(n, np.int64)
        counts[more] = counted
        return cls(shared | (quotient << np.uint64(64 - bits - q)) | remainders.view("<u8").ravel(), counts)


def normalised(text: Column) -> Column:
    """The text with every run of white space as one blank, null as empty. Single blanks are left as they stand."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def repeated_fingerprints(df: DataFrame, column: str = "fp") -> DataFrame:
    """``fp, n`` of the 64-bit fingerprints that occur more than once, by merging filters of all partitions."""
    bits = max(0, (partitions(df.sparkSession) - 1).bit_length())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.uint64)]
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        tops, data = [], []
        for top, part in CountingQuotientFilter.of(np.concatenate(held)).slices(bits):
            tops.append(top)
            data.append(part.to_bytes(bits))
        yield pa.RecordBatch.from_arrays([pa.array(tops, pa.int32()), pa.array(data, pa.binary())], names=["top", "filter"])

    def merge(key, rows: pd.DataFrame) -> pd.DataFrame:
        top = int(key[0])
        whole = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x, top, bits) for x in rows["filter"]])
        many = whole.counts > 1
        return pd.DataFrame({"fp": whole.fingerprints[many].view(np.int64), "n": whole.counts[many]})

    filters = df.select(F.col(column).alias("fp")).mapInArrow(build, "top int, filter binary")
    return filters.groupBy("top").applyInPandas(merge, "fp long, n long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after white space is made uniform; a null text is empty. Of equal texts the
    smallest id stays; null ids come last, and a group of null ids only keeps null. Rows that repeat both id and
    text count in ``group_size`` and share one verdict. An empty table gives an empty result.

    Texts of a repeated fingerprint are compared whole, as a grouping key, after copies have been merged inside
    each task. Other texts are shuffled once, to find those; digests carry the verdicts back.
    """
    norm = normalised(F.col(text_col))
    slim = written(docs.select(F.col(id_col).alias("id"), F.xxhash64(norm).alias("fp"), F.sha2(norm, 256).alias("sha")), "exact")
    repeated = repeated_fingerprints(slim).select("fp").hint("shuffle_hash")
    texts = docs.select(F.col(id_col).alias("id"), norm.alias("text")).withColumn("fp", F.xxhash64("text"))
    suspects = texts.join(repeated, "fp", "left_semi")
    groups = suspects.groupBy("fp", "text").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = groups.select("fp", F.sha2("text", 256).alias("sha"), "keep", "n", F.lit(True).alias("grouped"))
    found = slim.join(groups, ["fp", "sha"], "left")
    keep = F.when(F.col("grouped"), F.col("keep")).otherwise(F.col("id"))
    return found.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, all columns; of rows that repeat id and text one stays."""
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("__kept_id"), "text_sha256").distinct()
    kept = kept.withColumnRenamed("text_sha256", "__kept_sha")
    same = F.col(id_col).eqNullSafe(F.col("__kept_id")) & (F.sha2(normalised(F.col(text_col)), 256) == F.col("__kept_sha"))
    return docs.join(kept, same, "left_semi").dropDuplicates([id_col, text_col])
