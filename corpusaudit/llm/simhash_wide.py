"""Near-duplicates by wide SimHash fingerprints: texts whose word shingles have a similarity of 0.8 or more.

Two fingerprints differ in a share acos(c) / pi of their bits on average, c being the cosine of the shingle counts: 15
of 100 bits at a Jaccard similarity of 0.8. That is too far for masks of a narrow fingerprint, and too uncertain: 64
bits give 10 differences, more or less 3. Wide fingerprints have 256 bits, so 39 differences, more or less 6.

The top nodes of the index are masks: blocks of 16 bits of the fingerprint in a few fixed orders of its bits. Members of
a top node agree on a block. A pair at 0.8 agrees on one of 48 blocks with probability 0.97, at 0.9 with 0.999. Inside a
top node, members stand in Gray order below nodes of shared bit patterns, and groups are pruned by accumulated
differences. A top node with many members is dealt into chunks, and each pair of chunks is one search, so no task
holds more than two chunks, no pair is lost, and no pairs are written: links leave a search as a tree.

The orders are searched one after the other. What one has joined is one component to the next, which writes links
between different components only, so a large group of near copies is written once and not for each of its masks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import binaries, mix, written
from corpusaudit.llm.simhash import SEED, components, gray_rank

WORDS = 4  # of 64 bits
BITS = 64 * WORDS
SHINGLE = 5
SIMILARITY = 0.8
BLOCK = 16
ORDERS = 3
#: Members of a top node that one search takes from a chunk.
CHUNK = 4096
FANOUT = 8
_SMALL = 48  # members of a top node that are compared directly
_ORDERS = [np.random.default_rng(i).permutation(BITS) if i else np.arange(BITS) for i in range(ORDERS)]


def most_bits(similarity: float) -> int:
    """Bits that may differ: the mean at this Jaccard similarity, and a standard deviation more."""
    share = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.floor(BITS * share + math.sqrt(BITS * share * (1 - share)))


def wide_simhash(text: bytes, size: int = SHINGLE) -> bytes:
    """Majority of each bit over four hashes of every word shingle of a text; zero without words."""
    words = text.lower().split()
    if not words:
        return bytes(BITS // 8)
    if len(words) < size:
        words, size = [b" ".join(words)], 1
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - size + 1)
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(h), 1 << 14):  # a very long text is counted in pieces
        part = h[a : a + (1 << 14)]
        wide = np.stack([part, *(mix(part, k) for k in range(1, WORDS))], axis=1)
        ones += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE) -> DataFrame:
    """``id, fp`` (binary) of every whole text; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([wide_simhash(t, size) for t in binaries(batch, "text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), fp], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp binary")


def _array(fps: pa.BinaryArray) -> np.ndarray:
    """Fingerprints of an Arrow column, without an object for each."""
    _, offsets, data = fps.buffers()
    if not len(fps):
        return np.empty((0, WORDS), np.uint64)
    first = np.frombuffer(offsets, np.int32)[fps.offset]
    return np.frombuffer(data, np.uint8)[first : first + len(fps) * BITS // 8].view(np.uint64).reshape(len(fps), WORDS)


def top_nodes(known: DataFrame, order: int) -> DataFrame:
    """``node, fp, part``: the masks of each fingerprint in one order of the bits; ``part`` is its component, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = BITS // BLOCK
        for batch in batches:
            fps = batch.column("fp")
            bits = np.unpackbits(_array(fps).view(np.uint8), axis=1, bitorder="little")
            packed = np.packbits(bits[:, _ORDERS[order]], axis=1, bitorder="little")
            nodes = np.ascontiguousarray(packed).view(np.uint16).astype(np.int32) + (np.arange(per, dtype=np.int32) << BLOCK)
            at = pa.array(np.repeat(np.arange(len(fps)), per))
            yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel()), fps.take(at), batch.column("part").take(at)], names=["node", "fp", "part"])

    return known.select("fp", "part").mapInArrow(run, "node int, fp binary, part binary")


class GrayIndex:
    """Levels of nodes over wide fingerprints in Gray order: each has the bits all its members share, less those that
    the node above has."""

    def __init__(self, members: np.ndarray, fanout: int = FANOUT):
        self.order, self.fanout = np.lexsort([gray_rank(members[:, w]) for w in range(WORDS - 1, -1, -1)]), fanout
        self.members = members[self.order]
        value, shared = self.members, np.full(members.shape, ~np.uint64(0))
        levels = [(value, shared)]
        while len(value) > 1:
            starts = np.arange(0, len(value), fanout)
            all_ones, any_one = np.bitwise_and.reduceat(value & shared, starts), np.bitwise_or.reduceat(value & shared, starts)
            same = np.bitwise_and.reduceat(shared, starts) & ~(all_ones ^ any_one)
            value, shared = all_ones & same, same
            levels.append((value, shared))
        self.levels = []
        for depth, (value, shared) in enumerate(levels):
            if depth + 1 < len(levels):
                shared = shared & ~np.repeat(levels[depth + 1][1], fanout, axis=0)[: len(shared)]
            self.levels.append((value, shared))

    def search(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, place in ``members``) that differ in at most ``most`` bits."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        acc = np.zeros(len(queries), np.int16)
        for depth in range(len(self.levels) - 1, -1, -1):
            value, shared = self.levels[depth]
            for w in range(WORDS):
                acc = acc + np.bitwise_count((queries[q, w] ^ value[node, w]) & shared[node, w])
                near = acc <= most
                q, node, acc = q[near], node[near], acc[near]
            if depth:
                child = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                inside = child < len(self.levels[depth - 1][0])
                q, node, acc = np.repeat(q, self.fanout)[inside], child[inside], np.repeat(acc, self.fanout)[inside]
        return q, node


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest members of components, after the links ``a, b``."""
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _tree(root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    moved = np.flatnonzero(root != np.arange(len(root)))
    return moved, root[moved]


def linked_tree(members: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (places in ``members``) that join all within ``most`` bits, directly or not."""
    index = GrayIndex(members)
    root = np.arange(len(members))
    for a in range(0, len(members), 256):
        q, m = index.search(index.members[a : a + 256], most)
        root = _merge(root, q + a, m)
    a, b = _tree(root)
    return index.order[a], index.order[b]


def small_trees(values: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The same inside each of many small groups that lie one after the other."""
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = np.arange(len(values)) - first
    right = np.repeat(np.arange(len(values)), inside)  # each member against those before it in its group
    left = np.repeat(first, inside) + np.arange(len(right)) - np.repeat(np.cumsum(inside) - inside, inside)
    acc = np.zeros(len(right), np.int16)
    for w in range(WORDS):
        acc = acc + np.bitwise_count(values[left, w] ^ values[right, w])
        near = acc <= most
        left, right, acc = left[near], right[near], acc[near]
    return _tree(_merge(np.arange(len(values)), left, right))


def links(known: DataFrame, order: int, most: int) -> DataFrame:
    """``a, b``: edges between components (or fingerprints without one) that join those within ``most`` bits.

    ``known`` has distinct ``fp`` and their ``part``, null for a fingerprint by itself.
    """
    nodes = top_nodes(known, order)
    hot = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK)
    hot = hot.select("node", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    dealt = nodes.join(hot, "node", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = dealt.select("node", "fp", "part", mine.alias("c"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("d"))
    searches = dealt.groupBy("node", F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d"))
    searches = searches.agg(F.collect_list(F.struct("fp", "part")).alias("members")).where(F.size("members") > 1).select("members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            sizes, members = lists.value_lengths().to_numpy(), lists.flatten()
            fps = members.field("fp")
            values, names = _array(fps), pc.coalesce(members.field("part"), fps)
            starts = np.cumsum(sizes) - sizes
            is_small = sizes <= _SMALL
            places = np.flatnonzero(np.repeat(is_small, sizes))
            found = [tuple(places[x] for x in small_trees(values[places], sizes[is_small], most))]
            for i in np.flatnonzero(~is_small):
                mine = slice(starts[i], starts[i] + sizes[i])
                if len(pc.unique(names[mine])) > 1:  # else all of them are joined already
                    found.append(tuple(x + starts[i] for x in linked_tree(values[mine], most)))
            a, b = (names.take(pa.array(np.concatenate([f[side] for f in found]))) for side in (0, 1))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pc.not_equal(a, b))
        pa.default_memory_pool().release_unused()

    return searches.mapInArrow(run, "a binary, b binary").distinct()


def joined(distinct: DataFrame, most: int) -> DataFrame:
    """``fp, part``: of distinct fingerprints (column ``fp``) the component, null for one by itself."""
    known = distinct.select("fp", F.lit(None).cast("binary").alias("part"))
    for order in range(ORDERS):
        roots = written(components(links(known, order, most)), "simhash-roots")
        # a fingerprint of a component goes where that goes; one by itself is a node of its own
        known = known.join(roots, F.coalesce("part", "fp") == F.col("node"), "left")
        known = written(known.select("fp", F.coalesce("root", "part").alias("part")), "simhash-parts")
    return known


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """One row per document: id, ``component_id``, the smallest id that a document reaches over links.

    Documents link when their wide fingerprints differ in at most ``most_bits(similarity)`` bits. A null text is empty;
    texts without words are like each other, and texts of fewer words than a shingle are one shingle. Null ids never name
    a component unless all its ids are null. Repeated rows have equal fingerprints. An empty table gives an empty
    result.
    """
    fps = written(fingerprints(docs, id_col, text_col, size), "simhash-wide")
    distinct = written(fps.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    parts = joined(distinct, most_bits(similarity)).withColumnRenamed("fp", "node")
    known = distinct.join(parts, F.col("fp") == F.col("node")).select("fp", "first", F.coalesce("part", "fp").alias("root"))
    names = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = known.join(names, "root").select(F.col("fp").alias("n_fp"), "component_id")
    return fps.join(named, F.col("fp") == F.col("n_fp")).select(F.col("id").alias(id_col), "component_id")
