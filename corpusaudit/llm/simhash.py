"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints that differ in at most two bits agree on at least four of six blocks of bits. Each choice of four
blocks is a mask, and the fingerprints that share the bits below a mask are the members of one top node; what is
left of them are two blocks, at most 22 bits, so a top node never has more than 2^22 members however the data are
skewed, and no member has more than 253 partners in it. Inside a top node members are sorted by the Gray rank of
their free bits. Runs of neighbours form the nodes of the next level, which keep the pattern of bits all their
members share; bits shared at one level are left out further down. A search goes down all levels at once for a block
of members, adds up the differences node by node, and drops a whole group as soon as they exceed two.

Links of a node are reduced to a tree before they leave it. Connected components of the trees are found by rounds of
label passing on tables; copies have one fingerprint and enter as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import binaries, written
from corpusaudit.session import cut_lineage

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: First and last bit of each block.
BLOCKS = [(0, 11), (11, 22), (22, 33), (33, 44), (44, 54), (54, 64)]
FANOUT = 8
_QUERIES = 1 << 12


def _mask(blocks) -> int:
    return sum(((1 << (b - a)) - 1) << a for a, b in blocks)


#: Masks of what the members of a top node share: all but two blocks.
MASKS = [_mask(c) for c in combinations(BLOCKS, len(BLOCKS) - DISTANCE)]


def simhash(text: bytes, size: int = SHINGLE) -> int:
    """Fingerprint of a text: majority of each bit over the XXH64 of its word shingles; 0 without words.

    ``bytes.lower`` and ``bytes.split`` change and split at ASCII only, as the definition asks.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):  # a very long text is counted in pieces
        bits = np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp`` (64 bits, signed) of every whole text; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([simhash(t) for t in binaries(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each number in the order of Gray codes."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """Levels of nodes over distinct numbers in Gray order: each node has the bits all its members share, less those
    that the node above has."""

    def __init__(self, members: np.ndarray, fanout: int = FANOUT):
        self.members = members[np.argsort(gray_rank(members), kind="stable")]
        self.fanout = fanout
        value, shared = self.members, np.full(len(members), ~np.uint64(0))
        levels = [(value, shared)]
        while len(value) > 1:
            starts = np.arange(0, len(value), fanout)
            ones, any_one = np.bitwise_and.reduceat(value & shared, starts), np.bitwise_or.reduceat(value, starts)
            same = np.bitwise_and.reduceat(shared, starts) & ~(ones ^ any_one)
            value, shared = ones & same, same
            levels.append((value, shared))
        # what the node above already has is not compared again
        self.levels = []
        for depth, (value, shared) in enumerate(levels):
            if depth + 1 < len(levels):
                shared = shared & ~np.repeat(levels[depth + 1][1], fanout)[: len(shared)]
            self.levels.append((value, shared))

    def search(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, place in ``members``) that differ in at most ``most`` bits."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        acc = np.zeros(len(queries), np.uint8)
        for depth in range(len(self.levels) - 1, -1, -1):
            value, shared = self.levels[depth]
            acc = acc + np.bitwise_count((queries[q] ^ value[node]) & shared[node])
            near = acc <= most
            q, node, acc = q[near], node[near], acc[near]
            if depth:
                size = len(self.levels[depth - 1][0])
                child = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                inside = child < size
                q, node, acc = np.repeat(q, self.fanout)[inside], child[inside], np.repeat(acc, self.fanout)[inside]
        return q, node


def linked_tree(members: np.ndarray, most: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Edges (number, smallest number of its component) of the links between the members of one top node."""
    if len(members) == 2:
        near = np.bitwise_count(members[0] ^ members[1]) <= most
        return (members[[0]], members[[1]]) if near else (members[:0], members[:0])
    index = GrayIndex(members)
    members = index.members
    left, right = [], []
    for a in range(0, len(members), _QUERIES):
        q, m = index.search(members[a : a + _QUERIES], most)
        q = q + a
        left.append(q[m > q])
        right.append(m[m > q])
    a, b = np.concatenate(left), np.concatenate(right)
    root = np.arange(len(members))
    while len(a):  # smaller roots win, then paths are halved
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(root)))
    return members[moved], members[root[moved]]


def links(distinct: DataFrame) -> DataFrame:
    """``a, b``: edges between distinct fingerprints (column ``fp``) that join all within two bits, directly or not."""
    keys = F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("bits")) for i, m in enumerate(MASKS)])
    nodes = distinct.select("fp", F.explode(keys).alias("k")).groupBy("k.m", "k.bits")
    nodes = nodes.agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1).select("members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            values, ends = lists.flatten().to_numpy().view(np.uint64), np.cumsum(lists.value_lengths().to_numpy())
            found = [linked_tree(values[a:b]) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]
            a, b = (np.concatenate([f[i] for f in found] or [values[:0]]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return nodes.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: for each end of an edge the smallest end that it reaches.

    Rounds of large-star and small-star (connect all larger neighbours, then all smaller ones, to the smallest):
    edges shrink to stars in a number of rounds that grows as the square of the logarithm of the largest component.
    Both are one aggregation and one join, so a centre with many neighbours is reduced before it is shuffled; lineage is cut in each round.
    """
    e = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = cut_lineage(small.where("u <> v").distinct())
        # stars stay as they are: the same edges, counted and summed as a set
        before, after = (x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first() for x in (e, new))
        e = new
        if before == after:
            break
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hexadecimal digits), ``component_id``.

    Documents link when their fingerprints differ in at most two bits; ``component_id`` is the smallest id that a
    document reaches. A null or empty text has fingerprint 0 and links like any other; null ids never name a
    component unless all its ids are null. Repeated rows have equal fingerprints. An empty table gives an empty result.
    """
    fps = written(fingerprints(docs, id_col, text_col), "simhash")
    distinct = fps.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(links(distinct.select("fp")))
    known = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = known.join(names, "root").select(F.col("fp").alias("n_fp"), "component_id")
    out = fps.join(named, F.col("fp") == F.col("n_fp"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
