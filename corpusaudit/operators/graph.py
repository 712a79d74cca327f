"""Graphs: depth, degree and bounded clusters.

A diagram is a few edges inside one row: its depth and clusters are computed there, by a small helper on
the array of edges, without a shuffle. A graph of any size is a table of edges (graph_id, src, dst), see
``graph_tables``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusaudit.operators.graph_tables import ROW_EDGES, edges_in_rows, longest_chains, row_edges_of
from corpusaudit.session import cut_lineage


def longest_chain(below: dict[str, set[str]]) -> int:
    """Nodes on the longest chain, where nodes that reach each other count together, each once."""
    return _walk(below)[0]


def _walk(below: dict[str, set[str]]) -> tuple[int, bool]:
    """``longest_chain``, and whether some nodes reach each other.

    Parts of nodes that reach each other are closed bottom up (Tarjan's walk without recursion), so the chains below
    a part are known when it is closed.
    """
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    chain: dict[str, int] = {}  # of closed nodes: the chain from their part down
    waiting: list[str] = []
    folded = False
    for head in below:
        if head in number:
            continue
        stack = [(head, iter(below[head]))]
        number[head] = low[head] = len(number)
        waiting.append(head)
        while stack:
            node, rest = stack[-1]
            child = next(rest, None)
            if child is None:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[node])
                if low[node] == number[node]:
                    part = [waiting.pop()]
                    while part[-1] != node:
                        part.append(waiting.pop())
                    folded = folded or len(part) > 1
                    deepest = max((chain[c] for n in part for c in below.get(n, ()) if c in chain), default=0)
                    chain.update(dict.fromkeys(part, deepest + len(part)))
            elif child not in number:
                number[child] = low[child] = len(number)
                waiting.append(child)
                stack.append((child, iter(below.get(child, ()))))
            elif child not in chain:
                low[node] = min(low[node], number[child])
    return max(chain.values(), default=0), folded


@F.pandas_udf(T.IntegerType())
def chain_depth(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Nodes on the longest chain of an array of edges; see ``longest_chain``."""

    def depth(pairs) -> int:
        below: dict[str, set[str]] = {}
        for e in pairs if pairs is not None else ():
            below.setdefault(e["src"], set()).add(e["dst"])
        return longest_chain(below)

    for edges in batches:
        yield edges.map(depth)


#: Edges of all graphs that are numbered at once; a larger graph is numbered alone.
NUMBERED = 1 << 20


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """In order, each once."""
    numbers = np.sort(numbers)
    return numbers[np.concatenate([[True], numbers[1:] != numbers[:-1]])] if len(numbers) else numbers


def cluster_nodes(edges: pa.ListArray, cap: int, named: bool = True) -> pa.ListArray:
    """Clusters of at most ``cap`` nodes, hubs first, neighbours breadth first; ties by name. A graph is an element.

    Nodes are numbered by graph and name, so the neighbours of each lie together in order of their names. If not ``named``,
    an element has the numbers alone, in order of the names.
    """
    rows = np.repeat(np.arange(len(edges)), edges.value_lengths().fill_null(0).to_numpy())
    ends = edges.flatten()
    names = pa.chunked_array([ends.field("src"), ends.field("dst")]).combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(names.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    placed = rank[names.indices.to_numpy()] + np.concatenate([rows, rows]) * max(len(order), 1)
    nodes = _distinct(placed)
    at = np.searchsorted(nodes, placed)
    n = max(len(nodes), 1)
    a, b = at[: len(rows)], at[len(rows) :]
    pairs = _distinct(np.concatenate([a * n + b, b * n + a]))
    source, near = pairs // n, (pairs % n).tolist()
    degree = np.bincount(source, minlength=len(nodes))
    first = np.concatenate([[0], np.cumsum(degree)]).tolist()
    graph, name = np.divmod(nodes, max(len(order), 1))
    out = [0] * len(nodes)
    number = 0
    for seed in np.lexsort([nodes, -degree, graph]).tolist():
        if out[seed]:
            continue
        number += 1
        out[seed] = number
        members, room = [seed], cap - 1
        for m in members:
            if not room:
                break
            for other in near[first[m] : first[m + 1]]:
                if not out[other]:
                    out[other] = number
                    members.append(other)
                    room -= 1
                    if not room:
                        break
    sizes = np.bincount(graph, minlength=len(edges))
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    numbers = np.array(out, np.int64)
    if len(nodes):
        lowest = np.minimum.reduceat(numbers, cuts[:-1][sizes > 0])
        numbers -= np.repeat(lowest, sizes[sizes > 0]) - 1
    found = pa.array(numbers.astype(np.int32))
    if named:
        found = pa.StructArray.from_arrays([names.dictionary.take(pa.array(order[name])), found], names=["node", "cluster_no"])
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), found)


def _assigned(edges: Column, cap: int, named: bool) -> Column:
    """``cluster_nodes`` of a column of graphs."""
    number = T.IntegerType()
    kind = T.ArrayType(T.StructType().add("node", T.StringType()).add("cluster_no", number) if named else number)

    @F.arrow_udf(kind)
    def assign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for edges in batches:
            sizes = edges.value_lengths().fill_null(0).to_numpy()
            part = np.maximum(np.cumsum(sizes) - 1, 0) // NUMBERED
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(edges)]
            yield pa.concat_arrays([cluster_nodes(edges.slice(i, j - i), cap, named) for i, j in zip(cuts, cuts[1:])])

    return assign(edges)


def cluster_numbers(edges: Column, cap: int) -> Column:
    """Of a graph that is an array of edges, the cluster of each node in order of the names: what ``clusters`` can be taken
    from, without the names, where rows are moved between."""
    return _assigned(edges, cap, False)


def clusters(graphs: DataFrame, edges_col: str, cap: int, keys: list[str], numbers: str | None = None) -> DataFrame:
    """keys, node, cluster_no: each node in exactly one cluster. One row of ``graphs`` is one graph.

    ``numbers`` names the column with ``cluster_numbers`` of the same edges and cap, if they are worked out already.
    """
    if numbers is None:
        found = _assigned(F.col(edges_col), cap, True)
    else:
        names = F.sort_array(F.array_distinct(F.concat(F.col(f"{edges_col}.src"), F.col(f"{edges_col}.dst"))))
        found = F.arrays_zip(names.alias("node"), F.col(numbers).alias("cluster_no"))
    one = graphs.select(*keys, F.inline_outer(found).alias("node", "cluster_no"))
    return one.where(F.col("node").isNotNull())


def with_clusters(rows: DataFrame, assigned: DataFrame, keys: list[str], end: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the cluster of their node ``end``: an inner join with ``assigned``.

    It is a window and not a join, as that leaves rows that are dealt by ``keys`` where they are, and a join deals them again.
    """
    at = [*keys, end]
    known = F.lit(True)
    for c in at:
        known = known & F.col(c).isNotNull()
    kind = dict(assigned.dtypes)["cluster_no"]
    row = F.struct(F.lit(1).alias("_is_row"), *[c for c in rows.columns if c not in at])
    held = rows.select(*at, row.alias("_row"), F.lit(None).cast(kind).alias(name))
    nodes = assigned.select(*keys, F.col("node").alias(end), F.col("cluster_no").alias(name))
    nodes = nodes.select(*at, F.lit(None).cast(held.schema["_row"].dataType).alias("_row"), name)
    found = F.collect_list(F.when(F.col("_row").isNull(), F.struct(name))).over(Window.partitionBy(*at))
    both = held.where(known).unionByName(nodes.where(known)).withColumn("_found", found)
    return both.where("_row IS NOT NULL").select(*at, "_row.*", F.inline("_found")).drop("_is_row")


def cut_edges(edges: DataFrame, assigned: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with the clusters of their ends and whether they are cut."""
    with_src = with_clusters(edges, assigned, keys, "src", "src_cluster")
    return with_clusters(with_src, assigned, keys, "dst", "dst_cluster").withColumn("is_cut", F.col("src_cluster") != F.col("dst_cluster"))


def degrees(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct neighbours per node. Pairs are made distinct first, whichever way they go, so a hub is counted from partial sums."""
    # the smaller end first, null before all; a pair counts once for each of its ends
    swap = F.coalesce(F.col("src") > F.col("dst"), F.col("src").isNotNull())
    pairs = edges.select(*keys, F.when(swap, F.col("dst")).otherwise(F.col("src")).alias("a"), F.when(swap, F.col("src")).otherwise(F.col("dst")).alias("b")).distinct()
    ends = F.when(F.col("a").eqNullSafe(F.col("b")), F.array("a")).otherwise(F.array("a", "b"))
    return pairs.select(*keys, F.explode(ends).alias("node")).groupBy(*keys, "node").agg(F.count("*").alias("degree"))


def hubs_first(degree: DataFrame) -> DataFrame:
    return degree.orderBy(F.desc("degree"), "node")


#: Levels that are taken off one by one before what is left is contracted.
PEELED = 6


def _row_depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """graph, depth and whether it has a cycle, of graphs that are an array of edges."""
    for batch in batches:
        found = []
        for edges in row_edges_of(batch.column("edges")):
            below: dict[str, set[str]] = {}
            for a, b in zip(edges["src"], edges["dst"]):
                below.setdefault(a, set()).add(b)
            found.append(_walk(below))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([d for d, _ in found], pa.int32()), pa.array([c for _, c in found], pa.bool_())], names=[batch.schema.names[0], "deep", "cyclic"]
        )


def depth(edges: DataFrame, graph: str = "graph_id", row_edges: int = ROW_EDGES) -> DataFrame:
    """graph, depth, has_cycle for graphs of any size; depth as in ``longest_chain``.

    A graph of at most ``row_edges`` edges is one row and walked there. For larger ones, the first rounds drop the edges whose source has nothing above it any more: an acyclic graph loses one level per
    round, and one that loses nothing has a cycle. What is deeper than ``PEELED`` levels is contracted
    (``graph_tables.longest_chains``), in rounds that follow the logarithm of its longest chain. Graphs with a cycle are
    folded first, and chains are counted between their parts.
    """
    pairs = edges.select(graph, "src", "dst").distinct()
    graphs = pairs.groupBy(graph).agg(F.bool_or(F.col("src") == F.col("dst")).alias("loops"))
    whole = cut_lineage(pairs.where("src <> dst"))
    sizes = whole.groupBy(graph).agg(F.count("*").alias("edges"))
    none = F.lit(None).cast("int")
    state = cut_lineage(graphs.join(sizes, graph, "left").select(graph, "loops", "edges", F.when(F.col("edges").isNull(), 1).otherwise(none).alias("depth"), F.lit(False).alias("stuck")))
    small = state.where(F.col("depth").isNull() & (F.col("edges") <= row_edges)).select(graph, "loops")
    rows = edges_in_rows(whole.select(graph, "src", "dst"), small, graph)
    kind = dict(state.dtypes)[graph]
    walked = rows.mapInArrow(_row_depths, f"`{graph}` {kind}, deep INT, cyclic BOOLEAN").join(small, graph)
    walked = walked.select(graph, F.col("deep").alias("depth"), (F.col("loops") | F.col("cyclic")).alias("has_cycle"))
    state = state.where(F.col("depth").isNotNull() | (F.col("edges") > row_edges))
    open_ = F.col("depth").isNull() & ~F.col("stuck")
    left = whole
    for level in range(1, PEELED + 1):
        if state.where(open_).isEmpty():
            break
        above = left.select(graph, F.col("dst").alias("src")).distinct()
        kept = left.join(above, [graph, "src"], "left_semi").join(state.where(open_).select(graph), graph, "left_semi")
        left = cut_lineage(kept)
        now = left.groupBy(graph).agg(F.count("*").alias("now"))
        state = cut_lineage(
            state.join(now, graph, "left").select(
                graph,
                "loops",
                F.coalesce("now", "edges").alias("edges"),
                F.when(open_ & F.col("now").isNull(), level + 1).otherwise(F.col("depth")).alias("depth"),
                (F.col("stuck") | (open_ & F.coalesce(F.col("now") == F.col("edges"), F.lit(False)))).alias("stuck"),
            )
        )
    plain = state.where(F.col("depth").isNotNull()).select(graph, F.col("depth").cast("int").alias("depth"), F.col("loops").alias("has_cycle"))
    plain = walked.unionByName(plain)
    stuck = state.where("stuck").select(graph)
    if not state.where(open_).isEmpty():
        rest = left.join(state.where(open_).select(graph), graph, "left_semi")
        nodes = rest.select(graph, F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("weight", F.lit(1))
        chains, cyclic, _ = longest_chains(rest, nodes, graph, row_edges=row_edges)
        deep = chains.join(state, graph).select(graph, (F.col("chain") + PEELED).cast("int").alias("depth"), F.col("loops").alias("has_cycle"))
        plain, stuck = plain.unionByName(deep), stuck.union(cyclic)
    if stuck.isEmpty():
        return plain
    return plain.unionByName(_folded_depth(whole.join(stuck, graph, "left_semi"), graph, row_edges))


def _folded_depth(edges: DataFrame, graph: str, row_edges: int) -> DataFrame:
    """Depth of graphs with cycles: longest weighted chain between the parts."""
    parts = strongly_connected(edges, graph)
    nodes = edges.select(graph, F.explode(F.array("src", "dst")).alias("node")).distinct()
    of = nodes.join(parts, [graph, "node"], "left").select(graph, "node", F.coalesce("part", "node").alias("part"))
    of = cut_lineage(of)
    weight = of.groupBy(graph, F.col("part").alias("node")).agg(F.count("*").alias("weight"))
    side = lambda c: of.select(graph, F.col("node").alias(c), F.col("part").alias(f"{c}_part"))
    between = edges.join(side("src"), [graph, "src"]).join(side("dst"), [graph, "dst"]).where("src_part <> dst_part")
    between = between.select(graph, F.col("src_part").alias("src"), F.col("dst_part").alias("dst")).distinct()
    chains, _, _ = longest_chains(between, weight, graph, acyclic=True, row_edges=row_edges)
    return chains.select(graph, F.col("chain").cast("int").alias("depth"), F.lit(True).alias("has_cycle"))


def _trimmed(edges: DataFrame, graph: str) -> DataFrame:
    """Edges between nodes that have an edge in and an edge out, round by round."""
    before = edges.count()
    while before:
        starts = edges.select(graph, F.col("src").alias("dst")).distinct()
        ends = edges.select(graph, F.col("dst").alias("src")).distinct()
        edges = cut_lineage(edges.join(starts, [graph, "dst"], "left_semi").join(ends, [graph, "src"], "left_semi"))
        now = edges.count()
        if now == before:
            break
        before = now
    return edges


def strongly_connected(edges: DataFrame, graph: str = "graph_id") -> DataFrame:
    """graph, node, part for the nodes that lie on a cycle; nodes of a part reach each other.

    The largest name that reaches a node is its colour. Inside a colour, what reaches the node of that name is its
    part; parts are taken out, and the rest is coloured again.
    """
    core = _trimmed(edges.select(graph, "src", "dst").where("src <> dst").distinct(), graph)
    out = None
    while not core.isEmpty():
        colour = cut_lineage(core.select(graph, F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")).withColumn("new", F.lit(True)))
        while not colour.where("new").isEmpty():
            offered = core.join(colour.where("new").select(graph, F.col("node").alias("src"), "colour"), [graph, "src"])
            offered = offered.groupBy(graph, F.col("dst").alias("node")).agg(F.max("colour").alias("up"))
            larger = F.coalesce(F.col("up") > F.col("colour"), F.lit(False))
            colour = cut_lineage(colour.join(offered, [graph, "node"], "left").select(graph, "node", F.when(larger, F.col("up")).otherwise(F.col("colour")).alias("colour"), larger.alias("new")))
        one = colour.select(graph, F.col("node").alias("src"), F.col("colour").alias("src_colour"))
        two = colour.select(graph, F.col("node").alias("dst"), F.col("colour").alias("dst_colour"))
        inside = cut_lineage(core.join(one, [graph, "src"]).join(two, [graph, "dst"]).where("src_colour = dst_colour").select(graph, "src", "dst"))
        part = cut_lineage(colour.select(graph, "node", "colour", (F.col("node") == F.col("colour")).alias("hit"), (F.col("node") == F.col("colour")).alias("new")))
        while not part.where("new").isEmpty():
            back = inside.join(part.where("new").select(graph, F.col("node").alias("dst")), [graph, "dst"]).select(graph, F.col("src").alias("node")).distinct()
            back = back.withColumn("back", F.lit(True))
            found = ~F.col("hit") & F.col("back").isNotNull()
            part = cut_lineage(part.join(back, [graph, "node"], "left").select(graph, "node", "colour", (F.col("hit") | found).alias("hit"), found.alias("new")))
        done = part.where("hit").select(graph, "node", F.col("colour").alias("part"))
        out = done if out is None else out.unionByName(done)
        gone = done.select(graph, "node")
        core = core.join(gone.withColumnRenamed("node", "src"), [graph, "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), [graph, "dst"], "left_anti")
        core = _trimmed(cut_lineage(core), graph)
    if out is None:
        return edges.select(graph, F.col("src").alias("node"), F.col("src").alias("part")).limit(0)
    sizes = out.groupBy(graph, "part").agg(F.count("*").alias("n")).where("n > 1").select(graph, "part")
    return out.join(sizes, [graph, "part"], "left_semi").select(graph, "node", "part")
