"""Clusters and depths of graphs that are tables of edges, of any size and many at once.

No row holds a large graph and nothing large is walked node by node. Clusters grow from all local hubs at the same time; depths
come from taking nodes out, many at a time, and joining what they connected by longer edges. Each round is a few joins on
(graph, node) over what is left, written to the checkpoint folder.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusaudit.session import cut_lineage, discard, stored, stored_at

#: Edges of a graph that is walked in one row; larger ones go by rounds.
ROW_EDGES = 10_000


def edges_in_rows(edges: DataFrame, graphs: DataFrame, graph: str) -> DataFrame:
    """graph, edges: a row for each graph in ``graphs``, with its edges as an array of all other columns."""
    kept = edges.join(graphs.select(graph), graph, "left_semi")
    return kept.groupBy(graph).agg(F.collect_list(F.struct(*[c for c in edges.columns if c != graph])).alias("edges"))


def row_edges_of(column: pa.ListArray) -> Iterator[dict[str, list]]:
    """The edges of each row, by column."""
    all_, at = column.values, column.offsets.to_pylist()
    for start, end in zip(at, at[1:]):
        part = all_.slice(start, end - start)
        yield {f.name: values.to_pylist() for f, values in zip(part.type, part.flatten())}


def _row_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """graph and its longest chain by weight; null if the graph has a cycle."""
    for batch in batches:
        chains = []
        for e in row_edges_of(batch.column("edges")):
            weight = dict(zip(e["src"], e["src_weight"])) | dict(zip(e["dst"], e["dst_weight"]))
            below: dict[str, list[str]] = {n: [] for n in weight}
            above = dict.fromkeys(weight, 0)
            for a, b in zip(e["src"], e["dst"]):
                below[a].append(b)
                above[b] += 1
            chain = dict(weight)
            todo, done = deque(n for n, k in above.items() if not k), 0
            while todo:
                node = todo.popleft()
                done += 1
                for n in below[node]:
                    chain[n] = max(chain[n], chain[node] + weight[n])
                    above[n] -= 1
                    if not above[n]:
                        todo.append(n)
            chains.append(max(chain.values()) if done == len(weight) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chains, pa.int64())], names=[batch.schema.names[0], "chain"])


def _both_ways(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    ways = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("near")), F.struct(F.col("dst").alias("node"), F.col("src").alias("near")))
    return edges.where("src <> dst").select(*keys, F.inline(ways)).distinct()


def grow_clusters(edges: DataFrame, cap: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys, node, cluster: every node of an edge in one connected cluster of at most ``cap`` nodes, named by its seed.

    In each round a free node asks to join the neighbouring cluster with room whose seed has most neighbours, and a
    cluster takes as many as it has room for, those with most neighbours first. A free node without such a cluster starts
    one if no free neighbour has more neighbours than it. Nodes with equally many go by a hash of the name, then the
    name, so a row of equal nodes starts clusters all along. Loops are ignored; a node with loops only is alone.
    """
    keys = list(keys)
    at = [*keys, "node"]
    spark = edges.sparkSession
    loops = edges.where("src = dst").select(*keys, F.col("src").alias("node")).distinct()
    # the order of all nodes is a number, so that the rounds need no names and no keys
    order = [F.desc("degree"), F.xxhash64("node"), F.col("node"), *keys]
    pairs, pairs_at = stored_at(_both_ways(edges, keys))
    degree = pairs.groupBy(at).agg(F.count("*").alias("degree"))
    named = stored(degree.orderBy(*order).select(*at, F.monotonically_increasing_id().alias("place")))
    side = lambda c: named.select(*keys, F.col("node").alias(c), F.col("place").alias(f"{c}_place"))
    near = pairs.join(side("node"), at).join(side("near"), [*keys, "near"])
    near, near_at = stored_at(near.select(F.col("node_place").alias("node"), F.col("near_place").alias("near")))
    discard(spark, [pairs_at])
    nodes, nodes_at = stored_at(named.select(F.col("place").alias("node"), F.lit(None).cast("long").alias("seed"), F.lit(0).alias("room")))
    done = []
    row = F.row_number().over(Window.partitionBy("seed").orderBy("node"))
    while True:
        free = nodes.where("seed IS NULL")
        if free.isEmpty():
            break
        old = [near_at, nodes_at]
        # what a free node sees: clusters with room, and free nodes
        other = nodes.select(F.col("node").alias("near"), F.col("seed").alias("near_seed"), F.col("room").alias("near_room"))
        near, near_at = stored_at(near.select("node", "near").join(free.select("node"), "node", "left_semi").join(other, "near"))
        sees = near.groupBy("node").agg(
            F.min(F.when(F.col("near_seed").isNotNull(), F.struct(F.col("near_seed").alias("seed"), F.col("near_room").alias("room")))).alias("best"),
            F.min(F.when(F.col("near_seed").isNull(), F.col("near"))).alias("rival"),
        )
        judged = free.select("node").join(sees, "node", "left")
        asking = judged.where("best IS NOT NULL").select("node", "best.seed", "best.room")
        taken = asking.withColumn("n", row).where(F.col("n") <= cap).where("n <= room").select("node", "seed")
        starts = judged.where("best IS NULL AND (rival IS NULL OR node < rival)").select("node", F.col("node").alias("seed"))
        new = taken.unionByName(starts).withColumnRenamed("seed", "new_seed")
        after, after_at = stored_at(nodes.join(new, "node", "left").select("node", F.coalesce("seed", "new_seed").alias("seed")))
        sizes = after.where("seed IS NOT NULL").groupBy("seed").agg((cap - F.count("*")).cast("int").alias("room"))
        nodes, nodes_at = stored_at(after.join(sizes, "seed", "left").select("node", "seed", F.coalesce("room", F.lit(0)).alias("room")))
        done.append(stored(nodes.where("seed IS NOT NULL AND room = 0").select("node", "seed")))
        nodes = nodes.where("seed IS NULL OR room > 0")
        discard(spark, [*old, after_at])
    discard(spark, [near_at])
    out = nodes.select("node", "seed")
    for part in done:
        out = out.unionByName(part)
    seeds = named.select(F.col("place").alias("seed"), F.col("node").alias("cluster"))
    out = out.withColumnRenamed("node", "place").join(named, "place").join(seeds, "seed").select(*at, "cluster")
    return out.unionByName(loops.join(named, at, "left_anti").select(*at, F.col("node").alias("cluster")))


def cluster_parts(edges: DataFrame, clusters: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, cluster, nodes, parts: of each cluster its nodes, and the connected parts that the edges inside make of it.

    Labels spread by rounds inside clusters only, so their number is bounded by the size of a cluster.
    """
    keys = list(keys)
    at = [*keys, "node"]
    end = clusters.select(*keys, F.col("node").alias("near"), F.col("cluster").alias("near_cluster"))
    inside = _both_ways(edges, keys).join(clusters, at).join(end, [*keys, "near"]).where("cluster = near_cluster")
    inside, inside_at = stored_at(inside.select(*at, "near"))
    label, label_at = stored_at(clusters.select(*at, "cluster", F.col("node").alias("label")))
    while True:
        heard = inside.join(label.select(*keys, F.col("node").alias("near"), F.col("label").alias("heard")), [*keys, "near"])
        heard = heard.groupBy(at).agg(F.min("heard").alias("heard"))
        new = label.join(heard, at, "left").withColumn("moved", F.col("heard") < F.col("label"))
        old = label_at
        label, label_at = stored_at(new.select(*at, "cluster", F.least("label", "heard").alias("label"), "moved"))
        discard(edges.sparkSession, [old])
        if label.where("moved").isEmpty():
            break
    discard(edges.sparkSession, [inside_at])
    return label.groupBy(*keys, "cluster").agg(F.count("*").alias("nodes"), F.count_distinct("label").alias("parts"))


def longest_chains(edges: DataFrame, nodes: DataFrame, graph: str, acyclic: bool = False, row_edges: int = ROW_EDGES) -> tuple[DataFrame, DataFrame, int]:
    """``graph, chain`` of acyclic graphs, ``graph`` of those with a cycle, and the number of rounds.

    ``edges`` has ``graph, src, dst`` without loops, ``nodes`` ``graph, node, weight``. A chain counts the weights of its
    nodes. A graph of at most ``row_edges`` edges is one row and walked there; of a larger one nodes are taken out in rounds.

    A node that is taken out leaves an edge from each node above it to each below it, which carries its weight;
    chains that end or start at it are kept with its neighbours. Nodes without edges on one side cost nothing, others
    are taken out while that adds no edges. Of neighbours one goes at a time: ends first, then by a hash of
    name and round. So a chain shrinks by a constant share in each of the two steps of a round, and the number of rounds is
    logarithmic in its length; a graph with many edges at every node loses a level a step. An edge from a node to
    itself, or no end in a graph with edges, tells of a cycle; this is not looked for in graphs known to be ``acyclic``.
    """
    key = [graph, "node"]
    zero = F.lit(0).cast("long")
    edges = cut_lineage(edges.select(graph, "src", "dst", zero.alias("gap")))
    # up: the longest chain that ends here; down: what can follow it through nodes taken out
    nodes = cut_lineage(nodes.select(*key, F.col("weight").cast("long").alias("weight"), F.col("weight").cast("long").alias("up"), zero.alias("down")))
    best = nodes.groupBy(graph).agg(F.max("up").alias("chain"))
    small = edges.groupBy(graph).agg(F.count("*").alias("n")).where(F.col("n") <= row_edges).select(graph)
    side = lambda c: nodes.select(graph, F.col("node").alias(c), F.col("weight").alias(f"{c}_weight"))
    weighted = edges.select(graph, "src", "dst").join(small, graph, "left_semi").join(side("src"), [graph, "src"]).join(side("dst"), [graph, "dst"])
    walked = edges_in_rows(weighted, small, graph).mapInArrow(_row_chains, f"`{graph}` {dict(edges.dtypes)[graph]}, chain LONG")
    walked = cut_lineage(walked)
    best = best.unionByName(walked.where("chain IS NOT NULL"))
    cyclic = walked.where("chain IS NULL").select(graph)
    edges, nodes = (cut_lineage(df.join(walked.select(graph), graph, "left_anti")) for df in (edges, nodes))
    rounds = 0
    while not edges.isEmpty():
        for step in range(2):
            edges, nodes, found, stuck = _take_out(edges, nodes, graph, 2 * rounds + step, acyclic)
            best, cyclic = best.unionByName(found), cyclic.union(stuck)
        rounds += 1
        if not acyclic:
            cyclic = cut_lineage(cyclic.distinct())
            edges = cut_lineage(edges.join(cyclic, graph, "left_anti"))
    best = best.unionByName(nodes.select(graph, (F.col("up") + F.col("down")).alias("chain")))
    chains = best.groupBy(graph).agg(F.max("chain").alias("chain")).join(cyclic, graph, "left_anti")
    return chains, cyclic, rounds


def _take_out(edges: DataFrame, nodes: DataFrame, graph: str, step: int, acyclic: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Edges and nodes without those of an independent set, the chains through these, and graphs found to have a cycle."""
    key = [graph, "node"]
    ends = F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    degree = edges.select(graph, F.inline(ends)).groupBy(key).agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    is_small = F.col("o") * F.col("i") <= F.greatest(F.col("o") + F.col("i"), F.lit(4))
    rank = F.when(F.col("o") == 0, 3).when(F.col("i") == 0, 2).when(is_small, 1).otherwise(0)
    turn: Column = F.struct(rank.alias("rank"), F.xxhash64(*key, F.lit(step)).alias("h"), F.col("node").alias("name"))
    ranked = degree.select(*key, turn.alias("turn"))
    side = lambda c: ranked.select(graph, F.col("node").alias(c), F.col("turn").alias(f"{c}_turn"))
    met = edges.select(graph, "src", "dst").join(side("src"), [graph, "src"]).join(side("dst"), [graph, "dst"])
    pairs = F.array(F.struct(F.col("src").alias("node"), F.col("src_turn").alias("mine"), F.col("dst_turn").alias("other")), F.struct(F.col("dst").alias("node"), F.col("dst_turn").alias("mine"), F.col("src_turn").alias("other")))
    # each table that is used more than once is written, so that no step is worked out again inside the next
    judged = cut_lineage(met.select(graph, F.inline(pairs)).groupBy(key).agg(F.first("mine").alias("mine"), F.max("other").alias("other")))
    stuck = judged.groupBy(graph).agg(F.max("mine.rank").alias("rank")).where("rank < 3").select(graph)
    out = judged.where("mine.rank > 0 AND mine > other").select(key)

    chosen = nodes.join(out, key, "left_semi")
    x = lambda c: chosen.select(graph, F.col("node").alias(c), "weight", "up", "down")
    above = edges.join(x("dst"), [graph, "dst"])
    below = edges.join(x("src"), [graph, "src"])
    bridged = above.select(graph, "src", F.col("dst").alias("node"), (F.col("gap") + F.col("weight")).alias("g")).join(
        below.select(graph, F.col("src").alias("node"), "dst", "gap"), key
    )
    bridged = bridged.select(graph, "src", "dst", (F.col("g") + F.col("gap")).alias("gap"))
    if not acyclic:
        bridged = cut_lineage(bridged)
    rest = edges.join(out.withColumnRenamed("node", "src"), [graph, "src"], "left_anti").join(out.withColumnRenamed("node", "dst"), [graph, "dst"], "left_anti")
    left = cut_lineage(rest.unionByName(bridged.where("src <> dst")).groupBy(graph, "src", "dst").agg(F.max("gap").alias("gap")))
    stuck = stuck.union(bridged.where("src = dst").select(graph))

    ups = below.groupBy(graph, F.col("dst").alias("node")).agg(F.max(F.col("up") + F.col("gap")).alias("from_above"))
    downs = above.groupBy(graph, F.col("src").alias("node")).agg(F.max(F.col("gap") + F.col("weight") + F.col("down")).alias("to_below"))
    kept = nodes.join(out, key, "left_anti").join(ups, key, "left").join(downs, key, "left")
    kept = kept.select(*key, "weight", F.greatest("up", F.col("from_above") + F.col("weight")).alias("up"), F.greatest("down", "to_below").alias("down"))
    return left, cut_lineage(kept), chosen.select(graph, (F.col("up") + F.col("down")).alias("chain")), stuck.distinct()
