"""Clusters and depths of graph tables against plain walks."""

import random
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusaudit.operators import graph, graph_tables
from corpusaudit.plans import QUERIES
from corpusaudit.session import checkpoint_dir
from tests.test_diagrams import EDGES, folded_depth, simple_depth


def connected(nodes, edges):
    near = {n: set() for n in nodes}
    for a, b in edges:
        if a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    seen, todo = set(), [next(iter(nodes))]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += near[n] - seen
    return len(seen) == len(nodes)


def check_clusters(df, cap, graphs):
    got = {}
    for r in graph_tables.grow_clusters(df, cap, ["graph_id"]).collect():
        assert r.node not in got.setdefault(r.graph_id, {})
        got[r.graph_id][r.node] = r.cluster
    for g, edges in graphs.items():
        assert set(got[g]) == {n for e in edges for n in e}
        members = {}
        for n, c in got[g].items():
            members.setdefault(c, set()).add(n)
        assert all(c in m and len(m) <= cap and connected(m, edges) for c, m in members.items())
        # no node is alone beside a cluster that had room for it
        full = {c for c, m in members.items() if len(m) == cap}
        for a, b in edges:
            one, two = got[g][a], got[g][b]
            assert one == two or len(members[one]) > 1 or len(members[two]) > 1 or {one, two} & full
    assert set(got) == set(graphs)
    return got


@pytest.mark.parametrize("cap", [1, 3, 8])
def test_clusters_of_random_graphs(spark, cap):
    rng = random.Random(cap)
    graphs = {f"g{g}": {(f"n{a}", f"n{b}") for a, b in (rng.choices(range(25), k=2) for _ in range(rng.randint(1, 50)))} for g in range(15)}
    graphs["star"] = {("hub", f"x{i}") for i in range(60)}
    graphs["path"] = {(f"p{i:03}", f"p{i + 1:03}") for i in range(200)}
    graphs["loop"] = {("a", "a")}
    df = spark.createDataFrame([(g, s, d) for g, es in graphs.items() for s, d in es], EDGES)
    got = check_clusters(df, cap, graphs)
    if cap == 8:
        assert sum(c == "hub" for c in got["star"].values()) == 8
        assert len(set(got["path"].values())) < 90
    parts = graph_tables.cluster_parts(df, graph_tables.grow_clusters(df, cap, ["graph_id"]), ["graph_id"]).collect()
    assert all(p.parts == 1 and p.nodes <= cap for p in parts) and len(parts) == sum(len(set(c.values())) for c in got.values())


def test_no_edges(spark):
    none = spark.createDataFrame([], EDGES)
    assert graph_tables.grow_clusters(none, 8, ["graph_id"]).count() == 0
    broken = spark.createDataFrame([("g", "a", "b"), ("g", "c", "d")], EDGES)
    one = spark.createDataFrame([("g", n, "a") for n in "abcd"], "graph_id STRING, node STRING, cluster STRING")
    assert [tuple(r) for r in graph_tables.cluster_parts(broken, one, ["graph_id"]).collect()] == [("g", "a", 4, 2)]


def test_rounds_leave_little_behind(spark):
    """What a round wrote goes when the next has read it; what stays are the names and the clusters."""
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    path = spark.range(5000).selectExpr("'g' AS graph_id", "concat('n', id) AS src", "concat('n', id + 1) AS dst")
    clusters = graph_tables.grow_clusters(path, 8, ["graph_id"])
    assert clusters.count() == 5001 and clusters.groupBy("cluster").count().agg(F.max("count")).first()[0] <= 8
    parts = graph_tables.cluster_parts(path, clusters, ["graph_id"])
    assert parts.where("parts <> 1").isEmpty()
    assert size() - before < 1_500_000


def chain_rounds(spark, df):
    nodes = df.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("weight", F.lit(1))
    chains, cyclic, rounds = graph_tables.longest_chains(df, nodes, "graph_id")
    return {r.graph_id: r.chain for r in chains.collect()}, {r.graph_id for r in cyclic.collect()}, rounds


def test_long_chain_in_few_rounds(spark):
    df = spark.range(9_999).selectExpr("'g' AS graph_id", "CAST(id AS STRING) AS src", "CAST(id + 1 AS STRING) AS dst")
    chains, cyclic, rounds = chain_rounds(spark, df)
    assert chains == {"g": 10_000} and not cyclic and rounds <= 15


def test_ladder_and_star(spark):
    ladder = [("ladder", f"{i}{a}", f"{i + 1}{b}") for i in range(60) for a in "xy" for b in "xy"]
    star = [("star", "top", f"m{i}") for i in range(500)] + [("star", f"m{i}", f"e{i % 7}") for i in range(500)]
    ring = [("ring", str(i), str((i + 1) % 300)) for i in range(300)]
    full = [("full", str(i), str(j)) for i in range(12) for j in range(12) if i != j] + [("full", "0", "tail")]
    chains, cyclic, rounds = chain_rounds(spark, spark.createDataFrame(ladder + star + ring + full, EDGES))
    assert chains == {"ladder": 61, "star": 3} and cyclic == {"ring", "full"} and rounds <= 15


def test_random_graphs(spark):
    rng = random.Random(5)
    graphs = {f"d{g}": {(f"n{a:02}", f"n{b:02}") for a, b in (sorted(rng.sample(range(20), 2)) for _ in range(rng.randint(1, 60)))} for g in range(30)}
    graphs |= {f"c{g}": {(f"n{a}", f"n{b}") for a, b in (rng.choices(range(12), k=2) for _ in range(rng.randint(1, 20)))} for g in range(30)}
    df = spark.createDataFrame([(g, s, d) for g, es in graphs.items() for s, d in es], EDGES)
    got = {r.graph_id: r.depth for r in graph.depth(df).collect()}
    assert {g: d for g, d in got.items() if g[0] == "d"} == {g: simple_depth(es) for g, es in graphs.items() if g[0] == "d"}
    assert got == {g: folded_depth(es) for g, es in graphs.items()}


def test_small_graphs_are_walked_in_their_row(spark):
    """Rows and rounds say the same, loops, cycles and chains between parts included."""
    rng = random.Random(7)
    graphs = {f"g{g}": {(f"n{a}", f"n{b}") for a, b in (rng.choices(range(9), k=2) for _ in range(rng.randint(1, 12)))} for g in range(12)}
    graphs["loop"] = {("a", "a")}
    df = spark.createDataFrame([(g, s, d) for g, es in graphs.items() for s, d in es], EDGES)
    whole, mixed = (sorted(map(tuple, graph.depth(df, row_edges=n).collect())) for n in (100, 6))
    assert whole == mixed and {g: d for g, d, _ in whole} == {g: folded_depth(es) for g, es in graphs.items()}
    nodes = df.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("weight", F.length("graph_id"))
    edges = df.where("src < dst").distinct()
    in_rows = graph_tables.longest_chains(edges, nodes, "graph_id")
    in_rounds = graph_tables.longest_chains(edges, nodes, "graph_id", row_edges=0)
    assert in_rows[2] == 0 and in_rounds[2] > 0
    assert sorted(map(tuple, in_rows[0].collect())) == sorted(map(tuple, in_rounds[0].collect()))
    ring = spark.createDataFrame([("r", str(i), str((i + 1) % 5)) for i in range(5)] + [("s", "a", "b")], EDGES)
    one = ring.select("graph_id", F.col("src").alias("node"), F.lit(1).alias("weight")).unionByName(spark.createDataFrame([("s", "b", 1)], "graph_id STRING, node STRING, weight INT"))
    chains, cyclic, rounds = graph_tables.longest_chains(ring, one, "graph_id")
    assert [tuple(r) for r in chains.collect()] == [("s", 2)] and [r.graph_id for r in cyclic.collect()] == ["r"] and rounds == 0


def test_clusters_of_many_graphs_at_once(spark):
    """Graphs of a batch are numbered together; the result is that of the plain walk of each."""

    def walk(pairs, cap):
        near = {}
        for a, b in pairs:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        out, number = {}, 0
        for seed in sorted(near, key=lambda n: (-len(near[n]), n)):
            if seed in out:
                continue
            number += 1
            queue, size = [seed], 0
            while queue and size < cap:
                node = queue.pop(0)
                if node not in out:
                    out[node], size = number, size + 1
                    queue += sorted(near[node])
        return out

    rng = random.Random(11)
    names = ["", "a", "ä", "Z", "\U0001f600", "\uffee"] + [f"w{k}" for k in range(30)]
    graphs = [[(rng.choice(names), rng.choice(names)) for _ in range(rng.choice([0, 1, 6, 50, 300]))] for _ in range(60)]
    edges = pa.array([[{"src": a, "dst": b} for a, b in g] for g in graphs] + [None], pa.list_(pa.struct([("src", pa.string()), ("dst", pa.string())])))
    for cap in (1, 3, 8):
        got = graph.cluster_nodes(edges.slice(2), cap).to_pylist()
        assert [{x["node"]: x["cluster_no"] for x in g} for g in got] == [walk(g, cap) for g in graphs[2:]] + [{}]


def test_degrees_of_pairs_both_ways(spark):
    """A pair counts once whichever way it goes; loops and null ends count as before."""
    pairs = [("g", "a", "b"), ("g", "b", "a"), ("g", "a", "a"), ("g", None, "b"), ("g", "b", None), ("g", None, None), (None, "x", "y")]
    got = graph.degrees(spark.createDataFrame(pairs, EDGES), ["graph_id"]).collect()
    assert {(r.graph_id, r.node): r.degree for r in got} == {("g", "a"): 2, ("g", "b"): 2, ("g", None): 2, (None, "x"): 1, (None, "y"): 1}


@pytest.mark.parametrize("name", ["q_line_degrees", "q_cluster_totals"])
def test_parts_of_a_document_are_not_shuffled_again(spark, tmp_path, name):
    """One shuffle a query, of documents or clusters; the pairs of words stay where their document is."""
    spark.createDataFrame([(1, "a b a c"), (2, "x y"), (None, "p q"), (1, "a z")], "doc_id LONG, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1
    got = {tuple(r) for r in df.collect()}
    if name == "q_line_degrees":
        assert got == {(1, "a", 3), (1, "b", 1), (1, "c", 1), (1, "z", 1), (2, "x", 1), (2, "y", 1), (None, "p", 1), (None, "q", 1)}
    else:
        assert got == {(1, 4, False, True, True), (2, 2, True, True, True)}
