"""Queries on diagrams, graphs, labels, bundles, assembled documents and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusaudit.functions import text as tx
from corpusaudit.operators import assemble, diagrams, graph, graph_tables, labels, modules, quality, reconcile
from corpusaudit.plans import inputs as i
from corpusaudit.plans.registry import lines_sql, query, table
from corpusaudit.session import by_key, spread, stored
from corpusaudit.sources import bundles, chunks

# ------------------------------------------------------------------------------------------- diagrams

NODE_RE = "(?:\\[.*?\\]|\\(.*?\\)|\\{.*?\\})?"
FLOW_RE = f"^\\s*(\\w+){NODE_RE}\\s*-->\\s*(\\w+){NODE_RE}"
STATE_RE = "^\\s*(\\S+)\\s*-->\\s*(\\S+)"
ER_RE = "^\\s+(\\w+)\\s+\\S*--\\S*\\s+(\\w+)\\s*:"


def _edges_sql(source: str, regex: str, kind: str) -> str:
    return f"""SELECT corpus, path, '{kind}' AS kind, CAST(row_number() OVER (PARTITION BY corpus, path ORDER BY line_no) AS INTEGER) AS edge_no,
                 regexp_extract(line, '{regex}', 1) AS src, regexp_extract(line, '{regex}', 2) AS dst FROM ({lines_sql(source)}) WHERE regexp_matches(line, '{regex}')"""


FLOW_EDGES = _edges_sql(i.FLOWCHARTS.sql(), FLOW_RE, "flowchart")
ALL_EDGES = f"{FLOW_EDGES} UNION ALL {_edges_sql(i.STATES.sql(), STATE_RE, 'stateDiagram')} UNION ALL {_edges_sql(i.ENTITIES.sql(), ER_RE, 'erDiagram')}"


def _diagrams(spark, sf):
    return i.FLOWCHARTS.df(spark, sf).unionByName(i.STATES.df(spark, sf)).unionByName(i.ENTITIES.df(spark, sf))


@query("q_diagram_edges", ALL_EDGES)
def q_diagram_edges(spark, sf):
    return diagrams.edges(_diagrams(spark, sf))


GROUP_SQL = f"""
  e AS ({FLOW_EDGES}),
  m AS (SELECT *, CASE WHEN node IN ('D1', 'D2') OR starts_with(node, 'C') THEN 'S1' WHEN node IN ('E1', 'E2') THEN 'S2' END AS grp FROM (SELECT DISTINCT src AS node FROM e UNION SELECT dst FROM e)),
  g AS (SELECT e.corpus, e.path, edge_no, src, dst, a.grp AS src_group, b.grp AS dst_group FROM e JOIN m a ON a.node = src JOIN m b ON b.node = dst)"""


def _grouped(spark, sf):
    flow = i.FLOWCHARTS.df(spark, sf)
    return diagrams.group_edges(diagrams.edges(flow), diagrams.members(flow))


@query("q_group_edges", f"WITH {GROUP_SQL} SELECT * FROM g")
def q_group_edges(spark, sf):
    return _grouped(spark, sf).drop("touches")


@query(
    "q_group_touches",
    f"""WITH {GROUP_SQL} SELECT corpus, path, src_group AS grp, edge_no, src, dst, src_group = dst_group IS TRUE AS inside FROM g WHERE src_group IS NOT NULL
        UNION SELECT corpus, path, dst_group, edge_no, src, dst, src_group = dst_group IS TRUE FROM g WHERE dst_group IS NOT NULL""",
)
def q_group_touches(spark, sf):
    """Edges of each group, a row for each end group."""
    return diagrams.group_touches(_grouped(spark, sf))


@query(
    "q_overview_edges",
    f"WITH {GROUP_SQL} SELECT DISTINCT corpus, path, coalesce(src_group, src) AS src, coalesce(dst_group, dst) AS dst FROM g WHERE coalesce(src_group, src) <> coalesce(dst_group, dst)",
)
def q_overview_edges(spark, sf):
    return diagrams.overview_edges(_grouped(spark, sf))


CHAIN = "concat(" + ", chr(10), ".join(f"'a{k} --> a{k + 1}'" for k in range(7)) + ")"


@query(
    "q_oversized",
    f"""SELECT o_orderpriority AS corpus, concat('diagrams/c', o_orderkey, '.mmd') AS path, 'stateDiagram' AS kind, o_orderkey % 7 + 1 AS count, CAST(4 AS BIGINT) AS max_allowed
        FROM orders WHERE o_orderkey % 7 >= 4 AND o_orderkey % 5 > 0
        UNION ALL SELECT o_orderpriority, concat('diagrams/f', o_orderkey, '.mmd'), 'flowchart', 7, 4 FROM orders WHERE o_totalprice > 250000""",
)
def q_oversized(spark, sf):
    """Flowcharts, and chains of up to seven states of which every fifth is a part of a split diagram."""
    text = f"concat('stateDiagram-v2', chr(10), substring({CHAIN}, 1, CAST(10 * (o_orderkey % 7) AS INT)))"
    path = "concat('diagrams/c', o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '-part1.mmd' ELSE '.mmd' END)"
    chains = table(spark, sf, "orders").selectExpr("o_orderpriority AS corpus", f"{path} AS path", f"{text} AS content")
    return diagrams.oversized_diagrams(i.FLOWCHARTS.df(spark, sf).select("corpus", "path", "content").unionByName(chains))


SEQ_LINES = lines_sql(i.MESSAGES.sql())
ER_LINES = lines_sql(i.ENTITIES.sql())
KEYWORDS = "^\\s*(participant|actor|Note|end|loop|alt|else|opt|par|rect|critical|break)"


@query(
    "q_diagram_overflow",
    f"""WITH s AS (SELECT corpus, path, count(DISTINCT CASE WHEN regexp_matches(line, '^\\s*(participant|actor)\\s+\\S') THEN regexp_extract(line, '^\\s*(?:participant|actor)\\s+(\\S+)', 1) END) AS p,
            count(*) FILTER (regexp_matches(line, '->>|-->>|-\\)\\)|--\\)|->|-->') AND NOT regexp_matches(line, '{KEYWORDS}')) AS m FROM ({SEQ_LINES}) WHERE line_no > 1 GROUP BY ALL),
          n AS (SELECT corpus, path, regexp_extract(line, '{ER_RE}', 1) AS e FROM ({ER_LINES}) WHERE regexp_matches(line, '{ER_RE}')
                UNION SELECT corpus, path, regexp_extract(line, '{ER_RE}', 2) FROM ({ER_LINES}) WHERE regexp_matches(line, '{ER_RE}')
                UNION SELECT corpus, path, regexp_extract(line, '^\\s+(\\w+)\\s*\\{{', 1) FROM ({ER_LINES}) WHERE regexp_matches(line, '^\\s+(\\w+)\\s*\\{{')),
          r AS (SELECT corpus, path, count(DISTINCT e) AS e FROM n GROUP BY ALL),
          a AS (SELECT corpus, path, 'sequence_participants' AS rule, p AS count, 5 AS max_allowed FROM s UNION ALL SELECT corpus, path, 'sequence_messages', m, 12 FROM s
                UNION ALL SELECT corpus, path, 'er_entities', e, 8 FROM r
                UNION ALL SELECT o_orderpriority, concat('diagrams/f', o_orderkey, '.mmd'), 'flowchart_vertical_nodes', 7, 4 FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000)
        SELECT 'overflow' AS "check", corpus, path, CAST(1 AS INTEGER) AS line_no, rule, count, CAST(max_allowed AS BIGINT) AS max_allowed FROM a WHERE count > max_allowed""",
)
def q_diagram_overflow(spark, sf):
    both = i.MESSAGES.df(spark, sf).unionByName(i.ENTITIES.df(spark, sf)).unionByName(i.FLOWCHARTS.df(spark, sf))
    return diagrams.diagram_overflow(both)


@query(
    "q_flow_depth",
    """SELECT o_orderpriority AS corpus, concat('diagrams/f', o_orderkey, '.mmd') AS path, CASE WHEN o_totalprice > 250000 THEN 7 ELSE 4 END AS depth FROM orders""",
)
def q_flow_depth(spark, sf):
    """Longest chain of every flowchart: seven nodes when the groups are linked, else four."""
    flow = tx.with_lines(i.FLOWCHARTS.df(spark, sf))
    return flow.select("corpus", "path", graph.chain_depth(diagrams.flow_edges()).alias("depth"))


@query(
    "q_slides",
    f"""WITH l AS (SELECT *, trim(line) = '---' AS sep FROM ({lines_sql(i.DECKS.sql())})),
          n AS (SELECT *, sum(CASE WHEN sep THEN 1 ELSE 0 END) OVER (PARTITION BY corpus, path ORDER BY line_no) AS no FROM l)
        SELECT corpus, path, min(line_no) AS first_line, CAST(count(*) AS INTEGER) AS lines, CAST(count(*) FILTER (regexp_matches(line, '^\\s*[-*]\\s')) AS INTEGER) AS bullets
        FROM n WHERE no >= 2 AND NOT sep GROUP BY corpus, path, no""",
)
def q_slides(spark, sf):
    from corpusaudit.operators.lines import slides

    s = slides(i.DECKS.df(spark, sf))
    bullets = F.size(F.filter("lines", lambda l: l.rlike(r"^\s*[-*]\s")))
    return s.select("corpus", "path", "first_line", F.size("lines").alias("lines"), bullets.alias("bullets"))


@query(
    "q_slide_overflow",
    f"""WITH l AS (SELECT *, trim(line) = '---' AS sep FROM ({lines_sql(i.DECKS.sql())})),
          n AS (SELECT *, sum(CASE WHEN sep THEN 1 ELSE 0 END) OVER (PARTITION BY corpus, path ORDER BY line_no) AS no FROM l),
          c AS (SELECT corpus, path, min(line_no) AS line_no, count(*) FILTER (regexp_matches(line, '^\\s*[-*]\\s')) AS b, count(*) FILTER (regexp_matches(line, '^\\s*\\|.*\\|\\s*$')) AS t,
              count(*) FILTER (regexp_matches(line, '^\\s*\\|.*\\|\\s*$') AND NOT regexp_matches(line, '^\\s*\\|[\\s\\-:|]+\\|\\s*$')) - 1 AS d FROM n WHERE no >= 2 AND NOT sep GROUP BY corpus, path, no)
        SELECT 'overflow' AS "check", corpus, path, line_no, 'slide_bullets' AS rule, b AS count, CAST(5 AS BIGINT) AS max_allowed FROM c WHERE b > 5
        UNION ALL SELECT 'overflow', corpus, path, line_no, 'slide_table_rows', d, 5 FROM c WHERE t >= 2 AND d > 5""",
)
def q_slide_overflow(spark, sf):
    return diagrams.slide_overflow(i.DECKS.df(spark, sf))


@query(
    "q_diagram_syntax",
    """SELECT corpus, path, diagram_type, CASE WHEN diagram_type = 'graph' THEN 'invalid diagram type' END AS problem, kind FROM (
         SELECT o_orderpriority AS corpus, concat('diagrams/f', o_orderkey, '.mmd') AS path, CASE WHEN o_orderstatus = 'F' THEN 'flowchart' ELSE 'graph' END AS diagram_type, 'flowchart' AS kind FROM orders
         UNION ALL SELECT o_orderpriority, concat('diagrams/s', o_orderkey, '.mmd'), 'stateDiagram-v2', 'stateDiagram' FROM orders
         UNION ALL SELECT source, concat('er/', doc_id, '.mmd'), 'erDiagram', 'erDiagram' FROM documents)""",
)
def q_diagram_syntax(spark, sf):
    df = _diagrams(spark, sf)
    kinds = df.select("corpus", "path", diagrams.kind_of(F.col("content")).alias("kind"))
    return quality.diagram_syntax(df).join(kinds, ["corpus", "path"])


@query(
    "q_inline_diagrams",
    """SELECT c_mktsegment AS corpus, concat('manual/p', c_custkey, '/02-screen-flow.md') AS path, CAST(b AS INTEGER) AS block_no,
         concat('p', c_custkey, '-screen-flow', CASE WHEN b > 0 THEN concat('-', b) ELSE '' END, '.mmd') AS name
       FROM customer, (SELECT unnest([0, 2]) AS b) WHERE c_nationkey < 12 AND NOT (b = 0 AND c_acctbal < 0)""",
)
def q_inline_diagrams(spark, sf):
    done = table(spark, sf, "customer").selectExpr("c_mktsegment AS corpus", "concat('diagrams/', CASE WHEN c_acctbal < 0 THEN 'p' ELSE 'old' END, c_custkey, '-screen-flow.mmd') AS path")
    return diagrams.inline_diagrams(i.INLINE_PAGES.df(spark, sf), done).drop("content")


@query(
    "q_diagram_links",
    """SELECT 'maps' AS corpus, concat('p/', c_custkey, '.md') AS path,
         concat('![a](../d/n', c_nationkey, CASE WHEN n_regionkey < 3 THEN '.svg' ELSE '.mmd' END, ') [b](x', c_custkey, '.mmd) ![s](q.svg)') AS content, n_regionkey < 3 AS rewritten
       FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def q_diagram_links(spark, sf):
    done = table(spark, sf, "nation").selectExpr("'maps' AS corpus", "concat(CASE WHEN n_regionkey < 3 THEN 'z/n' ELSE 'z/old' END, n_nationkey, '.mmd') AS path")
    return diagrams.rewrite_diagram_links(i.DIAGRAM_LINKS.df(spark, sf), done)


@query(
    "q_chunks",
    f"""WITH l AS (SELECT corpus, path, line_no - 3 AS n, count(*) OVER (PARTITION BY corpus, path) AS c, line FROM ({SEQ_LINES}) WHERE line_no > 3)
        SELECT corpus, path, CAST((n - 1) // 12 + 1 AS INTEGER) AS part_no, CAST(ceil(any_value(c) / 12) AS INTEGER) AS parts, CAST(count(*) AS INTEGER) AS messages FROM l GROUP BY corpus, path, (n - 1) // 12""",
)
def q_chunks(spark, sf):
    """Messages of every sequence diagram in parts of at most twelve."""
    df = tx.with_lines(i.MESSAGES.df(spark, sf)).select("corpus", "path", diagrams.messages().alias("items"))
    return diagrams.chunks(df, "items", 12).select("corpus", "path", "part_no", "parts", F.size("items").alias("messages"))


# --------------------------------------------------------------------------------------------- graphs

STAR_SQL = """
  SELECT DISTINCT r_name AS graph_id, concat('o', o_orderkey) AS src, concat('c', c_custkey) AS dst FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  UNION SELECT r_name, concat('c', c_custkey), concat('n', n_nationkey) FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  UNION SELECT r_name, concat('n', n_nationkey), r_name FROM nation JOIN region ON r_regionkey = n_regionkey"""


def _star(spark, sf):
    """Orders to customers to nations to regions, one graph per region."""
    t = lambda n: table(spark, sf, n)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    bought = t("orders").select("o_orderkey", "o_custkey").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    edge = lambda df, a, b: df.selectExpr("r_name AS graph_id", f"{a} AS src", f"{b} AS dst")
    return (
        edge(bought, "concat('o', o_orderkey)", "concat('c', c_custkey)")
        .unionByName(edge(buyers, "concat('c', c_custkey)", "concat('n', n_nationkey)"))
        .unionByName(edge(places, "concat('n', n_nationkey)", "r_name"))
    )


@query(
    "q_graph_depth",
    f"""WITH RECURSIVE e AS ({STAR_SQL}), w(graph_id, node, d) AS (SELECT DISTINCT graph_id, src, 1 FROM e WHERE (graph_id, src) NOT IN (SELECT graph_id, dst FROM e)
          UNION SELECT e.graph_id, e.dst, w.d + 1 FROM w JOIN e ON e.graph_id = w.graph_id AND e.src = w.node)
        SELECT graph_id, CAST(max(d) AS INTEGER) AS depth, false AS has_cycle FROM w GROUP BY graph_id""",
)
def q_graph_depth(spark, sf):
    return graph.depth(_star(spark, sf))


@query(
    "q_cycle_depth",
    """SELECT concat('r', r) AS graph_id, CAST(5 + CASE WHEN r IN (SELECT c_nationkey % 5 FROM customer) THEN 1 ELSE 0 END + CASE WHEN r IN (SELECT s_nationkey % 5 FROM supplier) THEN 1 ELSE 0 END AS INTEGER) AS depth, true AS has_cycle
       FROM (SELECT DISTINCT n_nationkey % 5 AS r FROM nation)""",
)
def q_cycle_depth(spark, sf):
    """Rings of five nations, with customers above them and suppliers below."""
    ring = table(spark, sf, "nation").selectExpr("concat('r', n_nationkey % 5) AS graph_id", "concat('n', n_nationkey) AS src", "concat('n', (n_nationkey + 5) % 25) AS dst")
    above = table(spark, sf, "customer").selectExpr("concat('r', c_nationkey % 5) AS graph_id", "concat('c', c_custkey) AS src", "concat('n', c_nationkey) AS dst")
    below = table(spark, sf, "supplier").selectExpr("concat('r', s_nationkey % 5) AS graph_id", "concat('n', s_nationkey) AS src", "concat('s', s_suppkey) AS dst")
    return graph.depth(ring.unionByName(above).unionByName(below))


@query(
    "q_graph_degree",
    f"""WITH e AS ({STAR_SQL}), b AS (SELECT graph_id, src AS node, dst AS near FROM e UNION SELECT graph_id, dst, src FROM e)
        SELECT graph_id, node, count(*) AS degree FROM b GROUP BY ALL""",
)
def q_graph_degree(spark, sf):
    return graph.hubs_first(graph.degrees(_star(spark, sf), ["graph_id"]))


WORD_EDGES = """
  w AS (SELECT doc_id, string_split_regex(text, '[ \n]+') AS w FROM documents),
  n AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 1)) AS k FROM w),
  e AS (SELECT DISTINCT doc_id, w[k] AS src, w[k + 1] AS dst FROM n WHERE w[k] <> w[k + 1])"""


def _word_graph(texts):
    """A graph per document: each word of its text leads to the next word."""
    df = texts.withColumn("w", F.split("text", "[ \n]+", -1))
    pairs = F.zip_with(F.expr("slice(w, 1, greatest(size(w) - 1, 0))"), F.expr("slice(w, 2, greatest(size(w) - 1, 0))"), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    return df.withColumn("edges", F.filter(pairs, lambda e: e["src"] != e["dst"])).drop("w", "text")


def _texts(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def _clustered_words(spark, sf):
    """Graphs of words with ``numbers``, their clusters of at most eight nodes; all of a document in one partition.

    Texts are dealt by document with the numbers alone, once: edges and names of nodes are taken from the text again after that.
    """
    texts = _texts(spark, sf).where("doc_id IS NOT NULL")
    numbers = graph.cluster_numbers(F.col("edges"), 8)
    found = _word_graph(texts.withColumn("held", F.col("text"))).select("doc_id", F.col("held").alias("text"), numbers.alias("numbers"))
    dealt = by_key(found, "doc_id", least=16 * texts.rdd.getNumPartitions())
    # a text without numbers has no edges; with that, edges and clusters are read from the same shuffle
    return _word_graph(dealt).withColumn("edges", F.when(F.size("numbers") > 0, F.col("edges")))


def _word_edges(g):
    return g.select("doc_id", F.inline_outer("edges")).where("src IS NOT NULL").distinct()


@query("q_graph_clusters")
def q_graph_clusters(spark, sf):
    """Clusters of at most eight nodes; the order of the walk has no SQL form, see q_cluster_totals and the tests."""
    return graph.clusters(_word_graph(_texts(spark, sf)), "edges", 8, ["doc_id"])


@query(
    "q_cluster_totals",
    f"""WITH {WORD_EDGES}, m AS (SELECT doc_id, src AS node FROM e UNION SELECT doc_id, dst FROM e)
        SELECT doc_id, count(*) AS nodes, true AS each_once, true AS within_cap, true AS numbered FROM m GROUP BY doc_id""",
)
def q_cluster_totals(spark, sf):
    """What must hold of the clusters of a document: every node in one, none too large, numbers without gaps."""
    c = by_key(graph.clusters(_word_graph(_texts(spark, sf)), "edges", 8, ["doc_id"]).where("doc_id IS NOT NULL"), "doc_id")
    # clusters are worked out once and shuffled once, by document
    sizes = c.groupBy("doc_id", "cluster_no").agg(F.count("*").alias("n"), F.collect_list("node").alias("members"))
    of = sizes.groupBy("doc_id").agg(
        F.sum("n").alias("n"), F.max("n").alias("largest"), F.count("*").alias("clusters"), F.max("cluster_no").alias("last"),
        F.size(F.array_distinct(F.flatten(F.collect_list("members")))).cast("long").alias("nodes"),
    )
    return of.select(
        "doc_id", "nodes", (F.col("nodes") == F.col("n")).alias("each_once"), ((F.col("largest") <= 8) & (F.col("clusters") * 8 >= F.col("nodes"))).alias("within_cap"),
        (F.col("last") == F.col("clusters")).alias("numbered"),
    )


@query("q_cut_edges")
def q_cut_edges(spark, sf):
    g = _clustered_words(spark, sf)
    return graph.cut_edges(_word_edges(g), graph.clusters(g, "edges", 8, ["doc_id"], "numbers"), ["doc_id"])


@query("q_cut_totals", f"WITH {WORD_EDGES} SELECT doc_id, count(*) AS edges, true AS kept_inside FROM e GROUP BY doc_id")
def q_cut_totals(spark, sf):
    """Edges of each document, and whether as many are kept as there are edges among the pairs of nodes of a cluster."""
    g = _clustered_words(spark, sf)
    edges, assigned = _word_edges(g), graph.clusters(g, "edges", 8, ["doc_id"], "numbers")
    cut = graph.cut_edges(edges, assigned, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("edges"), F.count_if(~F.col("is_cut")).alias("kept"))
    # the nodes of each cluster, and the ends of the edges that start in it
    starts = graph.with_clusters(edges, assigned, ["doc_id"], "src", "cluster_no").select("doc_id", "cluster_no", F.lit(None).cast("string").alias("node"), "dst")
    both = assigned.withColumn("dst", F.lit(None).cast("string")).unionByName(starts)
    members = both.groupBy("doc_id", "cluster_no").agg(F.collect_list("node").alias("all"), F.collect_list("dst").alias("ends"))
    # an edge counts for each pair of its nodes; the pairs are not written out
    times = F.size(F.filter("all", lambda n: n == F.col("dst")))
    ends = members.select("doc_id", "all", F.explode("ends").alias("dst"))
    inside = ends.groupBy("doc_id").agg(F.sum(times).alias("inside"))
    kept_inside = F.col("kept") == F.coalesce("inside", F.lit(0))
    return cut.join(inside, "doc_id", "left").select("doc_id", "edges", kept_inside.alias("kept_inside"))


NETWORK = """
  e AS (SELECT concat('c', o_custkey) AS src, concat('o', o_orderkey) AS dst FROM orders
        UNION SELECT concat('n', c_nationkey), concat('c', c_custkey) FROM customer
        UNION SELECT concat('s', s_suppkey), concat('n', s_nationkey) FROM supplier)"""


def _network(spark, sf):
    """Orders, customers, suppliers and nations as one graph."""
    edges = table(spark, sf, "orders").selectExpr("concat('c', o_custkey) AS src", "concat('o', o_orderkey) AS dst")
    edges = edges.union(table(spark, sf, "customer").selectExpr("concat('n', c_nationkey)", "concat('c', c_custkey)"))
    return edges.union(table(spark, sf, "supplier").selectExpr("concat('s', s_suppkey)", "concat('n', s_nationkey)")).distinct()


@query(
    "q_network_clusters",
    f"""WITH {NETWORK}, m AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
        SELECT left(node, 1) AS kind, count(*) AS nodes, true AS each_once, true AS within_cap, true AS connected FROM m GROUP BY 1""",
)
def q_network_clusters(spark, sf):
    """Clusters of at most 40 nodes of one large graph: all nodes are in one, and the edges inside connect each."""
    edges = stored(_network(spark, sf))
    clusters = stored(graph_tables.grow_clusters(edges, 40))
    parts = graph_tables.cluster_parts(edges, clusters)
    each = clusters.groupBy("node").agg(F.count("*").alias("times"), F.max("cluster").alias("cluster")).join(parts, "cluster")
    return each.groupBy(F.left("node", F.lit(1)).alias("kind")).agg(
        F.count("*").alias("nodes"), (F.max("times") == 1).alias("each_once"), (F.max("nodes") <= 40).alias("within_cap"), (F.max("parts") == 1).alias("connected")
    )


@query(
    "q_chain_depth",
    """SELECT concat('g', g) AS graph_id, CAST(max(n) AS INTEGER) AS depth, false AS has_cycle FROM (
         SELECT g, count(*) AS n FROM (SELECT o_orderkey // 100 AS g, o_orderkey - row_number() OVER (ORDER BY o_orderkey) AS island FROM orders) GROUP BY g, island)
       GROUP BY g HAVING max(n) > 1""",
)
def q_chain_depth(spark, sf):
    """Each order leads to the one with the next number, in graphs of a hundred numbers: chains as long as that."""
    orders = table(spark, sf, "orders").selectExpr("concat('g', o_orderkey div 100) AS graph_id", "o_orderkey")
    before = orders.selectExpr("graph_id", "o_orderkey - 1 AS o_orderkey", "o_orderkey AS next")
    edges = orders.join(before, ["graph_id", "o_orderkey"])
    return graph.depth(edges.selectExpr("graph_id", "CAST(o_orderkey AS STRING) AS src", "CAST(next AS STRING) AS dst"))


@query(
    "q_line_degrees",
    f"""WITH {WORD_EDGES}, b AS (SELECT doc_id, src AS node, dst AS near FROM e UNION SELECT doc_id, dst, src FROM e)
        SELECT doc_id, node, count(*) AS degree FROM b GROUP BY ALL""",
)
def q_line_degrees(spark, sf):
    return graph.degrees(_word_edges(_word_graph(by_key(table(spark, sf, "documents").select("doc_id", "text"), "doc_id"))), ["doc_id"])


# --------------------------------------------------------------------------------------------- labels

I18N = [("der", "THE"), ("THE ", "the_"), ("die", "DIE"), ("sch", "S"), ("que", "k"), ("ou", "U")]
I18N_SQL = "text"
for _a, _b in I18N:
    I18N_SQL = f"replace({I18N_SQL}, '{_a}', '{_b}')"


@query("q_i18n", f"SELECT source AS corpus, concat(lang, '/', doc_id, '.txt') AS path, {I18N_SQL} AS content, {I18N_SQL} <> text AS modified FROM documents")
def q_i18n(spark, sf):
    return labels.translate(i.DOCUMENTS.df(spark, sf), I18N)


@query("q_i18n_totals", f"SELECT source AS corpus, count(*) AS files_processed, count(*) FILTER ({I18N_SQL} <> text) AS files_modified FROM documents GROUP BY source")
def q_i18n_totals(spark, sf):
    return labels.translation_totals(labels.translate(i.DOCUMENTS.df(spark, sf), I18N))


#: Pages with all labels of the fixed lists behind their own text.
LABEL_PAIRS = [*labels.BASE_LABELS["en"], *labels.DOCUMENT_LABELS["en"]]
LABELLED = "concat(content, chr(10), " + i.q(" / ".join(a for a, _ in LABEL_PAIRS)) + ")"
LABELLED_SQL = LABELLED
for _a, _b in LABEL_PAIRS:
    LABELLED_SQL = f"replace({LABELLED_SQL}, {i.q(_a)}, {i.q(_b)})"


@query("q_i18n_pages", f"SELECT corpus, path, {LABELLED_SQL} AS content FROM ({i.PROJECT_PAGES.sql()})")
def q_i18n_pages(spark, sf):
    pages = i.PROJECT_PAGES.df(spark, sf).selectExpr("corpus", "path", f"{LABELLED} AS content")
    return pages.select("corpus", "path", labels.translate_document(F.col("content"), "en").alias("content"))


LANG_SQL = """
  en AS (SELECT p_brand AS corpus, concat('lang/ja/f', p_partkey, '.json') AS path, 0 AS seq, concat('a.', p_type) AS key, concat('V', p_partkey) AS value FROM part WHERE p_size > 25 AND p_size <= 40
         UNION ALL SELECT p_brand, concat('lang/ja/f', p_partkey, '.json'), 1, 't', p_name FROM part WHERE p_size > 25 AND p_size <= 40
         UNION ALL SELECT p_brand, concat('languages/ja_jp/f', p_partkey, '.js'), 0, p_type, p_name FROM part WHERE p_size > 15 AND p_size <= 25
         UNION ALL SELECT p_brand, concat('languages/ja_jp/f', p_partkey, '.php'), 0, concat('SINGLE_', p_type), concat('S', p_partkey) FROM part WHERE p_size <= 15
         UNION ALL SELECT p_brand, concat('languages/ja_jp/f', p_partkey, '.php'), 1, p_type, p_name FROM part WHERE p_size <= 15),
  lm AS (SELECT corpus, regexp_replace(key, '^SINGLE_', '') AS key, coalesce(max({'p': path, 's': seq, 'v': value}) FILTER (starts_with(key, 'SINGLE_')).v, max({'p': path, 's': seq, 'v': value}) FILTER (NOT starts_with(key, 'SINGLE_')).v) AS value FROM en GROUP BY ALL)"""


@query("q_language_entries", f"WITH {LANG_SQL} SELECT corpus, path, CAST(seq AS BIGINT) AS seq, key, value FROM en")
def q_language_entries(spark, sf):
    return labels.language_entries(i.LANGUAGE_FILES.df(spark, sf))


@query("q_label_map", f"WITH {LANG_SQL} SELECT * FROM lm")
def q_label_map(spark, sf):
    return labels.label_map(labels.language_entries(i.LANGUAGE_FILES.df(spark, sf)))


NODE_SQL = "concat(p_type, CASE WHEN p_size < 10 THEN '_List' WHEN p_size < 20 THEN '_ListView' WHEN p_size < 30 THEN '_Details' WHEN p_size < 40 THEN '' ELSE '_Zoo' END)"
LABEL_NODES = f"SELECT DISTINCT p_brand AS corpus, {NODE_SQL} AS node FROM part"


@query(
    "q_labels",
    f"""WITH {LANG_SQL}, n AS ({LABEL_NODES}), sx(s, t) AS (VALUES ('_List', ' 一覧'), ('_ListView', ' 一覧'), ('_Details', ' 詳細'), ('_Detail', ' 詳細'), ('', ''))
        SELECT corpus, node, arg_max(concat(value, t), CASE WHEN s = '' THEN 1000 ELSE length(s) END) AS label FROM n JOIN sx ON ends_with(node, s) JOIN lm USING (corpus)
        WHERE lm.key = left(node, length(node) - length(s)) GROUP BY ALL""",
)
def q_labels(spark, sf):
    nodes = table(spark, sf, "part").selectExpr("p_brand AS corpus", f"{NODE_SQL} AS node")
    return labels.resolve_labels(nodes, q_label_map(spark, sf))


@query(
    "q_bare_nodes",
    """SELECT DISTINCT corpus, path, node FROM (
         SELECT o_orderpriority AS corpus, concat('diagrams/s', o_orderkey, '.mmd') AS path, unnest([concat('N', o_custkey), o_orderstatus]) AS node FROM orders)""",
)
def q_bare_nodes(spark, sf):
    return labels.bare_nodes(i.STATES.df(spark, sf))


@query(
    "q_translate_diagrams",
    f"""WITH {LANG_SQL}, b AS (SELECT p_brand AS corpus, concat('d', p_partkey, '.mmd') AS path, p_type, lm.value AS v FROM part LEFT JOIN lm ON lm.corpus = p_brand AND lm.key = p_type)
        SELECT corpus, path, v IS NOT NULL AS modified, concat('flowchart LR', chr(10), '  ', p_type, CASE WHEN v IS NULL THEN '' ELSE concat('["', v, '"]') END, ' --> Other', chr(10), '  x["', coalesce(v, p_type), '"] --> y',
          chr(10), '  %% ', p_type, chr(10), '  ', p_type, '_List', CASE WHEN v IS NULL THEN '' ELSE concat('["', v, ' 一覧"]') END, ' --> z') AS content FROM b""",
)
def q_translate_diagrams(spark, sf):
    text = """concat('flowchart LR', chr(10), '  ', p_type, ' --> Other', chr(10), '  x["', p_type, '"] --> y', chr(10), '  %% ', p_type, chr(10), '  ', p_type, '_List --> z')"""
    df = spread(table(spark, sf, "part")).selectExpr("p_brand AS corpus", "concat('d', p_partkey, '.mmd') AS path", f"{text} AS content")
    return labels.translate_diagrams(df, q_label_map(spark, sf))


# ------------------------------------------------------------------------------- bundles and assembly

BUNDLE_SQL = """
  b AS (SELECT concat('c', conv_id) AS corpus, CAST(turn AS VARCHAR) AS bundle, role, turn, conv_id, concat(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''), chr(10)) AS body FROM conversations),
  f AS (SELECT corpus, bundle, 1 AS file_no, concat('docs/c', conv_id, '/t', turn, '.md') AS path, body AS content, concat('c', conv_id, '/t', turn, '.md') AS output_path FROM b
        UNION ALL SELECT corpus, bundle, 2, concat('../', role, '.md'), concat('未確認', chr(10)), NULL FROM b
        UNION ALL SELECT corpus, bundle, 3, concat('a/../', role, '/x.md'), concat('tail', chr(10)), concat(role, '/x.md') FROM b)"""


def _bundle_files(spark, sf):
    return bundles.split_bundles(i.BUNDLES.df(spark, sf).withColumnRenamed("path", "bundle"), ["corpus", "bundle"])


@query("q_bundle_split", f"WITH {BUNDLE_SQL} SELECT corpus, bundle, CAST(file_no AS INTEGER) AS file_no, path, content, output_path FROM f WHERE output_path IS NOT NULL")
def q_bundle_split(spark, sf):
    return bundles.accepted(_bundle_files(spark, sf))


@query(
    "q_chunk_bundles",
    f"""WITH b AS (SELECT corpus, string_agg(content, '' ORDER BY block, seq) AS content FROM ({i.BUNDLE_CHUNKS.sql()}) GROUP BY corpus),
          f AS (SELECT corpus, regexp_extract_all(content, '--- FILE: (.+?) ---', 1) AS names, string_split_regex(content, '--- FILE: .+? ---') AS bodies FROM b),
          u AS (SELECT *, unnest(generate_series(1, len(names))) AS k FROM f)
        SELECT corpus, 'all' AS bundle, CAST(k AS BIGINT) AS file_no, names[k] AS path,
          concat(regexp_replace(regexp_replace(bodies[k + 1], '^\\s+', ''), '\\s+$', ''), chr(10)) AS content FROM u""",
)
def q_chunk_bundles(spark, sf):
    """Files of bundles that come in chunks: a file starts in one turn of a conversation and goes on in the next ones."""
    return chunks.join_pieces(chunks.split_bundle_chunks(i.BUNDLE_CHUNKS.df(spark, sf)))


@query("q_bundle_rejects", f"WITH {BUNDLE_SQL} SELECT corpus, count(*) AS rejected, CAST(count(*) AS BIGINT) AS unconfirmed FROM f WHERE output_path IS NULL GROUP BY corpus")
def q_bundle_rejects(spark, sf):
    bad = bundles.rejects(_bundle_files(spark, sf))
    return bad.groupBy("corpus").agg(F.count("*").alias("rejected"), F.sum(F.regexp_count("content", F.lit(quality.UNCONFIRMED))).alias("unconfirmed"))


@query(
    "q_delimited",
    """SELECT concat('c', c_custkey) AS corpus, 1 AS row_no, c_name AS table_name, CAST(c_nationkey AS BIGINT) AS rows, '' AS note FROM customer
       UNION ALL SELECT concat('c', c_custkey), 2, c_mktsegment, NULL, 'n' FROM customer""",
)
def q_delimited(spark, sf):
    out = bundles.split_delimited(i.OUTPUTS.df(spark, sf), ["corpus"])
    get = lambda k: F.element_at("record", k)
    return out.select("corpus", "row_no", get("table_name").alias("table_name"), tx.safe_integer(get("rows")).alias("rows"), get("note").alias("note"))


MERGE_SQL = f"""
  c AS (SELECT corpus, path, content, regexp_extract(path, '[^/]*$') AS name, starts_with(path, 'features/') AS ft FROM ({i.CHAPTERS.sql()})),
  k AS (SELECT *, CASE WHEN ft THEN '03-features.md' ELSE name END AS chapter FROM c WHERE NOT ft OR corpus IN (SELECT corpus FROM c WHERE path = '03-features.md')),
  t AS (SELECT *, trim(regexp_extract(content, '(?m)^#[\\s]+(.+)', 1)) AS h FROM k),
  bl AS (SELECT corpus, 3 AS part, chapter, ft, name, concat(chr(10), '---', chr(10), chr(10), regexp_replace(content, '\\s+$', '')) AS block FROM t
         UNION ALL SELECT corpus, 1, chapter, ft, name, concat('- ', CASE WHEN h <> '' THEN h ELSE regexp_replace(name, '[.]md$', '') END) FROM t
         UNION ALL SELECT corpus, p, k.chapter, k.ft, k.name, b FROM (SELECT corpus, min({{'chapter': chapter, 'ft': ft, 'name': name}}) AS k FROM t GROUP BY corpus),
           (VALUES (0, concat('# Table of Contents', chr(10))), (2, '')) v(p, b))"""


@query("q_toc_merge", f"WITH {MERGE_SQL} SELECT corpus, CAST(part AS INTEGER) AS part, chapter, ft AS is_feature, name, block FROM bl")
def q_toc_merge(spark, sf):
    blocks = assemble.in_order(assemble.merged_blocks(i.CHAPTERS.df(spark, sf)))
    return blocks.select("corpus", "part", "key.chapter", "key.is_feature", "key.name", "block")


NAV_SQL = f"""SELECT corpus, project, CAST(section_rank AS INTEGER) AS section_rank, section, CAST(rank AS INTEGER) AS rank, title, path FROM (
  SELECT p.*, n.* EXCLUDE (re) FROM (SELECT corpus, path, {i.PROJECT} AS project FROM (SELECT *, {i.PROJECT_PAGES.columns['corpus']} AS corpus, {i.PROJECT_PAGES.columns['path']} AS path FROM customer)) p
  JOIN (VALUES ('^[^/]+-index[.]md$', 1, 'index', 0, '目次'), ('^architecture/', 2, 'Architecture', 0, 'arc42 ドキュメント'), ('/00-index[.]md$', 3, 'Manual', 0, 'マニュアル目次'),
    ('/01-overview', 3, 'Manual', 1, 'システム概要'), ('/02-screen-flow', 3, 'Manual', 2, '画面遷移図'), ('/03-features', 3, 'Manual', 3, '機能カタログ'), ('/04-api', 3, 'Manual', 104, 'APIリファレンス'),
    ('/05-data', 3, 'Manual', 105, 'データモデル'), ('/06-screen', 3, 'Manual', 106, '画面詳細設計'), ('/07-walk', 3, 'Manual', 107, 'ウォークスルー'), ('/08-review', 3, 'Manual', 108, '設計評価'),
    ('/pro[.]md$', 5, 'Explanations', 1, 'エンジニア向け'), ('/sales[.]md$', 5, 'Explanations', 2, '営業向け'), ('/beginner[.]md$', 5, 'Explanations', 3, '初心者向け'), ('^decisions/', 6, 'decisions', 0, '意思決定記録')
  ) n(re, section_rank, section, rank, title) ON regexp_matches(p.path, n.re))"""


@query("q_navigation", NAV_SQL)
def q_navigation(spark, sf):
    return assemble.navigation(i.PROJECT_PAGES.df(spark, sf)).orderBy("corpus", "project", "section_rank", "rank", "path")


@query(
    "q_export_pages",
    """SELECT source AS corpus, concat(lang, '/', doc_id, '.txt') AS path, concat(lang, '_', doc_id, '.md') AS page_name,
         regexp_replace(regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+', ''), '\\s+$', '') AS content FROM documents""",
)
def q_export_pages(spark, sf):
    return assemble.export_pages(i.DOCUMENTS.df(spark, sf))


@query("q_export_index", "SELECT source AS corpus, concat(lang, '_', doc_id, '.md') AS page_name, concat('- [', lang, ' / ', doc_id, '](', lang, '_', doc_id, '.md)') AS line FROM documents")
def q_export_index(spark, sf):
    return assemble.export_index(assemble.export_pages(i.DOCUMENTS.df(spark, sf)))


@query(
    "q_window_links",
    """SELECT s_suppkey, concat('![a](x', s_suppkey, '.svg)', chr(10), '<a href="x', s_suppkey, '.svg" target="_blank">🔍 別ウィンドウで開く</a>',
         CASE WHEN s_acctbal < 5000 THEN '' ELSE concat(' ![b](y.svg)', chr(10), '<a href="y.svg">old</a>') END) AS page FROM supplier""",
)
def q_window_links(spark, sf):
    text = "concat('![a](x', s_suppkey, '.svg)', CASE WHEN s_acctbal < 5000 THEN '' ELSE concat(' ![b](y.svg)', chr(10), '<a href=\"y.svg\">old</a>') END)"
    return table(spark, sf, "supplier").select("s_suppkey", diagrams.with_window_links(F.expr(text)).alias("page"))


# --------------------------------------------------------------------------------- modules and facts

MODULE_SQL = f"""
  f AS (SELECT DISTINCT concat('s', p_size) AS corpus, concat(p_name, ' View') AS feature FROM part WHERE p_type = 'PROMO' UNION SELECT concat('s', p_size), p_type FROM part WHERE false),
  d AS (SELECT DISTINCT corpus, name FROM ({i.DISABLED.sql()}))"""


@query("q_feature_names", f"WITH {MODULE_SQL}, o AS (SELECT DISTINCT concat('s', p_size) AS corpus, p_type AS feature FROM part) SELECT * FROM f UNION SELECT * FROM o")
def q_feature_names(spark, sf):
    return modules.feature_names(i.FEATURES.df(spark, sf))


@query(
    "q_modules",
    f"""WITH {MODULE_SQL}, a AS (SELECT * FROM f UNION SELECT DISTINCT concat('s', p_size), p_type FROM part)
        SELECT 'module' AS "check", corpus, CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.corpus = d.corpus AND contains(lower(a.feature), lower(d.name))) THEN 'FAIL' ELSE 'OK' END AS status, name AS label,
          CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.corpus = d.corpus AND contains(lower(a.feature), lower(d.name))) THEN 'disabled but listed' ELSE '' END AS message FROM d""",
)
def q_modules(spark, sf):
    return modules.verify_modules(modules.feature_names(i.FEATURES.df(spark, sf)), i.DISABLED.df(spark, sf))


@query(
    "q_module_pages",
    f"""WITH {MODULE_SQL} SELECT DISTINCT d.corpus, p.path, lower(d.name) AS name FROM d JOIN ({i.FEATURES.sql()}) p ON p.corpus = d.corpus
        AND regexp_matches(lower(p.content), concat('\\b', lower(d.name), '\\b'))""",
)
def q_module_pages(spark, sf):
    return modules.modules_in_pages(i.FEATURES.df(spark, sf), i.DISABLED.df(spark, sf))


@query(
    "q_disabled_routes",
    f"""WITH {MODULE_SQL}, r AS (SELECT concat('s', p_size) AS corpus, concat('/', replace(p_name, ' ', '/'), '/', p_partkey) AS path, p_type AS name FROM part)
        SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.corpus = r.corpus AND (lower(d.name) = lower(r.name) OR list_contains(string_split(lower(r.path), '/'), lower(d.name))))""",
)
def q_disabled_routes(spark, sf):
    routes = table(spark, sf, "part").selectExpr("concat('s', p_size) AS corpus", "concat('/', replace(p_name, ' ', '/'), '/', p_partkey) AS path", "p_type AS name")
    return modules.drop_disabled_routes(routes, i.DISABLED.df(spark, sf))


def _facts(spark, sf):
    facts = table(spark, sf, "lineitem").selectExpr("l_returnflag AS corpus", "l_linestatus AS category", "concat('p', l_partkey) AS name")
    docs = table(spark, sf, "orders").selectExpr("CASE o_orderstatus WHEN 'P' THEN 'A' ELSE 'N' END AS corpus", "o_orderstatus AS category", "concat('p', o_orderkey) AS name")
    return facts, docs


@query(
    "q_reconcile",
    """SELECT corpus, category, coalesce(f, 0) AS fact_count, coalesce(d, 0) AS doc_count, coalesce(f, 0) = coalesce(d, 0) AS matches
       FROM (SELECT l_returnflag AS corpus, l_linestatus AS category, count(*) AS f FROM lineitem GROUP BY ALL)
       FULL JOIN (SELECT CASE o_orderstatus WHEN 'P' THEN 'A' ELSE 'N' END AS corpus, o_orderstatus AS category, count(*) AS d FROM orders GROUP BY ALL) USING (corpus, category)""",
)
def q_reconcile(spark, sf):
    return reconcile.reconcile_counts(*_facts(spark, sf))


@query(
    "q_unknown_names",
    """SELECT DISTINCT CASE o_orderstatus WHEN 'P' THEN 'A' ELSE 'N' END AS corpus, concat('p', o_orderkey) AS name FROM orders
       EXCEPT SELECT l_returnflag, concat('p', l_partkey) FROM lineitem""",
)
def q_unknown_names(spark, sf):
    facts, docs = _facts(spark, sf)
    return reconcile.unknown_names(docs, facts)


TIER_SQL = "SELECT p_brand AS corpus, concat(CASE WHEN p_type = 'SMALL' THEN 'x' ELSE '' END, p_partkey) AS name, CASE WHEN p_size < 14 THEN 'tier1' WHEN p_size < 37 THEN 'tier2' ELSE 'tier3' END AS tier FROM part"


def _tiers(spark, sf):
    tier = "CASE WHEN p_size < 14 THEN 'tier1' WHEN p_size < 37 THEN 'tier2' ELSE 'tier3' END AS tier"
    return table(spark, sf, "part").selectExpr("p_brand AS corpus", "concat(CASE WHEN p_type = 'SMALL' THEN 'x' ELSE '' END, p_partkey) AS name", tier)


@query(
    "q_tier_coverage",
    f"""WITH t AS ({TIER_SQL}), m AS (SELECT p_brand AS corpus, CAST(p_partkey AS VARCHAR) AS name, p_size <> 7 AS active FROM part)
        SELECT corpus, name, CASE WHEN active IS NULL THEN 'not in facts' WHEN active THEN 'active but in no tier' ELSE 'disabled but in a tier' END AS problem FROM m FULL JOIN t USING (corpus, name)
        WHERE active IS NULL OR (active AND tier IS NULL) OR (NOT active AND tier IS NOT NULL)""",
)
def q_tier_coverage(spark, sf):
    mods = table(spark, sf, "part").selectExpr("p_brand AS corpus", "CAST(p_partkey AS STRING) AS name", "p_size <> 7 AS active")
    return reconcile.tier_coverage(mods, _tiers(spark, sf))


@query(
    "q_tiers",
    f"""WITH s AS (SELECT corpus, count(*) AS features, round(count(*) FILTER (tier = 'tier1') * 100.0 / count(*), 6)::DOUBLE AS tier1_pct, round(count(*) FILTER (tier = 'tier2') * 100.0 / count(*), 6)::DOUBLE AS tier2_pct,
            round(count(*) FILTER (tier = 'tier3') * 100.0 / count(*), 6)::DOUBLE AS tier3_pct FROM ({TIER_SQL}) GROUP BY corpus)
        SELECT *, tier1_pct BETWEEN 20 AND 30 AND tier2_pct BETWEEN 40 AND 50 AND tier3_pct BETWEEN 20 AND 30 AS in_bands, tier1_pct > 40 AS tier1_too_large, tier3_pct = 0 AS tier3_empty FROM s""",
)
def q_tiers(spark, sf):
    return reconcile.tier_distribution(_tiers(spark, sf))


AXIS_OF = "CASE l_linenumber WHEN 1 THEN 'accuracy' WHEN 2 THEN 'coverage' WHEN 3 THEN 'depth' WHEN 4 THEN 'structure' WHEN 5 THEN 'usability' WHEN 6 THEN 'business' ELSE 'modules' END"
KIND_OF = "CASE l_returnflag WHEN 'A' THEN 'manual' WHEN 'N' THEN 'rag' ELSE 'slide' END"


@query(
    "q_weighted",
    f"""WITH w(deliverable, axis, w) AS (VALUES ('manual', 'accuracy', 25), ('manual', 'coverage', 25), ('manual', 'depth', 10), ('manual', 'structure', 10), ('manual', 'usability', 20), ('manual', 'business', 0), ('manual', 'modules', 10),
          ('rag', 'accuracy', 30), ('rag', 'coverage', 20), ('rag', 'depth', 5), ('rag', 'structure', 20), ('rag', 'usability', 15), ('rag', 'business', 0), ('rag', 'modules', 10),
          ('slide', 'accuracy', 20), ('slide', 'coverage', 15), ('slide', 'depth', 10), ('slide', 'structure', 10), ('slide', 'usability', 25), ('slide', 'business', 10), ('slide', 'modules', 5)),
          s AS (SELECT concat('o', l_orderkey) AS corpus, {KIND_OF} AS deliverable, {AXIS_OF} AS axis, CAST(l_quantity AS INT) AS score FROM lineitem)
        SELECT corpus, deliverable, round(sum(w * score) / 100.0, 6)::DOUBLE AS weighted FROM s JOIN w USING (deliverable, axis) GROUP BY ALL""",
)
def q_weighted(spark, sf):
    scores = table(spark, sf, "lineitem").selectExpr("concat('o', l_orderkey) AS corpus", f"{KIND_OF} AS deliverable", f"{AXIS_OF} AS axis", "CAST(l_quantity AS INT) AS score")
    out = reconcile.weighted_scores(scores)
    return out.withColumn("weighted", F.col("weighted").cast("double"))
