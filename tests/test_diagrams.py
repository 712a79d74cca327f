import random
import re

from pyspark.sql import functions as F

from corpusaudit.functions import text as tx
from corpusaudit.operators import assemble, diagrams, graph, labels, reconcile
from tests.conftest import rows

EDGES = "graph_id STRING, src STRING, dst STRING"


def simple_depth(pairs):
    """Longest chain by brute force; an edge into the chain ends it."""
    below = {}
    for s, d in pairs:
        below.setdefault(s, set()).add(d)
    heads = set(below) - {d for _, d in pairs} or set(below)

    def go(n, seen):
        return 1 + max((go(c, seen | {c}) for c in below.get(n, ()) if c not in seen), default=0)

    return max(go(h, {h}) for h in heads)


def test_depth_tables(spark):
    e = [("chain", f"n{i}", f"n{i + 1}") for i in range(3)] + [("cycle", "a", "b"), ("cycle", "b", "a")]
    e += [("dia", "a", "b"), ("dia", "a", "c"), ("dia", "b", "d"), ("dia", "c", "d"), ("dia", "d", "e")]
    e += [("long", f"{i}", f"{i + 1}") for i in range(30)]
    got = {r.graph_id: (r.depth, r.has_cycle) for r in graph.depth(spark.createDataFrame(e, EDGES)).collect()}
    assert got == {"chain": (4, False), "cycle": (2, True), "dia": (4, False), "long": (31, False)}
    assert graph.depth(spark.createDataFrame([], EDGES)).count() == 0


def folded_depth(edges):
    """Longest chain, nodes that reach each other counted together, by closure and all orders."""
    nodes = {n for e in edges for n in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    part = {n: frozenset(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    best = lambda p: len(p) + max((best(part[b]) for a, b in edges if a in p and b not in p), default=0)
    return max(map(best, part.values()))


def test_depth_with_cycles(spark):
    rng = random.Random(8)
    graphs = {f"g{g}": {(f"n{a}", f"n{b}") for a, b in (rng.choices(range(9), k=2) for _ in range(rng.randint(1, 13)))} for g in range(40)}
    graphs |= {"abc": {("A", "B"), ("B", "C"), ("C", "A")}, "two": {("A", "B"), ("B", "C"), ("C", "B"), ("P", "Q"), ("Q", "C")}, "self": {("A", "A")}}
    df = spark.createDataFrame([(g, s, d) for g, es in graphs.items() for s, d in es], EDGES)
    inrow = df.groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst")).alias("e")).select("graph_id", graph.chain_depth("e").alias("d"))
    want = {g: folded_depth(es) for g, es in graphs.items()}
    assert want["abc"] == 3 and want["two"] == 4 and want["self"] == 1
    assert {r.graph_id: r.d for r in inrow.collect()} == want
    got = {r.graph_id: (r.depth, r.has_cycle) for r in graph.depth(df).collect()}
    assert {g: d for g, (d, _) in got.items()} == want
    cyclic = lambda es: any(a == b for a, b in es) or folded_depth(es) > len({n for e in es for n in e}) or _has_cycle(es)
    assert {g: c for g, (_, c) in got.items()} == {g: cyclic(es) for g, es in graphs.items()}


def _has_cycle(edges):
    left = set(edges)
    while left:
        kept = {(a, b) for a, b in left if any(y == a for _, y in left)}
        if kept == left:
            return True
        left = kept
    return False


def test_depth_in_row_matches_brute_force_and_tables(spark):
    rng = random.Random(5)
    graphs = {f"g{g}": {(f"n{a}", f"n{b}") for a, b in (sorted(rng.sample(range(9), 2)) for _ in range(10))} for g in range(20)}
    flat = [(g, s, d) for g, es in graphs.items() for s, d in es]
    df = spark.createDataFrame(flat, EDGES)
    inrow = df.groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst")).alias("e")).select("graph_id", graph.chain_depth("e").alias("d"))
    a = {r.graph_id: r.d for r in inrow.collect()}
    b = {r.graph_id: r.depth for r in graph.depth(df).collect()}
    assert a == b == {g: simple_depth(es) for g, es in graphs.items()}


def test_clusters(spark):
    hub = [("hub", "h", f"x{i}") for i in range(20)] + [("two", "a", "b"), ("two", "c", "d")]
    df = spark.createDataFrame(hub, EDGES)
    g = df.groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst")).alias("e"))
    got = graph.clusters(g, "e", 8, ["graph_id"]).cache()
    assert got.count() == 25 and got.select("graph_id", "node").distinct().count() == 25
    assert got.groupBy("graph_id", "cluster_no").count().agg(F.max("count")).collect()[0][0] == 8
    assert rows(got.where("graph_id='two'"), "node", "cluster_no") == [("a", 1), ("b", 1), ("c", 2), ("d", 2)]
    assert graph.cut_edges(df, got, ["graph_id"]).where("is_cut").count() == 13
    assert graph.hubs_first(graph.degrees(df, ["graph_id"])).first().degree == 20


FLOW = "flowchart LR\n  subgraph A[x]\n    a1 --> a2\n  end\n  subgraph B\n    b1\n  end\n  a2 --> b1\n  b1 --> z\n"


def test_edges_and_groups(files):
    df = files(("c", "f.mmd", FLOW), ("c", "s.mmd", "stateDiagram-v2\n [*] --> S1\n S1 --> S2\n"), ("c", "e.mmd", "erDiagram\n  U ||--o{ O : x\n"))
    assert rows(diagrams.edges(df), "path", "kind", "src", "dst") == [
        ("e.mmd", "erDiagram", "U", "O"), ("f.mmd", "flowchart", "a1", "a2"), ("f.mmd", "flowchart", "a2", "b1"),
        ("f.mmd", "flowchart", "b1", "z"), ("s.mmd", "stateDiagram", "S1", "S2"), ("s.mmd", "stateDiagram", "[*]", "S1"),
    ]
    flow = df.where("path = 'f.mmd'")
    grouped = diagrams.group_edges(diagrams.edges(flow), diagrams.members(flow))
    assert rows(grouped, "src", "dst", "src_group", "dst_group") == [("a1", "a2", "A", "A"), ("a2", "b1", "A", "B"), ("b1", "z", "B", None)]
    assert rows(diagrams.overview_edges(grouped), "src", "dst") == [("A", "B"), ("B", "z")]


def test_chunks(spark):
    df = spark.createDataFrame([("c", "p", [str(i) for i in range(7)])], "corpus STRING, path STRING, items ARRAY<STRING>")
    assert rows(diagrams.chunks(df, "items", 3), "part_no", "parts", "items") == [(1, 3, ["0", "1", "2"]), (2, 3, ["3", "4", "5"]), (3, 3, ["6"])]


def test_inline_and_links(files):
    md = "```mermaid\nstateDiagram-v2\na\n```\n```mermaid\nnope\n```\n```mermaid\ngraph LR\nb\n```"
    docs = files(("c", "manual/app/02-screen-flow.md", md), ("c", "architecture/app.md", "```mermaid\ngraph TD\n```"), ("c", "other/x.md", md))
    assert rows(diagrams.inline_diagrams(docs), "name") == [("app-architecture.mmd",), ("app-screen-flow-2.mmd",), ("app-screen-flow.mmd",)]
    there = files(("c", "diagrams/app-screen-flow.mmd", ""))
    assert diagrams.inline_diagrams(docs, there).count() == 2
    page = files(("c", "p.md", "![a](d/foo.mmd) [x](x-foo.mmd) (foo.mmd) ![s](q.svg)"))
    conv = files(("c", "z/foo.mmd", ""))
    assert rows(diagrams.rewrite_diagram_links(page, conv), "content", "rewritten") == [("![a](d/foo.svg) [x](x-foo.mmd) (foo.svg) ![s](q.svg)", True)]
    out = diagrams.rewrite_diagram_links(page, conv, add_window_link=True).collect()[0].content
    assert out.count("別ウィンドウで開く") == 2
    again = files(("c", "p.md", out))
    assert diagrams.rewrite_diagram_links(again, conv, add_window_link=True).collect()[0].rewritten is False


def test_language_entries(files):
    df = files(
        ("c", "languages/ja_jp/a.php", "$languageStrings['SINGLE_User'] = '利用者'; $languageStrings['User'] = '人'; 'Order' => '注文',"),
        ("c", "lang/ja/b.json", '{"a": {"b": "X", "n": 1, "c": {"d": "Y"}}, "t": "Z"}'), ("c", "lang/ja/bad.json", "{no"),
        ("c", "locales/ja/c.js", "export default { 'Item': '品' }"), ("c", "locales/en/c.js", "'x': 'y'"),
    )
    e = labels.language_entries(df)
    assert rows(e, "key", "value") == [
        ("Item", "品"), ("Order", "注文"), ("SINGLE_User", "利用者"), ("User", "人"), ("a.b", "X"), ("a.c.d", "Y"), ("t", "Z"),
    ]
    assert ("c", "User", "利用者") in rows(labels.label_map(e))


def test_labels(files, spark):
    lab = spark.createDataFrame([("c", "User", "利用者"), ("c", "Order", "注文"), ("c", "User_List", "名簿")], "corpus STRING, key STRING, value STRING")
    mmd = 'flowchart TB\n  User --> Order_Detail\n  %% User\n  X["User"] --> Order\n  User_List --> User_ListView\n  end --> TB\n'
    df = files(("c", "a.mmd", mmd), ("c", "b.mmd", 'stateDiagram\n  state "Order" as o1\n  [*] --> Zzz'))
    nodes = labels.bare_nodes(df)
    assert rows(nodes, "path", "node") == [
        ("a.mmd", "Order"), ("a.mmd", "Order_Detail"), ("a.mmd", "User"), ("a.mmd", "User_List"), ("a.mmd", "User_ListView"), ("b.mmd", "Zzz"), ("b.mmd", "o1"),
    ]
    got = rows(labels.resolve_labels(nodes, lab), "node", "label")
    assert got == [("Order", "注文"), ("Order_Detail", "注文 詳細"), ("User", "利用者"), ("User_List", "名簿"), ("User_ListView", "利用者 一覧")]
    out = {r.path: r for r in labels.translate_diagrams(df, lab).collect()}
    assert out["a.mmd"].content == (
        'flowchart TB\n  User["利用者"] --> Order_Detail["注文 詳細"]\n  %% User\n  X["利用者"] --> Order["注文"]\n'
        '  User_List["名簿"] --> User_ListView["利用者 一覧"]\n  end --> TB\n'
    )
    assert out["b.mmd"].content == 'stateDiagram\n  state "注文" as o1\n  [*] --> Zzz'


def test_document_translation(files):
    df = files(("c", "a", "## 概要\n営業 なし"), ("c", "b", "plain"))
    out = labels.translate(df, labels.BASE_LABELS["en"] + labels.DOCUMENT_LABELS["en"])
    assert rows(out, "content", "modified") == [("## Overview\nSales/Business None", True), ("plain", False)]
    assert rows(labels.translation_totals(out)) == [("c", 2, 1)]
    assert rows(df.select(labels.translate_document(F.col("content"), "ja").alias("x"))) == [("## 概要\n営業 なし",), ("plain",)]
    try:
        labels.translate_template(F.col("content"), "fr")
    except ValueError:
        return
    raise AssertionError("fr should not be supported")


def test_merge(files):
    df = files(
        ("c", "01-a.md", "# One\nx\n\n"), ("c", "03-features.md", "# Feats"), ("c", "features/z.md", "no title"), ("c", "features/b.md", "# B"),
        ("c", "04-api.md", "# Api"), ("d", "01.md", "# D"), ("d", "features/x.md", "# lost"),
    )
    text = {}
    for r in assemble.in_order(assemble.merged_blocks(df)).collect():
        text[r.corpus] = text[r.corpus] + "\n" + r.block if r.corpus in text else r.block
    br = "\n\n---\n\n"
    assert text["c"] == br.join(["# Table of Contents\n\n- One\n- Feats\n- B\n- z\n- Api\n", "# One\nx", "# Feats", "# B", "no title", "# Api"])
    assert text["d"] == br.join(["# Table of Contents\n\n- D\n", "# D"])
    bare = [r.block for r in assemble.in_order(assemble.merged_blocks(df.where("corpus='d'"), include_toc=False)).collect()]
    assert bare == ["# D"]


def test_navigation_and_export(files):
    df = files(
        ("c", "app-index.md", ""), ("c", "manual/app/01-overview.md", ""), ("c", "manual/app/04-api-reference.md", ""), ("c", "manual/app/09-user-guide.md", ""),
        ("c", "manual/app/features/x.md", "# Pay"), ("c", "architecture/app.rag.md", ""), ("c", "explanations/app/pro.md", ""), ("c", "app-llms.txt", ""), ("c", "junk.md", ""),
    )
    nav = assemble.navigation(df).orderBy("section_rank", "rank", "path").collect()
    assert [(r.section, r.title) for r in nav] == [
        ("index", "目次"), ("Architecture", "RAG用"), ("Manual", "システム概要"), ("Manual", "機能: Pay"), ("Manual", "APIリファレンス"),
        ("User Guide", "操作ガイド"), ("Explanations", "エンジニア向け"), ("AI Docs", "llms.txt"),
    ]
    pages = assemble.export_pages(files(("c", "m/a.md", "<!-- x -->t"), ("c", "n/b.txt", "q"), ("c", "z.yaml", "")))
    assert rows(pages, "page_name", "content") == [("m_a.md", "t"), ("n_b.md", "q")]
    assert rows(assemble.export_index(pages), "line") == [("- [m / a](m_a.md)",), ("- [n / b](n_b.md)",)]


def test_reconcile(spark):
    mk = lambda s, *r: spark.createDataFrame(list(r), s)
    cat = "corpus STRING, category STRING, name STRING"
    got = reconcile.reconcile_counts(mk(cat, ("c", "routes", "a"), ("c", "routes", "b"), ("c", "tables", "t")), mk(cat, ("c", "routes", "x"), ("c", "tables", "t"), ("d", "screens", "s")))
    assert rows(got) == [("c", "routes", 2, 1, False), ("c", "tables", 1, 1, True), ("d", "screens", 0, 1, False)]
    mods = mk("corpus STRING, name STRING, active BOOLEAN", ("c", "a", True), ("c", "b", True), ("c", "off", False), ("c", "on2", True))
    tiers = mk("corpus STRING, name STRING, tier STRING", ("c", "a", "tier1"), ("c", "off", "tier2"), ("c", "on2", "tier1"), ("c", "on2", "tier3"), ("c", "zz", "tier3"))
    assert rows(reconcile.tier_coverage(mods, tiers), "name", "problem") == [
        ("b", "active but in no tier"), ("off", "disabled but in a tier"), ("on2", "in several tiers"), ("zz", "not in facts"),
    ]
    d = reconcile.tier_distribution(mk("corpus STRING, tier STRING", *[("c", t) for t in ["tier1"] * 3 + ["tier2"] * 4 + ["tier3"] * 3])).collect()[0]
    assert d.in_bands and not d.tier1_too_large and not d.tier3_empty
    s = mk("corpus STRING, deliverable STRING, axis STRING, score INT", *[("c", "rag", a, 100) for a in reconcile.WEIGHT_AXES], ("c", "slide", "accuracy", 50))
    assert rows(reconcile.weighted_scores(s)) == [("c", "rag", 100.0), ("c", "slide", 10.0)]
    assert rows(reconcile.unknown_names(tiers, mods)) == [("c", "zz")]


def test_last_label_wins(files):
    df = files(("c", "lang/ja/a.php", "'K' => 'one', 'K' => 'two', 'S' => 'plain'"), ("c", "lang/ja/b.php", "'K' => 'three'\n$languageStrings['SINGLE_S'] = 'single';"))
    assert rows(labels.label_map(labels.language_entries(df)), "key", "value") == [("K", "three"), ("S", "single")]


def test_json_of_any_depth_and_order(files):
    deep = '{"a":' * 40 + '"x"' + "}" * 40
    df = files(("c", "lang/ja/deep.json", deep), ("c", "lang/ja/b.json", '{"k": "1", "k": "2", "m": {"n": "3"}, "l": ["4"]}'), ("c", "lang/ja/bad.json", '{"a"'), ("c", "lang/ja/list.json", "[]"))
    got = rows(labels.language_entries(df), "path", "seq", "key", "value")
    assert got == [("lang/ja/b.json", 0, "k", "2"), ("lang/ja/b.json", 1, "m.n", "3"), ("lang/ja/deep.json", 0, ".".join("a" * 40), "x")]
    assert rows(labels.unreadable_language_files(df), "path") == [("lang/ja/bad.json",), ("lang/ja/list.json",)]


def test_nested_state_groups(files):
    text = "stateDiagram-v2\nstate G {\ns1 --> s2\nstate H {\ns3 --> s4\n}\ns5 --> s6\n}\nout --> s1"
    df = files(("c", "d.mmd", text))
    assert rows(diagrams.members(df), "grp", "node") == [("G", f"s{i}") for i in range(1, 7)]
    touches = diagrams.group_touches(diagrams.group_edges(diagrams.edges(df), diagrams.members(df)))
    assert rows(touches, "grp", "src", "inside") == [("G", "out", False), ("G", "s1", True), ("G", "s3", True), ("G", "s5", True)]


def test_front_matter_of_any_length(spark):
    head = "title: " + "t" * 2100
    texts = [f"---\n{head}\nmarp: true\n---\n# s", f"---\n{head}\n---\nmarp: true", "marp: true"]
    df = spark.createDataFrame([(t,) for t in texts], "content STRING").select(diagrams.is_slide_deck(F.col("content")).alias("d"))
    assert [r.d for r in df.collect()] == [True, False, False]


ODD = [
    "graph TB\r\n  A[x] --> B(y)\r  subgraph S1[t]\r\n    C --> D\n    E  --> F\n  end \n  G --> H\n",
    "flowchart LR\nsubgraph end\n  A --> B\n end \n X --> Y\nsubgraph S2\n  %% no\n  B{z} --> C\nsubgraph S3\n  D\n\n  direction LR\n  \x85E --> G",
    "graph TD\nsubgraph \n  A --> B\nsubgraph S1 --> x\n K\n --> L\n\nend x\n  M-->N --> O\n end",
    "graph TB\n" + "subgraph a\n b --> c\nend\n" * 300,
    "erDiagram\n  A ||--o{ B : x\n C ||--|| D: y\n  E\n ||--|| F : z",
    "stateDiagram\n [*] --> A\n A\n --> B\r\n state g {\n  C --> D\n }\n D --> [*]",
    "subgraph s\n a --> b", "", "\n", None,
]


def test_whole_texts_are_read_as_their_lines(spark, files):
    """Edges and members found in the whole text are those of its lines, whatever ends a line."""
    df = files(*[("c", str(k), t) for k, t in enumerate(ODD)])
    found = diagrams.edges(df)
    by_line = tx.with_lines(df.withColumn("kind", diagrams.kind_of(F.col("content"))))
    pairs = {"erDiagram": diagrams.er_relations(), "stateDiagram": diagrams.transitions(), "flowchart": diagrams.flow_edges()}
    want = []
    for kind, column in pairs.items():
        for r in by_line.where(F.col("kind") == kind).select("path", column.alias("e")).collect():
            want += [("c", r.path, kind, n, e.src, e.dst) for n, e in enumerate(r.e, 1)]
    assert rows(found) == sorted(want, key=str)
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString()

    members = set()
    for path, text in enumerate(ODD[:4] + ODD[6:7]):
        group = None
        for line in re.sub("\r\n?", "\n", text).split("\n"):
            head = re.match(r"[ \t]*subgraph[ \t]+(\w+)", line, re.ASCII)
            if head or re.match("[ \t]*end[ \t]*[\x85  ]?$", line):
                group = head and head[1]
            elif group and not re.match(r"[ \t]*(%%|direction\b|\[\*\]|state\s)", line):
                node = re.match(r"[ \t]*(\w+)(?:\[.*?\]|\(.*?\)|\{.*?\})?([ \t]*-->[ \t]*(\w+))?", line, re.ASCII)
                members |= {("c", str(path if path < 4 else 6), group, n) for n in ((node[1], node[3]) if node else ()) if n}
    assert {m for m in rows(diagrams.members(df)) if m[1] != "5"} == members


def test_groups_are_looked_up_by_number_first(spark, files):
    """Keys that begin alike are sorted by a number; rows with null or repeated keys get the groups they had."""
    text = "graph TB\nsubgraph S\n a --> b\nend\n b --> c"
    df = files(("c", "p", text), ("c", "p", text), ("c", None, text), (None, "p", text), ("c", "q", "graph TB\na --> b"))
    got = diagrams.group_edges(diagrams.edges(df), diagrams.members(df))
    assert got._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(_h") >= 3
    whole = [("c", "p", 1, "a", "b", "S", "S"), ("c", "p", 2, "b", "c", "S", None)] * 2
    none = [(c, p, n, a, b, None, None) for c, p in (("c", None), (None, "p")) for n, a, b in ((1, "a", "b"), (2, "b", "c"))]
    assert rows(got.drop("touches")) == sorted([*whole, *none, ("c", "q", 1, "a", "b", None, None)], key=str)
