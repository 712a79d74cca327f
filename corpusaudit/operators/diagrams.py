"""Mermaid diagrams: kind, blocks, elements, edges, and what exceeds the limits of a readable figure."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusaudit.functions import paths
from corpusaudit.functions import text as tx
from corpusaudit.operators.joins import group_by_hash, hash_first
from corpusaudit.operators.lines import KEY, slides

# Fixed values.
LIMITS = {
    "flowchart_vertical_nodes": 4, "sequence_participants": 5, "sequence_messages": 12, "er_entities": 8,
    "slide_bullets": 5, "slide_table_rows": 5, "slide_cards": 4, "fig_text_cards": 3,
}
NODE = r"(?:\[.*?\]|\(.*?\)|\{.*?\})?"
FLOW_EDGE = rf"^\s*(\w+){NODE}\s*-->\s*(\w+){NODE}"
PARTICIPANT = r"^\s*(?:participant|actor)\s+(\S+)"
SEQUENCE_KEYWORD = r"^\s*(participant|actor|Note|end|loop|alt|else|opt|par|rect|critical|break)"
ARROW = r"->>|-->>|-\)\)|--\)|->|-->"
ER_ENTITY = r"^\s+(\w+)\s*\{"
ER_RELATION = r"^\s+(\w+)\s+\S*--\S*\s+(\w+)\s*:"
TRANSITION = r"^\s*(\S+)\s*-->\s*(\S+)"
TYPE_LINE = r"^\s*(flowchart|sequenceDiagram|erDiagram|classDiagram|stateDiagram|gantt|pie|gitGraph)"
OTHER_TYPE = {
    "flowchart": r"^\s*(flowchart|sequenceDiagram|erDiagram|classDiagram|stateDiagram|gantt|pie|gitGraph)",
    "sequence": r"^\s*(flowchart|erDiagram|classDiagram|stateDiagram|gantt|pie|gitGraph)",
    "er": r"^\s*(flowchart|sequenceDiagram|classDiagram|stateDiagram|gantt|pie|gitGraph)",
}
OPENS = {"flowchart": r"^\s*(flowchart|direction)\s+TB", "sequence": r"^\s*sequenceDiagram\s*$", "er": r"^\s*erDiagram\s*$"}
INLINE_TYPES = ["stateDiagram", "graph", "flowchart", "sequenceDiagram", "erDiagram", "C4Context", "C4Container", "C4Component"]
SPLIT_PART = r"-(part[0-9]+|overview)\.mmd$"


def kind_of(content: Column) -> Column:
    """erDiagram / sequenceDiagram / flowchart / stateDiagram of the first line, else NULL."""
    first = F.regexp_extract(content, r"^\s*(\S[^\n]*)", 1)
    return (
        F.when(first.rlike("^erDiagram"), "erDiagram")
        .when(first.rlike("^sequenceDiagram"), "sequenceDiagram")
        .when(first.rlike(r"^(flowchart|graph)\s+(TB|TD|BT|LR|RL)"), "flowchart")
        .when(first.rlike("^stateDiagram"), "stateDiagram")
    )


def is_split_part(path: Column) -> Column:
    return path.rlike(SPLIT_PART)


def is_slide_deck(content: Column) -> Column:
    """The front matter (between the first line and the next line of three dashes, however long) says so."""
    front = F.regexp_extract(content, r"(?s)\A\s*---[ \t]*\r?\n(.*?\n)---[ \t]*(?:\r?\n|\z)", 1)
    return F.contains(front, F.lit("marp: true"))


def blocks(files: DataFrame, kind: str) -> DataFrame:
    """Blocks of one kind inside diagram files: corpus, path, first_line, lines (after the opening line)."""
    opens, other = OPENS[kind], OTHER_TYPE[kind]
    df = tx.with_lines(files.select(*KEY, "content").where(F.col("content").rlike("(?m)" + opens)))
    df = tx.cut_runs(df, "lines", lambda l: l.rlike(opens) | l.rlike(other), "runs")
    head = F.try_element_at(F.col("r.lines"), F.lit(1))
    return (
        df.select(*KEY, F.explode_outer("runs").alias("r")).where(F.col("r").isNotNull())
        .where((F.col("r.run_no") > 0) & head.rlike(opens))
        .select(
            *KEY,
            F.col("r.first_line").alias("first_line"),
            F.slice("r.lines", F.lit(2), F.greatest(F.size("r.lines") - 1, F.lit(0))).alias("lines"),
        )
    )


def _pairs(lines: str, regex: str) -> Column:
    """Edges of an array of lines, in line order: ARRAY<STRUCT<src, dst>>."""
    hit = F.filter(F.col(lines), lambda l: l.rlike(regex))
    return F.transform(
        hit, lambda l: F.struct(F.regexp_extract(l, regex, 1).alias("src"), F.regexp_extract(l, regex, 2).alias("dst"))
    )


def _text_pairs(text: str, regex: str) -> Column:
    """The same edges out of a whole text."""
    end = lambda group: F.regexp_extract_all(text, F.lit(tx.in_text(regex)), F.lit(group))
    return F.zip_with(end(1), end(2), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))


def flow_edges(lines: str = "lines") -> Column:
    return _pairs(lines, FLOW_EDGE)


def er_relations(lines: str = "lines") -> Column:
    return _pairs(lines, ER_RELATION)


def transitions(lines: str = "lines") -> Column:
    return _pairs(lines, TRANSITION)


def participants(lines: str = "lines") -> Column:
    hit = F.filter(F.col(lines), lambda l: l.rlike(PARTICIPANT))
    return F.array_distinct(F.transform(hit, lambda l: F.regexp_extract(l, PARTICIPANT, 1)))


def messages(lines: str = "lines") -> Column:
    return F.filter(F.col(lines), lambda l: l.rlike(ARROW) & ~l.rlike(SEQUENCE_KEYWORD))


def er_entities(lines: str = "lines") -> Column:
    named = F.transform(
        F.filter(F.col(lines), lambda l: l.rlike(ER_ENTITY)), lambda l: F.regexp_extract(l, ER_ENTITY, 1)
    )
    ends = F.flatten(F.transform(er_relations(lines), lambda e: F.array(e["src"], e["dst"])))
    return F.array_distinct(F.concat(named, ends))


def states(lines: str = "lines") -> Column:
    ends = F.flatten(F.transform(transitions(lines), lambda e: F.array(e["src"], e["dst"])))
    return F.array_distinct(F.filter(ends, lambda s: s != "[*]"))


def edges(files: DataFrame) -> DataFrame:
    """All edges of diagram files as rows: corpus, path, kind, edge_no, src, dst."""
    df = files.select(*KEY, kind_of(F.col("content")).alias("kind"), tx.unix(F.col("content")).alias("text"))
    pairs = (
        F.when(F.col("kind") == "erDiagram", _text_pairs("text", ER_RELATION))
        .when(F.col("kind") == "stateDiagram", _text_pairs("text", TRANSITION))
        .when(F.col("kind") == "flowchart", _text_pairs("text", FLOW_EDGE))
    )
    return df.select(*KEY, "kind", F.posexplode_outer(pairs).alias("n", "e")).where(F.col("n").isNotNull()).select(
        *KEY, "kind", (F.col("n") + 1).alias("edge_no"), "e.src", "e.dst"
    )


_GROUPED = T.ArrayType(T.StructType().add("grp", T.StringType()).add("line", T.StringType()))


@F.pandas_udf(_GROUPED)
def _state_group_lines(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Lines inside the outermost groups of a state diagram: a group ends with the brace that matches its first."""
    opens = re.compile(r"\s*state\s+(\S+)\s*\{")

    def grouped(lines) -> list[dict]:
        out, group, depth = [], None, 0
        for line in lines if lines is not None else ():
            if group is None:
                found = opens.match(line)
                if found:
                    group, depth = found[1], 1
                continue
            depth += line.count("{") - line.count("}")
            if depth <= 0:
                group = None
            else:
                out.append({"grp": group, "line": line})
        return out

    for batch in batches:
        yield batch.map(grouped)


def members(files: DataFrame) -> DataFrame:
    """Subgraph or state group of each node: corpus, path, grp, node (exact names).

    In a flowchart a line belongs to the subgraph opened last and not yet closed; in a state diagram to the
    outermost group, whatever groups that holds.
    """
    files = files.select(*KEY, "content")
    is_state = F.coalesce(F.contains("content", F.lit("stateDiagram")) & (kind_of(F.col("content")) == "stateDiagram"), F.lit(False))
    # a piece for each subgraph, from its name to the next one, without what follows the line that ends it
    pieces = F.split(tx.unix(F.col("content")), tx.in_text(r"^\s*subgraph\s+(?=\w)"), -1)
    piece = files.where(~is_state).select(*KEY, F.posexplode_outer(pieces).alias("n", "piece")).where("n > 0")
    run = piece.select(*KEY, F.split("piece", rf"\n{tx.BLANK}*end{tx.BLANK}*{tx.LAST}(?=\n|\z)", 2)[0].alias("run"))
    line = run.select(*KEY, F.regexp_extract("run", r"^(\w+)", 1).alias("grp"), F.posexplode_outer(F.split("run", "\n", -1)).alias("n", "line"))
    flow = line.where("n > 0").select(*KEY, "grp", "line")
    state = tx.with_lines(files.where(is_state)).select(*KEY, F.explode_outer(_state_group_lines("lines")).alias("g")).select(*KEY, "g.grp", "g.line")
    line = flow.unionByName(state).where(F.col("line").isNotNull())
    ends = F.array(F.regexp_extract("line", r"^\s*(\w+)", 1), F.regexp_extract("line", rf"^\s*\w+{NODE}\s*-->\s*(\w+)", 1))
    return (
        line.where(~F.col("line").rlike(r"^\s*(%%|direction\b|\[\*\]|state\s)"))
        .select(*KEY, "grp", F.explode_outer(ends).alias("node")).where(F.col("node").isNotNull())
        .where(F.col("node") != "")
        .distinct()
    )


def group_edges(edge_rows: DataFrame, member_rows: DataFrame) -> DataFrame:
    """Edges with the group of either end; ``touches`` lists the groups an edge belongs to."""
    m = group_by_hash(member_rows, [*KEY, "node"]).agg(F.min("grp").alias("grp"))
    # both ends look it up by the same number
    side = lambda c: m.select("_h", *KEY, F.col("node").alias(c), F.col("grp").alias(f"{c}_group"))
    found = edge_rows
    for c in ("src", "dst"):
        found = hash_first(found, [*KEY, c]).join(side(c), ["_h", *KEY, c], "left").drop("_h")
    return found.select(
        *KEY, "edge_no", "src", "dst", "src_group", "dst_group",
        F.array_distinct(F.array_compact(F.array("src_group", "dst_group"))).alias("touches"),
    )


def group_touches(grouped: DataFrame) -> DataFrame:
    """A row per group and edge that starts or ends in it, or both: corpus, path, grp, edge_no, src, dst, inside."""
    inside = F.coalesce(F.col("src_group") == F.col("dst_group"), F.lit(False)).alias("inside")
    return grouped.select(*KEY, F.explode("touches").alias("grp"), "edge_no", "src", "dst", inside)


def overview_edges(grouped: DataFrame) -> DataFrame:
    """Distinct edges between groups; an end outside all groups stands for itself."""
    a, b = F.coalesce("src_group", "src"), F.coalesce("dst_group", "dst")
    return grouped.where(~a.eqNullSafe(b)).select(*KEY, a.alias("src"), b.alias("dst")).distinct()


def chunks(items: DataFrame, items_col: str, size: int, keys: list[str] = KEY) -> DataFrame:
    """Ordered array cut into parts of at most ``size``: keys, part_no, parts, items. Row-local."""
    count = F.ceil(F.size(items_col) / F.lit(size)).cast("int")
    part = F.transform(
        F.sequence(F.lit(1), count),
        lambda i: F.struct(
            i.alias("part_no"), count.alias("parts"), F.slice(F.col(items_col), (i - 1) * size + 1, F.lit(size)).alias("items")
        ),
    )
    return items.where(F.size(items_col) > 0).select(*keys, F.explode_outer(part).alias("p")).where(F.col("p").isNotNull()).select(*keys, "p.part_no", "p.parts", "p.items")


def inline_diagrams(docs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Mermaid blocks in pages, named after project and page: corpus, path, block_no, name, content.

    Blocks with an unknown first keyword are left out; so are names in ``existing`` (corpus, path).
    """
    path = F.col("path")
    project = F.coalesce(
        F.nullif(F.regexp_extract(path, "^manual/([^/]+)/.+$", 1), F.lit("")),
        F.nullif(F.regexp_extract(path, r"^architecture/(?:.*/)?([^/]+?)(?:\.[^./]*)?$", 1), F.lit("")),
    )
    page = F.when(path.rlike("^manual/"), F.regexp_replace(paths.stem(path), "^[0-9]+-", "")).otherwise("architecture")
    found = (
        docs.where(F.contains("content", F.lit("```mermaid")) & path.endswith(".md"))
        .select(*KEY, F.posexplode_outer(F.regexp_extract_all("content", F.lit(r"(?s)```mermaid\s*\n(.*?)```"), F.lit(1))).alias("n", "content")).where(F.col("n").isNotNull())
        .withColumn("project", project)
        .where(F.col("project").isNotNull())
    )
    suffix = F.when(F.col("n") > 0, F.concat(F.lit("-"), F.col("n"))).otherwise("")
    named = found.where(F.col("content").rlike(r"^\s*(" + "|".join(INLINE_TYPES) + ")")).select(
        *KEY, F.col("n").alias("block_no"), F.concat("project", F.lit("-"), page, suffix, F.lit(".mmd")).alias("name"), "content"
    )
    if existing is None:
        return named
    done = existing.select("corpus", paths.basename(F.col("path")).alias("name")).distinct()
    return named.join(done, ["corpus", "name"], "left_anti").select(*named.columns)


def _issue(kind: str, count: Column) -> Column:
    limit = LIMITS[kind]
    return F.when(
        count > limit,
        F.struct(F.lit(kind).alias("rule"), count.cast("bigint").alias("count"), F.lit(limit).cast("bigint").alias("max_allowed")),
    )


def _issues(df: DataFrame, *found: Column) -> DataFrame:
    return df.select(*KEY, F.col("first_line").alias("line_no"), F.explode_outer(F.array_compact(F.array(*found))).alias("i")).where(F.col("i").isNotNull()).select(
        F.lit("overflow").alias("check"), *KEY, "line_no", "i.rule", "i.count", "i.max_allowed"
    )


def diagram_overflow(files: DataFrame) -> DataFrame:
    """Diagram blocks over a limit: check, corpus, path, line_no, rule, count, max_allowed."""
    from corpusaudit.operators.graph import chain_depth

    mmd = files.where(F.col("path").endswith(".mmd"))
    flow = blocks(mmd, "flowchart").withColumn("depth", chain_depth(flow_edges()))
    sequence, er = blocks(mmd, "sequence"), blocks(mmd, "er")
    return (
        _issues(flow, _issue("flowchart_vertical_nodes", F.col("depth")))
        .unionByName(
            _issues(
                sequence,
                _issue("sequence_participants", F.size(participants())),
                _issue("sequence_messages", F.size(messages())),
            )
        )
        .unionByName(_issues(er, _issue("er_entities", F.size(er_entities()))))
    )


def oversized_diagrams(files: DataFrame) -> DataFrame:
    """Whole diagrams that should be split, leaving out those that are parts already: corpus, path, kind, count, max_allowed.

    Counted are entities, messages, nodes of the longest chain, and states.
    """
    from corpusaudit.operators.graph import chain_depth

    whole = files.where(F.col("path").endswith(".mmd") & ~is_split_part(F.col("path")))
    kind = F.col("kind")
    df = tx.with_lines(whole.select(*KEY, "content")).withColumn("kind", kind_of(F.col("content"))).where(kind.isNotNull())
    limit = {"erDiagram": "er_entities", "sequenceDiagram": "sequence_messages", "flowchart": "flowchart_vertical_nodes", "stateDiagram": "flowchart_vertical_nodes"}
    most = F.coalesce(*[F.when(kind == k, F.lit(LIMITS[limit[k]])) for k in limit]).cast("long")
    counts = {"erDiagram": F.size(er_entities()), "sequenceDiagram": F.size(messages()), "stateDiagram": F.size(states())}
    count = F.coalesce(*[F.when(kind == k, c) for k, c in counts.items()])
    df = df.select(*KEY, "kind", most.alias("max_allowed"), count.alias("counted"), F.when(kind == "flowchart", flow_edges()).alias("edges"))
    # as many edges as the limit make a chain beyond it; only diagrams with that many are walked
    walked = chain_depth(F.when(F.size("edges") >= F.col("max_allowed"), F.col("edges")))
    counted = df.select(*KEY, "kind", F.inline_outer(F.array(F.struct(F.coalesce("counted", walked).cast("long").alias("count"), "max_allowed"))))
    return counted.where(F.col("count") > F.col("max_allowed"))


def _div_balance(line: Column) -> Column:
    return F.regexp_count(line, F.lit("<div")) - F.regexp_count(line, F.lit("</div>"))


def side_cards(lines: str = "lines") -> Column:
    """Most cards in the right column of one figure-and-text layout; a fold that follows the open divs."""
    state = "in_fig BOOLEAN, in_right BOOLEAN, fig_depth INT, right_depth INT, cards INT, best INT"
    zero = F.struct(
        F.lit(False).alias("in_fig"), F.lit(False).alias("in_right"), F.lit(0).alias("fig_depth"),
        F.lit(0).alias("right_depth"), F.lit(0).alias("cards"), F.lit(0).alias("best"),
    ).cast(f"struct<{', '.join(p.replace(' ', ':', 1) for p in state.split(', '))}>")

    def make(in_fig: Column, in_right: Column, fig: Column, right: Column, cards: Column, best: Column) -> Column:
        return F.struct(
            in_fig.alias("in_fig"), in_right.alias("in_right"), fig.cast("int").alias("fig_depth"),
            right.cast("int").alias("right_depth"), cards.cast("int").alias("cards"), best.cast("int").alias("best"),
        )

    yes, no = F.lit(True), F.lit(False)

    def step(s: Column, l: Column) -> Column:
        delta = _div_balance(l)
        card = F.when(F.contains(l, F.lit('<div class="card"')), 1).otherwise(0)
        opens_fig = F.contains(l, F.lit('<div class="fig-text">'))
        opens_right = F.contains(l, F.lit('<div class="right">'))
        right = s["right_depth"] + delta
        fig = s["fig_depth"] + delta
        return (
            F.when(opens_fig, make(yes, s["in_right"], F.lit(1), s["right_depth"], F.lit(0), s["best"]))
            .when(~s["in_fig"], s)
            .when(opens_right, make(yes, yes, s["fig_depth"], F.lit(1), s["cards"], s["best"]))
            .when(s["in_right"], make(yes, right > 0, s["fig_depth"], right, s["cards"] + card, s["best"]))
            .when(fig <= 0, make(no, no, fig, F.lit(0), s["cards"], F.greatest(s["best"], s["cards"])))
            .otherwise(make(yes, no, fig, F.lit(0), s["cards"], s["best"]))
        )

    return F.aggregate(
        F.col(lines), zero, step, lambda s: F.when(s["in_fig"], F.greatest(s["best"], s["cards"])).otherwise(s["best"])
    )


def slide_overflow(files: DataFrame) -> DataFrame:
    """Slides over a limit, in files that declare themselves a deck."""
    decks = files.where(F.col("path").endswith(".md") & is_slide_deck(F.col("content")))
    s = slides(decks)
    n = lambda ok: F.size(F.filter("lines", ok))
    table = lambda l: l.rlike(r"^\s*\|.*\|\s*$")
    data = n(lambda l: table(l) & ~l.rlike(r"^\s*\|[\s\-:|]+\|\s*$"))
    rows = F.when(n(table) < 2, 0).otherwise(F.greatest(F.lit(0), data - 1))
    cards = F.regexp_count(F.array_join("lines", "\n"), F.lit(r'<div\s+class="card"'))
    s = s.withColumn("side", F.when(F.contains(F.array_join("lines", "\n"), F.lit("fig-text")), side_cards()).otherwise(0))
    return _issues(
        s,
        _issue("slide_bullets", n(lambda l: l.rlike(r"^\s*[-*]\s"))),
        _issue("slide_table_rows", rows),
        _issue("slide_cards", cards),
        _issue("fig_text_cards", F.col("side")),
    )


def rewrite_diagram_links(docs: DataFrame, converted: DataFrame, add_window_link: bool = False) -> DataFrame:
    """Links to converted diagrams point to the image: exact base name. corpus, path, content, rewritten.

    Only the distinct (corpus, base name) pairs a page mentions are looked up; a page and its names meet
    again on the key of the page, so the text moves once, and not at all if the page mentions no diagram.
    """

    found = F.array_distinct(F.regexp_extract_all("content", F.lit(r"\((?:[^)\s]*/)?([^)/\s]+\.mmd)\)"), F.lit(1)))
    mentions = F.coalesce(F.contains("content", F.lit(".mmd)")), F.lit(False))
    named = docs.where(mentions).select(*KEY, F.explode_outer(found).alias("name")).where(F.col("name").isNotNull())
    done = converted.select("corpus", paths.basename(F.col("path")).alias("name")).distinct()
    hits = named.join(done, ["corpus", "name"], "left_semi").groupBy(*KEY).agg(F.array_sort(F.collect_set("name")).alias("names"))
    none = F.lit(None).cast("array<string>").alias("names")
    df = docs.where(mentions).select(*KEY, "content").join(hits, KEY, "left").unionByName(docs.where(~mentions).select(*KEY, "content", none))
    one = lambda c, n: F.regexp_replace(
        c,
        F.concat(F.lit(r"\(((?:[^)\s]*/)?)\Q"), n, F.lit(r"\E\)")),
        F.concat(F.lit("($1"), F.regexp_replace(F.regexp_replace(n, r"\.mmd$", ".svg"), r"([\\$])", r"\\$1"), F.lit(")")),
    )
    text = F.aggregate(F.coalesce("names", F.array().cast("array<string>")), F.col("content"), one)
    if add_window_link:
        text = with_window_links(text)
    return df.select(*KEY, text.alias("new"), "content").select(*KEY, F.col("new").alias("content"), (F.col("new") != F.col("content")).alias("rewritten"))


WINDOW_LINK = '$1\n<a href="$2" target="_blank">🔍 別ウィンドウで開く</a>'


def with_window_links(content: Column) -> Column:
    """An "open in a new window" link after each SVG image that has none."""
    return F.regexp_replace(content, F.lit(r"(!\[[^\]]*\]\(([^)]+\.svg)\))(?!\s*<a\s+href=)"), F.lit(WINDOW_LINK))
