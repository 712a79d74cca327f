"""Translation entries, node labels and fixed-label translation of documents."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusaudit.functions import paths
from corpusaudit.functions import text as tx
from corpusaudit.operators.classify import is_language_file
from corpusaudit.session import by_key

# Fixed values.
SUFFIXES = {
    "_Detail": " 詳細", "_Details": " 詳細", "_List": " 一覧", "_ListView": " 一覧", "_Edit": " 編集",
    "_EditView": " 編集", "_Create": " 新規作成", "_CreateView": " 新規作成", "_Related": " 関連",
    "_RelatedList": " 関連一覧", "_Index": " トップ", "_Summary": " サマリー", "_Config": " 設定",
    "_Settings": " 設定", "_Search": " 検索", "_Import": " インポート", "_Export": " エクスポート",
}
RESERVED = [
    "subgraph", "end", "direction", "classDef", "class", "style", "click", "note", "participant", "actor",
    "activate", "deactivate", "loop", "alt", "else", "opt", "par", "critical", "break", "rect", "TB", "TD", "BT",
    "RL", "LR", "graph", "flowchart", "sequenceDiagram", "stateDiagram", "stateDiagram-v2", "erDiagram", "gantt",
    "pie", "gitGraph", "journey", "left", "right", "of", "over", "as", "state",
]
DIAGRAM_LINE = r"^\s*(graph|flowchart|sequenceDiagram|stateDiagram|erDiagram|gantt|pie|gitGraph|journey)\b"
ARROWS = r"(\S+)\s+(?:-->|---->|-.->|-\.\.\.->|==>|---|----|~~>|--)\s+(\S+)"
BASE_LABELS = {
    "en": [
        ("読む人別 クイックリンク", "Quick Links by Reader"), ("アーキテクチャ文書", "Architecture Documents"),
        ("完全マニュアル", "Complete Manual"), ("操作ガイド", "Operations Guide"),
        ("レベル別説明", "Explanations by Level"), ("スライド資料", "Slide Materials"),
        ("AI 向けドキュメント", "AI Documents"), ("ダイアグラム", "Diagrams"), ("共有方法", "Sharing"),
        ("エンジニア", "Engineer"), ("営業", "Sales/Business"), ("初心者", "Beginner"), ("エンドユーザー", "End User"),
    ],
}
DOCUMENT_LABELS = {
    "en": [
        ("## 概要", "## Overview"), ("## システム概要", "## System Overview"), ("## 技術スタック", "## Tech Stack"),
        ("## 画面一覧", "## Screen List"), ("## 画面遷移図", "## Screen Flow Diagram"), ("## 機能一覧", "## Feature List"),
        ("## API一覧", "## API List"), ("## APIリファレンス", "## API Reference"), ("## データモデル", "## Data Model"),
        ("## ER図", "## ER Diagram"), ("## 画面詳細設計", "## Screen Specifications"), ("## ユースケース", "## Use Cases"),
        ("## 設計レビュー", "## Design Review"), ("## 改善提案", "## Improvement Proposals"),
        ("## 目次", "## Table of Contents"), ("## 前提条件", "## Prerequisites"), ("## 用語集", "## Glossary"),
        ("| 画面名", "| Screen Name"), ("| 機能名", "| Feature Name"), ("| エンドポイント", "| Endpoint"),
        ("| テーブル名", "| Table Name"), ("| カラム名", "| Column Name"), ("| 型", "| Type"),
        ("| 説明", "| Description"), ("| メソッド", "| Method"), ("| パス", "| Path"), ("| 認証", "| Auth"),
        ("生成日時", "Generated"), ("対象パス", "Target"), ("ツール", "Tool"), ("必須", "Required"), ("任意", "Optional"),
        ("なし", "None"), ("あり", "Yes"), ("備考", "Notes"),
    ],
}
LANGUAGES = ["ja", "en"]


def _labels(lang: str, table: dict[str, list[tuple[str, str]]]) -> list[tuple[str, str]]:
    if lang not in LANGUAGES:
        raise ValueError(f"unsupported language {lang!r}, supported: {', '.join(LANGUAGES)}")
    return table.get(lang, [])


def translate_template(content: Column, lang: str) -> Column:
    return tx.replace_all(content, _labels(lang, BASE_LABELS))


def translate_document(content: Column, lang: str) -> Column:
    """Base labels, then the labels of documents; later pairs see what earlier ones wrote."""
    return tx.replace_all(content, _labels(lang, BASE_LABELS) + _labels(lang, DOCUMENT_LABELS))


def translate(files: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """New version of the files: corpus, path, content, modified. Row-local."""
    new = tx.replace_all(F.col("content"), pairs)
    return files.select("corpus", "path", new.alias("content"), (new != F.col("content")).alias("modified"))


def translation_totals(translated: DataFrame) -> DataFrame:
    return translated.groupBy("corpus").agg(
        F.count("*").alias("files_processed"), F.count_if("modified").alias("files_modified")
    )


def _entries(regex: str) -> Column:
    raw = F.regexp_extract_all("content", F.lit(regex), F.lit(0))
    return F.transform(
        raw, lambda r: F.struct(F.regexp_extract(r, regex, 1).alias("key"), F.regexp_extract(r, regex, 2).alias("value"))
    )


def language_entries(files: DataFrame) -> DataFrame:
    """Key and value of PHP arrays, JS objects and nested JSON (keys joined by dots): corpus, path, seq, key, value."""
    quoted = r"""['"]([^'"]+)['"]"""
    found = files.where(is_language_file(F.col("path")))
    ext = paths.extension(F.col("path"))
    php = F.concat(
        _entries(rf"\$languageStrings\s*\[\s*{quoted}\s*\]\s*=\s*{quoted}"), _entries(rf"{quoted}\s*=>\s*{quoted}")
    )
    flat = (
        found.where(ext != ".json")
        .select("corpus", "path", F.posexplode_outer(F.when(ext == ".php", php).otherwise(_entries(rf"{quoted}\s*:\s*{quoted}"))).alias("seq", "e")).where(F.col("seq").isNotNull())
        .select("corpus", "path", F.col("seq").cast("long").alias("seq"), "e.key", "e.value")
    )
    return flat.unionByName(json_entries(found.where(ext == ".json")))


_LEAVES = T.ArrayType(T.StructType().add("key", T.StringType()).add("value", T.StringType()))


@F.pandas_udf(_LEAVES)
def _string_leaves(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Strings of a JSON object at any depth, in order, keys joined by dots; NULL if the text is no JSON object."""

    def leaves(text: str):
        try:
            top = json.loads(text)
        except (ValueError, TypeError, RecursionError):
            return None
        if not isinstance(top, dict):
            return None
        out, todo = [], [("", top)]
        while todo:
            key, node = todo.pop()
            if isinstance(node, dict):
                todo += [(f"{key}.{k}" if key else k, v) for k, v in reversed(node.items())]
            elif isinstance(node, str):
                out.append({"key": key, "value": node})
        return out

    for batch in batches:
        yield batch.map(leaves)


def json_entries(files: DataFrame) -> DataFrame:
    """Leaves of JSON documents that are strings, however deep, in their order in the file. No shuffle."""
    leaves = files.select("corpus", "path", F.posexplode_outer(_string_leaves("content")).alias("seq", "e")).where(F.col("e").isNotNull())
    return leaves.select("corpus", "path", F.col("seq").cast("long").alias("seq"), "e.key", "e.value")


def unreadable_language_files(files: DataFrame) -> DataFrame:
    """JSON language files that are no JSON object, which ``language_entries`` leaves out: corpus, path."""
    found = files.where(is_language_file(F.col("path")) & (paths.extension(F.col("path")) == ".json"))
    return found.where(_string_leaves("content").isNull()).select("corpus", "path")


def label_map(entries: DataFrame) -> DataFrame:
    """One value per (corpus, key): a ``SINGLE_`` entry wins, and of each kind the last one by path and order."""
    single = F.startswith("key", F.lit("SINGLE_"))
    plain = F.when(single, F.expr("substring(key, 8)")).otherwise(F.col("key"))
    at = F.struct("path", "seq", "value")
    best = entries.groupBy("corpus", plain.alias("label_key")).agg(
        F.max_by("value", F.when(single, at)).alias("s"), F.max_by("value", F.when(~single, at)).alias("p")
    )
    return best.select("corpus", F.col("label_key").alias("key"), F.coalesce("s", "p").alias("value"))


def bare_nodes(diagrams: DataFrame) -> DataFrame:
    """Unlabelled nodes of diagrams: corpus, path, node, distinct per file."""
    df = tx.with_lines(diagrams.select("corpus", "path", "content"))
    line = df.select("corpus", "path", F.explode_outer("lines").alias("line")).where(F.col("line").isNotNull()).where(
        ~F.col("line").rlike(r"^\s*%%") & ~F.col("line").rlike(DIAGRAM_LINE) & ~F.col("line").rlike(r"^\s*direction\s")
    )
    ends = F.concat(
        F.regexp_extract_all("line", F.lit(ARROWS), F.lit(1)), F.regexp_extract_all("line", F.lit(ARROWS), F.lit(2))
    )
    clean = F.filter(
        F.transform(ends, lambda e: F.regexp_replace(e, ":.*$", "")),
        lambda e: ~e.rlike(r'[\[("]') & ~e.isin("[*]", "(*)"),
    )
    word = lambda r: F.regexp_extract_all("line", F.lit(r), F.lit(1))
    named = F.concat(
        clean,
        word(r"^\s*(?:participant|actor)\s+(\w+)"),
        word(r'^\s*state\s+"[^"]*"\s+as\s+(\w+)'),
        word(r"^\s*\[\*\]\s+-->\s+(\w+)"),
    )
    return (
        line.select("corpus", "path", F.explode_outer(F.array_distinct(named)).alias("node")).where(F.col("node").isNotNull())
        .where((F.col("node") != "") & ~F.col("node").isin(RESERVED))
        .distinct()
    )


def resolve_labels(nodes: DataFrame, labels: DataFrame, by: Sequence[str] = ("corpus",)) -> DataFrame:
    """Label of each distinct node: exact key, else the key before its longest suffix plus the suffix text.

    A node has one exact candidate and at most one per suffix, so this is an equi-join on the key; nodes
    are made distinct first, so a frequent one is looked up once.
    """
    node = F.col("node")
    tries = [F.struct(node.alias("key"), F.lit("").alias("tail"), F.lit(1 << 20).alias("rank"))]
    for suffix, tail in SUFFIXES.items():
        cut = F.substring(node, F.lit(1), F.length(node) - len(suffix))
        tries.append(
            F.when(F.endswith(node, F.lit(suffix)), F.struct(cut.alias("key"), F.lit(tail).alias("tail"), F.lit(len(suffix)).alias("rank")))
        )
    by = list(by)
    return (
        nodes.select(*by, "node")
        .distinct()
        .select(*by, "node", F.explode_outer(F.array_compact(F.array(*tries))).alias("t")).where(F.col("t").isNotNull())
        .select(*by, "node", "t.key", "t.tail", "t.rank")
        .join(labels.select(*by, "key", "value"), [*by, "key"])
        .groupBy(*by, "node")
        .agg(F.max_by(F.concat("value", "tail"), "rank").alias("label"))
    )


QUOTED_LABEL = r"""(?:\["|\(")\s*([^"\]\)]*?)\s*(?:"\]|"\))"""
BROKEN_LABEL = r"([\w .-]+)<br/>"
STATE_LABEL = r'state\s+"([^"]+)"'


def _quote(text: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit("\\E"), F.lit("")), F.lit(r"\E"))


def _safe(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def translate_diagrams(diagrams: DataFrame, labels: DataFrame) -> DataFrame:
    """Diagrams with their labels translated and unlabelled nodes given a label: corpus, path, content, modified.

    Labels and nodes of a file are extracted, resolved by an equi-join with the dictionary, and brought
    back to the file as a small map; the text is rewritten in its row. A file never meets the dictionary
    as a whole.
    """
    quoted = F.concat(*[F.regexp_extract_all("content", F.lit(r), F.lit(1)) for r in (QUOTED_LABEL, BROKEN_LABEL, STATE_LABEL)])
    shown = diagrams.select("corpus", "path", F.explode_outer(F.array_distinct(quoted)).alias("key")).where(F.col("key").isNotNull()).join(
        labels.select("corpus", "key", "value"), ["corpus", "key"]
    )
    nodes = bare_nodes(diagrams)
    bare = nodes.join(resolve_labels(nodes, labels), ["corpus", "node"]).select("corpus", "path", F.col("node").alias("key"), F.col("label").alias("value"))
    # one small table with a row per file that has a hit, so the text moves once
    both = shown.select("corpus", "path", "key", "value", F.lit(True).alias("is_shown")).unionByName(bare.withColumn("is_shown", F.lit(False)))
    # gathered where a file's rows end up: before that shuffle one task may hold most of them
    hits = by_key(both, "corpus", "path").groupBy("corpus", "path").agg(_longest_first("key", "value", F.col("is_shown")).alias("shown"), _longest_first("key", "value", ~F.col("is_shown")).alias("bare"))
    df = diagrams.join(hits, ["corpus", "path"], "left")
    none = F.array().cast("array<struct<n:int,key:string,value:string>>")
    # what is in brackets first
    def relabel(c: Column, e: Column) -> Column:
        k, v = _quote(e["key"]), _safe(e["value"])
        c = F.regexp_replace(c, F.concat(F.lit(r'(\["|\(")\s*'), k, F.lit(r'\s*("\]|"\))')), F.concat(F.lit("$1"), v, F.lit("$2")))
        c = F.regexp_replace(c, F.concat(k, F.lit("<br/>")), F.concat(v, F.lit("<br/>")))
        return F.regexp_replace(c, F.concat(F.lit(r'state\s+"'), k, F.lit('"')), F.concat(F.lit('state "'), v, F.lit('"')))

    df = df.withColumn("text", F.aggregate(F.coalesce("shown", none), F.col("content"), relabel))

    def add_label(line: Column, e: Column) -> Column:
        k, v = _quote(e["key"]), _safe(e["value"])
        has = F.contains(line, F.concat(e["key"], F.lit('["'))) | F.contains(line, F.concat(e["key"], F.lit('("')))
        new = F.regexp_replace(
            line,
            F.concat(F.lit(r'(?<!["\w\]\)])('), k, F.lit(r')(?![\w"\[\(])')),
            F.concat(F.lit('$1["'), v, F.lit('"]')),
        )
        return F.when(has, line).otherwise(new)

    keep = lambda l: l.rlike(r"^\s*%%") | l.rlike(r"^\s*(graph|flowchart|sequenceDiagram|stateDiagram|erDiagram)\b")
    lines = F.transform(
        F.split("text", "\n", -1),
        lambda l: F.when(keep(l), l).otherwise(F.aggregate(F.coalesce("bare", none), l, add_label)),
    )
    out = F.when(F.coalesce(F.size("bare"), F.lit(0)) <= 0, F.col("text")).otherwise(F.array_join(lines, "\n"))
    return df.select("corpus", "path", out.alias("new"), "content").select(
        "corpus", "path", F.col("new").alias("content"), (F.col("new") != F.col("content")).alias("modified")
    )


def _longest_first(key: str, value: str, where: Column) -> Column:
    """Pairs of one file, longest key first, so that a name inside another is replaced after it."""
    pair = F.struct((-F.length(key)).alias("n"), F.col(key).alias("key"), F.col(value).alias("value"))
    return F.array_sort(F.collect_list(F.when(where, pair)))
