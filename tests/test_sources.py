import json
import os

import pytest
from pyspark.sql import functions as F

from corpusaudit import schemas
from corpusaudit.operators import diagrams, endpoints, leakage, links
from corpusaudit.operators.leakage import LeakRule
from corpusaudit.sources import bundles, catalogs, sinks
from corpusaudit.sources import files as src
from corpusaudit.streaming import incremental
from tests.conftest import rows


def test_tree(spark, tmp_path):
    for p, b in {"c1/a.md": b"x\xff", "c1/node_modules/z.md": b"", "c2/d/e.txt": "é".encode()}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b)
    df = src.scan_tree(spark, str(tmp_path))
    assert rows(df, "corpus", "path", "content", "size") == [("c1", "a.md", "x�", 2), ("c2", "d/e.txt", "é", 2)]
    assert rows(src.scan_tree(spark, str(tmp_path), on_bad_utf8="drop"), "path") == [("d/e.txt",)]
    assert rows(src.scan_tree(spark, str(tmp_path), glob="*.md"), "path") == [("a.md",)]
    assert rows(src.with_suffix(df, src.DOC_SUFFIXES), "path") == [("a.md",)]


def test_rule_files(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"name": "n", "regex": "x", "severity": "HIGH", "allow_in": ["a/"]}]))
    (tmp_path / "t.json").write_text(json.dumps([{"wrong": "a", "correct": "b"}]))
    (tmp_path / "i.json").write_text(json.dumps([{"source_pattern": "*.py", "docs": ["d"]}]))
    (tmp_path / "r.json").write_text(json.dumps([{"path": "/a", "name": "a"}]))
    (tmp_path / "bad.json").write_text('{"path": [1')
    assert src.read_leak_rules(spark, str(tmp_path / "l.json")) == [LeakRule("n", "x", "HIGH", "", ("a/",))]
    assert src.read_term_rules(spark, str(tmp_path / "t.json"))[0].correct == "b"
    assert len(src.read_term_rules(spark)) == 4 and len(src.read_impact_rules(spark)) == 7
    assert src.read_impact_rules(spark, str(tmp_path / "i.json")) == [("*.py", ["d"])]
    assert rows(src.read_routes(spark, str(tmp_path / "r.json"))) == [("/a", "a", None)]
    with pytest.raises(Exception):
        src.read_routes(spark, str(tmp_path / "bad.json")).collect()


def test_facts(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"corpus": "c", "facts": {"modules": [{"name": "A", "active": "true"}], "routes": [{"method": "GET", "path": "/x"}]}}))
    assert rows(src.read_facts(spark, str(tmp_path / "f.json")), "category", "name", "active") == [("modules", "A", "true"), ("routes", "GET /x", None)]


def test_bundles(spark):
    text = "intro\n--- FILE: docs/a.md ---\n\n# A\n\n--- FILE: ../../etc/x ---\nbad\n---FILE:  /abs.md ---\n--- FILE: m/../b.md ---\nq"
    df = spark.createDataFrame([("c", text), ("d", "none")], "corpus STRING, content STRING")
    f = bundles.split_bundles(df, ["corpus"])
    assert rows(f, "file_no", "path", "content") == [(1, "docs/a.md", "# A\n"), (2, "../../etc/x", "bad\n"), (3, "/abs.md", "\n"), (4, "m/../b.md", "q\n")]
    assert rows(bundles.accepted(f), "output_path") == [("a.md",), ("b.md",)]
    assert rows(bundles.rejects(f), "path") == [("../../etc/x",), ("/abs.md",)]


def test_delimited(spark):
    df = spark.createDataFrame([(1, "Name\tN\n a \t1\nb\n"), (2, "only header")], "id INT, content STRING")
    got = bundles.split_delimited(df, ["id"]).select("id", "row_no", F.map_entries("record").alias("e"))
    assert [(r.id, r.row_no, dict(r.e)) for r in got.collect()] == [(1, 1, {"name": "a", "n": "1"}), (1, 2, {"name": "b", "n": ""})]


def test_catalog_sources(spark):
    opts = catalogs.jdbc_options("mysql", "tables", {"url": "jdbc:mysql://h/d"})
    assert opts["queryTimeout"] == "30" and "information_schema.TABLES" in opts["query"]
    spark.sql("CREATE DATABASE IF NOT EXISTS ca_test")
    spark.range(1).createOrReplaceTempView("v")
    parts = catalogs.read_spark_catalog(spark, "ca_test")
    assert rows(parts["tables"].where("table_name = 'v'"), "table_name") == [("v",)]
    assert rows(parts["columns"].where("table_name = 'v'"), "column_name", "column_type", "is_nullable") == [("id", "bigint", "NO")]
    spark.catalog.dropTempView("v")
    spark.sql("DROP DATABASE ca_test")


def test_sinks(spark, files, tmp_path):
    found = leakage.scan(files(("c", "a", "k1")), [LeakRule("r", "k1", "HIGH")])
    sinks.write_findings(found, str(tmp_path / "f"))
    sinks.write_findings(found, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).where("check = 'leak'").count() == 2
    entry = spark.createDataFrame([("n", "f")], "name STRING, mode STRING")
    sinks.append_run_log(entry, str(tmp_path / "log"))
    sinks.append_run_log(entry, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    blocks = spark.createDataFrame([("c", i, f"b{i}") for i in range(50)], "corpus STRING, k INT, block STRING")
    sinks.write_blocks(blocks.repartition(7), str(tmp_path / "out"), ["k"])
    parts = sorted(os.listdir(tmp_path / "out" / "corpus=c"))
    text = "".join((tmp_path / "out" / "corpus=c" / p).read_text() for p in parts if p.startswith("part"))
    assert text == "".join(f"b{i}\n" for i in range(50))


def test_stored_files_are_pruned(spark, files, tmp_path):
    sinks.write_files(files(("c", "a.md", "x"), ("c", "b.mmd", "y"), ("c", "c.py", "z"), ("c", "d.txt", "t")), str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    md = src.with_suffix(stored, [".md"])
    assert rows(md, "path") == [("a.md",)] and rows(src.with_suffix(stored, [".py", ".md"]), "path") == [("a.md",), ("c.py",)]
    assert "PartitionFilters: [isnotnull(kind" in md._jdf.queryExecution().executedPlan().toString()


def write_files(spark, where, *items):
    from corpusaudit.schemas import FILES

    spark.createDataFrame([(c, p, t, len(t), None) for c, p, t in items], FILES).coalesce(1).write.mode("append").parquet(str(where))


def test_streaming(spark, tmp_path):
    rules = [LeakRule("r", "k1", "HIGH")]
    write_files(spark, tmp_path / "in", ("c", "a", "k1"), ("c", "b", "no"))
    stream = lambda: incremental.stream_files(spark, str(tmp_path / "in"))
    go = lambda: incremental.start_leak_scan(stream(), rules, str(tmp_path / "o"), str(tmp_path / "cp")).awaitTermination()
    go()
    write_files(spark, tmp_path / "in", ("c", "d", "k1"))
    go()
    assert rows(spark.read.parquet(str(tmp_path / "o")), "path") == [("a",), ("d",)]


def test_recheck(spark, tmp_path):
    args = (str(tmp_path / "o"), str(tmp_path / "led"), str(tmp_path / "cp"))
    go = lambda: incremental.start_recheck(incremental.stream_files(spark, str(tmp_path / "in")), links.check_links, *args).awaitTermination()
    write_files(spark, tmp_path / "in", ("c", "a.md", "[x](no.md)"), ("c", "b.md", "fine"))
    go()
    write_files(spark, tmp_path / "in", ("c", "a.md", "[x](no.md)"), ("c", "b.md", "[y](gone.md)"))
    go()
    got = rows(spark.read.parquet(args[0]), "batch", "path")
    assert got == [(0, "a.md"), (1, "b.md")]
    assert incremental.known_hashes(spark, args[1]).count() == 2


def test_repeated_header_names(spark):
    from corpusaudit.sources import bundles

    df = spark.createDataFrame([("k", "A\tB\ta\n1\t2\t3\n4")], "id STRING, content STRING")
    got = [(r.row_no, r.record) for r in bundles.split_delimited(df, ["id"]).collect()]
    assert got == [(1, {"b": "2", "a": "3"}), (2, {"b": "", "a": ""})]


def test_texts_stay_where_they_lie(spark, files):
    df = files(("c", "routes/a.js", "app.get('/x', f)"), ("c", "b.md", "no link"), ("c", "package.json", '{"dependencies": {"express": "1"}}'))
    routes = endpoints.source_routes(df)
    assert rows(routes) == [("c", "GET", "/x")]
    # below each exchange the text has been replaced by what was found in it, or belongs to marker files
    for line in routes._jdf.queryExecution().executedPlan().toString().split("\n"):
        assert "Exchange" not in line or "content" not in line
    moved = diagrams.rewrite_diagram_links(df, df.limit(0))
    assert moved.where("rewritten").count() == 0 and moved.count() == 3
