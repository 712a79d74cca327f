"""Properties that matter at scale, checked on small data with small limits."""

import re

import pytest
from pyspark.sql import functions as F

from corpusaudit.operators import leakage, lines, links, migrations, quality
from corpusaudit.operators.joins import fits_broadcast, join_per_corpus
from corpusaudit.operators.leakage import LeakRule
from corpusaudit.plans import QUERIES
from corpusaudit.session import checkpoint_dir, spread, stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def conf(spark):
    changed = {}

    def put(**values):
        for key, value in values.items():
            key = key.replace("__", ".")
            changed[key] = spark.conf.get(key, None)
            spark.conf.set(key, value)

    yield put
    for key, value in changed.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_text_work_does_not_shuffle(files):
    df = files(("c", "a.md", "# a\n```\nx\n```\n1234"))
    for out in (
        lines.explode_fenced_lines(df),
        lines.sections(df),
        leakage.scan(df, [LeakRule("n", r"\d", "LOW")]),
        leakage.wrong_terms(df),
        links.markdown_links(df),
        quality.file_metrics(df.withColumn("project", F.lit("p"))),
    ):
        assert "Exchange" not in plan(out) and "Window" not in plan(out)


def test_hot_target_is_split(spark, conf):
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="10KB",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="10KB",
    )
    pages = spark.range(0, 20000, 1, 16).selectExpr(
        "'c' AS corpus", "concat('p', id, '.md') AS path", "concat('[a](hot.md) [b](p', id + 1, '.md)') AS content"
    )
    out = links.check_links(pages)
    got = [r.target_path for r in out.collect()]
    assert got.count("hot.md") == 20000 and got.count("p20000.md") == 1 and len(got) == 20001
    # the plan as it ran
    assert re.search(r"skew=true", plan(out))


def test_hot_corpus_is_spread(spark):
    rows = spark.range(3200).selectExpr("'big' AS corpus", "concat('p', id) AS path")
    facts = spark.createDataFrame([("big", 1)], "corpus STRING, x INT")
    joined = join_per_corpus(rows, facts, ["path"])
    assert joined.count() == 3200 and joined.where("x = 1").count() == 3200
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = rows.select(F.pmod(F.xxhash64("path"), F.lit(n)).alias("s")).groupBy("s").count()
    assert salts.count() == n and salts.agg(F.max("count")).first()[0] < 1.5 * rows.count() / n


def test_facts_do_not_grow_with_the_partitions(spark, conf):
    """Many corpora: a fact row is not repeated for every partition of the session."""
    conf(spark__sql__shuffle__partitions="200", spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__coalescePartitions__enabled="false")
    facts = spark.range(100).selectExpr("concat('c', id) AS corpus", "id AS x")
    joined = join_per_corpus(facts.selectExpr("corpus", "concat('p', x) AS path"), facts, ["path"])
    assert joined.where("path = concat('p', x)").count() == joined.count() == 100
    last = re.search(r"explode\(sequence\(0, (\d+)", joined._jdf.queryExecution().analyzed().toString()).group(1)
    assert int(last) < 8


def test_broadcast_is_counted(spark):
    df = spark.range(100).selectExpr("repeat('x', 100) AS needle")
    assert fits_broadcast(df, rows=100, size=10_000)
    assert not fits_broadcast(df, rows=99) and not fits_broadcast(df, size=9_999)


def test_hot_table_history(spark):
    ev = spark.range(5000).selectExpr(
        "'c' AS corpus", "lpad(cast(id AS string), 6, '0') AS file", "1 AS step", "if(id = 10, 'create', 'alter') AS action", "'t' AS table_name"
    )
    assert migrations.table_history(ev).first().modified_files == 4989


def test_spread_only_small_scans(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.read.parquet(str(tmp_path / "one"))).rdd.getNumPartitions() == cores
    assert spread(spark.range(0, 100, 1, cores + 3)).rdd.getNumPartitions() == cores + 3


def test_checkpoint_folder_is_named_by_the_session(spark):
    assert checkpoint_dir(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())


def test_pairs_of_a_cluster_are_not_rows(spark, tmp_path):
    """Edges are counted from the members of clusters; a document that comes twice counts its pairs as often."""
    from corpusaudit.plans import QUERIES

    texts = [(1, "a b c a b d"), (2, "x"), (3, "p q"), (3, "p q"), (4, None)]
    spark.createDataFrame(texts, "doc_id LONG, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["q_cut_totals"](spark, str(tmp_path))
    assert {r.doc_id: (r.edges, r.kept_inside) for r in out.collect()} == {1: (4, True), 3: (4, True)}
    assert plan(out).split("== Initial Plan ==")[-1].count("Generate explode") == 1
    df = spark.createDataFrame([(1, None), (2, "ä")], "n INT, t STRING")
    assert sorted(map(str, stored(df).collect())) == sorted(map(str, df.collect())) and stored(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["q_cut_edges", "q_cut_totals"])
def test_words_are_not_shuffled(spark, tmp_path, conf, name):
    """Texts are dealt by document once, with numbers of clusters; edges and nodes are found in the partitions of that."""
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    spark.createDataFrame([(1, "a b c a b d"), (3, "p q"), (3, "p r"), (None, "x y")], "doc_id LONG, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES[name](spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == {1, 3}
    assert "ENSURE_REQUIREMENTS" not in plan(out)


@pytest.mark.parametrize("name, tables", [("q_source_routes", ["supplier", "customer", "part"]), ("q_translate_diagrams", ["part"])])
def test_tables_of_one_split_are_spread(spark, tmp_path, name, tables):
    """What is distinct in a task before the shuffle is a share of a small table, not all that is made of it."""
    made = {
        "supplier": ["id AS s_suppkey"],
        "customer": ["id AS c_custkey", "CAST(id AS DOUBLE) - 2 AS c_acctbal"],
        "part": ["id AS p_partkey", "'PROMO' AS p_type", "'Brand#1' AS p_brand", "concat('red ', id) AS p_name", "CAST(id * 9 AS INT) AS p_size"],
    }
    for t in tables:
        spark.range(5).selectExpr(*made[t]).coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    df = QUERIES[name](spark, str(tmp_path))
    optimised = df._jdf.queryExecution().optimizedPlan().toString()
    assert optimised.count("Repartition") >= optimised.count("Relation [") > 0
    assert df.count() == (5 * 2 + 2 + 3 * 5 + 5 * 7 if name == "q_source_routes" else 5)
