"""The index of links against a full check of the newest files, after each batch."""

import random

import pytest
from pyspark.sql import functions as F

from corpusaudit import schemas
from corpusaudit.operators import links
from corpusaudit.streaming import incremental
from corpusaudit.streaming import link_index
from corpusaudit.streaming.link_index import TABLES, LinkIndex, add_batch, hashed, start_link_check
from tests.conftest import rows

FOUND = ["corpus", "path", "line_no", "url", "reason", "target_path", "anchor"]


def at(spark, items):
    """(corpus, path, content or None for gone, second)."""
    return spark.createDataFrame(
        [(c, p, t, None if t is None else len(t.encode()), s) for c, p, t, s in items], "corpus STRING, path STRING, content STRING, size LONG, s INT"
    ).select("corpus", "path", "content", "size", F.timestamp_seconds("s").alias("modified_at"))


def full_check(spark, newest):
    files = spark.createDataFrame([(c, p, t) for (c, p), t in newest.items() if t is not None], "corpus STRING, path STRING, content STRING")
    return rows(links.check_links(files, skip_fences=True), *FOUND)


def page(rng, names):
    out = [f"# {rng.choice(['One', 'Two', 'Three'])}"] if rng.random() < 0.8 else []
    for _ in range(rng.randint(0, 3)):
        out.append(f"[x]({rng.choice(['', '../', 'd/'])}{rng.choice(names)}{rng.choice(['', '#one', '#two'])}) [y](#three)")
    return "\n".join([*out, "```", "[no](gone.md)", "```", str(rng.random())])


@pytest.mark.parametrize("seed", [1, 2])
def test_as_the_full_check(spark, tmp_path, seed):
    rng = random.Random(seed)
    names = ["a.md", "b.md", "d", "c.txt", "d/e", "."]
    places = ["a.md", "b.md", "c.txt", "d/a.md", "d/b.md", "d/e/a.md", "d/e/c.txt"]
    index, newest = LinkIndex(spark, str(tmp_path)), {}
    for number in range(4):
        times = rng.sample(range(number * 10 + 12, number * 10 + 30), 18)  # some rows are late: older than what is known
        batch = [(rng.choice("xy"), rng.choice(places), None if rng.random() < 0.3 else page(rng, names), times[i]) for i in range(rng.randint(0 if number else 6, 6))]
        add_batch(index, at(spark, batch), number, skip_fences=True)
        for c, p, t, s in batch:
            if s >= newest.get((c, p), (None, -1))[1]:
                newest[c, p] = (t, s)
        assert rows(index.broken(), *FOUND) == full_check(spark, {k: t for k, (t, _) in newest.items()})


def test_only_what_points_to_a_change(spark, tmp_path):
    index = LinkIndex(spark, str(tmp_path))
    first = [("c", f"p{i}.md", f"[t](t{i % 3}.md#head)", 1) for i in range(30)]
    add_batch(index, at(spark, [*first, *[("c", f"t{i}.md", "# Head\nx", 1) for i in range(3)]]), 0)
    assert index.broken().count() == 0
    # the text below the heading changes: nothing points to that
    add_batch(index, at(spark, [("c", "t0.md", "# Head\ny", 2)]), 1)
    # a heading is lost, a file goes, and a row is repeated
    add_batch(index, at(spark, [("c", "t1.md", "# Other", 3), ("c", "t2.md", None, 3), ("c", "t2.md", None, 3), ("c", "t0.md", "# Head\ny", 3)]), 2)
    checked = {r["batch"]: r["n"] for r in index.read("checks").groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert checked == {0: 30, 2: 20}
    assert {(r.path, r.reason) for r in index.broken().collect()} == {
        (f"p{i}.md", "anchor not found" if i % 3 == 1 else "file not found") for i in range(30) if i % 3
    }
    # both come back; a late row of an older state changes nothing
    add_batch(index, at(spark, [("c", "t1.md", "# Head", 4), ("c", "t2.md", "# Head", 4), ("c", "t0.md", "none", 1)]), 3)
    assert index.broken().count() == 0
    assert all("content" not in t for t in TABLES.values())


@pytest.mark.parametrize("broadcast", [True, False])
def test_new_texts_stay(spark, monkeypatch, broadcast):
    """Texts are not shuffled where all rows of a batch are new, or few are, or few are not."""
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(link_index, "fits_broadcast", lambda df: broadcast)
    key = ["corpus", "path", "sha256", "modified_at"]
    try:
        for items, new in (
            ([("c", "a", "x", 1), ("c", "b", "y", 1)], "ab"),
            ([("c", "a", "x", 1), ("c", "a", "x", 1), ("c", "a", "z", 2), (None, "d", "n", 1), ("c", "b", None, 1), ("c", "b", "y", 2), ("c", "e", "x", 1)], "be"),
            ([("c", "a", "x", 1), (None, "d", "n", 1), ("c", "a", "x", 1)], "a"),
        ):
            batch = hashed(at(spark, items))
            fresh = batch.where(F.col("is_there") & (F.col("path").isin(*new) | F.col("corpus").isNull())).select(key).distinct().persist()
            texts, once = link_index.new_texts(batch, fresh)
            want = batch.join(fresh, key, "left_semi").select("corpus", "path", "content")
            assert rows(texts) == rows(want) and once == (len(items) == 2)
            assert not once or "Exchange" not in texts._jdf.queryExecution().executedPlan().toString()
            if broadcast:
                assert "SortMergeJoin" not in texts._jdf.queryExecution().executedPlan().toString()
            fresh.unpersist()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)


def test_replayed_batch(spark, tmp_path):
    index = LinkIndex(spark, str(tmp_path))
    add_batch(index, at(spark, [("c", "a.md", "[x](b.md) [y](d)", 1), ("c", "d/b.md", "", 1)]), 0)
    for _ in range(2):
        add_batch(index, at(spark, [("c", "b.md", "", 2), ("c", "d/b.md", None, 2)]), 1)
        assert rows(index.broken(), "path", "url", "reason") == [("a.md", "d", "file not found")]
    assert rows(index.broken(0), "url") == [("b.md",)]


def test_stream(spark, tmp_path):
    def add(*items):
        spark.createDataFrame([(c, p, t, None if t is None else 1, None) for c, p, t in items], schemas.FILES).write.mode("append").parquet(f"{tmp_path}/in")
        stream = incremental.stream_files(spark, f"{tmp_path}/in")
        start_link_check(stream, f"{tmp_path}/index", f"{tmp_path}/cp", ignore=["skip*"]).awaitTermination()
        return rows(LinkIndex(spark, f"{tmp_path}/index").broken(), "path", "url")

    assert add(("c", "a.md", "[x](b.md) [s](skipped.md)"), ("c", "i.png", "")) == [("a.md", "b.md")]
    assert add(("c", "b.md", "[x](a.md) [p](i.png)")) == []
    assert add(("c", "a.md", None)) == [("b.md", "a.md")]
