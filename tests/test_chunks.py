"""Documents in chunks give what the same documents give as one row, wherever they are cut."""

import random

import pytest
from pyspark.sql import functions as F

from corpusaudit.operators import chunks, lines
from corpusaudit.sources import bundles
from corpusaudit.sources import chunks as source
from tests.conftest import rows

HEADER = lambda l: F.contains(l, F.lit("name"))


def cut(rng, text):
    """Chunks of whole lines, in blocks."""
    out, block, seq, held = [], 0, 0, []
    for line in text.splitlines(keepends=True):
        held.append(line)
        if rng.random() < 0.5:
            out.append((block, seq, "".join(held)))
            held, seq = [], seq + 1
            if rng.random() < 0.4:
                block, seq = block + rng.randint(1, 900), 0
    return [*out, *([(block, seq, "".join(held))] if held else [])]


def both(spark, texts, seed):
    rng = random.Random(seed)
    pieces = [("c", p, *c) for p, t in texts.items() for c in cut(rng, t)]
    rng.shuffle(pieces)
    whole = spark.createDataFrame([("c", p, t) for p, t in texts.items()], "corpus STRING, path STRING, content STRING")
    return spark.createDataFrame(pieces, source.CHUNKS), whole


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    parts = ["```", " ```sql", "| name | b |", "|--|--|", "| x | y |", " | z | 1 |", "plain", "", "--- FILE: a/b.md ---", "x --- FILE:  c.md --- y", "# Head"]
    out = {f"p{i}": "\n".join(rng.choices(parts, k=rng.randint(1, 30))) + "\n" * rng.randint(0, 2) for i in range(60)}
    return {**out, "open": "a\n```\n" + "x\n" * 300, "table": "| name |\n" + "| r |\n" * 300}


def test_fences_prose_tables(spark, texts):
    pieces, whole = both(spark, texts, 1)
    cols = ["corpus", "path", "line_no", "line", "is_marker", "in_fence", "fence_no"]
    assert rows(chunks.fenced_lines(pieces), *cols) == rows(lines.explode_fenced_lines(whole), *cols)
    assert rows(chunks.prose_lines(pieces)) == rows(lines.prose_lines(whole))
    table = lambda df: sorted((r.path, tuple(r.header), tuple(r.cells)) for r in df.collect())
    assert table(chunks.table_rows_of(pieces, HEADER)) == table(lines.table_rows(whole, HEADER))


def test_bundles(spark, texts):
    pieces, whole = both(spark, texts, 2)
    want = bundles.split_bundles(whole.withColumnRenamed("path", "bundle"), ["corpus", "bundle"])
    got = source.join_pieces(source.split_bundle_chunks(pieces))
    have = {(r.bundle, r.file_no): (r.path, r.content) for r in got.collect()}
    # a file without any text has no piece
    assert have == {(r.bundle, r.file_no): (r.path, r.content) for r in want.collect() if r.content != "\n" or (r.bundle, r.file_no) in have}
    again = source.split_bundle_chunks(pieces).where("file_no = 1").select("corpus", F.col("bundle").alias("path"), "block", "seq", "content")
    assert chunks.fenced_lines(again).count() > 0


@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
def test_text_files_cut_at_any_byte(spark, texts, tmp_path, size):
    """Spark cuts the files into splits of any size in bytes; the result is that of whole files."""
    odd = {"d e/é+%20.md": "é\r\n```\r\nü\r\n" * 40, "x.md": texts["open"], "empty.md": "", "z.md": "| name |\n" + "| r |\n" * 50}
    for path, text in odd.items():
        (tmp_path / "corp" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "corp" / path).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        pieces = source.read_chunks(spark, str(tmp_path), chunk_bytes=max(size, 50))
        whole = spark.createDataFrame([("corp", p, t) for p, t in odd.items()], "corpus STRING, path STRING, content STRING")
        cols = ["path", "line_no", "line", "is_marker", "in_fence", "fence_no"]
        assert rows(chunks.fenced_lines(pieces), *cols) == rows(lines.explode_fenced_lines(whole), *cols)
        blocks = {(r.path, r.n) for r in pieces.groupBy("path").agg(F.count_distinct("block").alias("n")).collect()}
        assert size > 64 or max(n for _, n in blocks) > 3
        text = {p: "".join(r.content for r in sorted(pieces.where(F.col("path") == p).collect(), key=lambda r: (r.block, r.seq))) for p in odd}
        assert text == {p: t.replace("\r\n", "\n") for p, t in odd.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_nothing(spark):
    none = spark.createDataFrame([], source.CHUNKS)
    assert chunks.fenced_lines(none).count() == chunks.table_rows_of(none, HEADER).count() == source.split_bundle_chunks(none).count() == 0


def test_only_summaries_are_ordered(spark, texts):
    pieces, _ = both(spark, texts, 3)
    plan = chunks.fenced_lines(pieces)._jdf.queryExecution().optimizedPlan().toString()
    assert all("content" not in l for l in plan.split("\n") if "Window [" in l)
