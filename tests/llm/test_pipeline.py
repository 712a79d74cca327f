"""Stages of the pipeline, each against the rule it follows, on whole tables and on awkward rows."""

import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from corpusaudit.llm.common import written
from corpusaudit.llm.decontaminate import words_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(10_000, None, "en", "src0", 0), (10_001, "", "en", "src0", 0), (10_002, "12 34 !", None, None, 0), (None, "The and of this text is for all to be in it.", "en", "src1", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).union(docs.where("doc_id = 7"))
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), f"test-{name}"))
    return [x.collect() for x in out], out


def test_columns_and_order(stages):
    frames = stages[1]
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "benchmark", "mixture", "tokens"]
    assert all(f.columns == frames[0].columns for f in frames[:-1])


def test_language_rejects_only_what_has_no_letters(stages):
    before, after = stages[0][:2]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {10_000, 10_001, 10_002}


def jaccard(a, b, size=5):
    one, two = ({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(one & two) / len(one | two)


def test_one_of_each_group_stays(spark, stages):
    before, after = stages[0][1:3]
    text = {r.doc_id: r.text or "" for r in before if r.doc_id is not None}
    left = [r.doc_id for r in after if r.doc_id is not None]
    assert len(left) == len(set(left))
    ids = sorted(text)
    best = {i: max((jaccard(text[i], text[j]) for j in ids if j != i), default=0) for i in ids}
    near = {i: max((jaccard(text[i], text[j]) for j in ids if j < i), default=0) for i in ids}
    # what has a similar document with a smaller id goes, what is like no other stays; between 0.7 and 0.85 either may be
    assert all(i not in left for i in ids if near[i] >= 0.85) and all(i in left for i in ids if best[i] < 0.65)
    assert any(x >= 0.85 for x in near.values())


def test_columns_of_any_name(spark, tmp_path):
    """Columns with names of the work on documents come through unchanged, and very long and empty texts too."""
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 9)))
    texts = [" ".join(word() for _ in range(300)) for _ in range(20)] + [" ".join(word() for _ in range(200_000)), "", None]
    names = ["copy", "copies", "document_key", "taken_key", "hit_key", "kept_key", "document", "key", "id", "fp", "node", "a.b", "row", "size", "rest"]
    rows = [(i, t, "en", f"s{i % 3}", 0, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema).repartition(3)
    spark.createDataFrame([(1, "none of these words at all is here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(5, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    one = written(pipeline.one_of_each_group(spark, docs, str(tmp_path)), "test-names")
    # the null and the empty text are alike
    assert sorted(map(tuple, one.collect())) == sorted(r for r in rows if r[0] < 22)
    two = written(pipeline.without_benchmark(spark, one, str(tmp_path)), "test-names")
    assert sorted(map(tuple, two.collect())) == sorted(map(tuple, one.collect()))
    three = pipeline.mixed(spark, two, str(tmp_path))
    assert three.columns == docs.columns and set(map(tuple, three.collect())) <= set(map(tuple, one.collect()))


def test_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), f"test-{name}")
        assert docs.count() == 0


def test_benchmark_documents_go(spark, stages):
    before, after = stages[0][2:4]
    items = [" " + " ".join(words_of(r.text)) + " " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    has = {r.doc_id for r in before for t in [" " + " ".join(words_of(r.text)) + " "] if any(i in t for i in items)}
    assert has and {r.doc_id for r in before} - {r.doc_id for r in after} == has


def test_mixture(stages):
    before, after = stages[0][3:5]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    copies = {}
    for r in after:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies.values()) <= {1, 2}
    assert sum(map(size, after)) == pytest.approx(1.5 * sum(map(size, before)), rel=0.05)
    assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}


def test_tokens(stages):
    before, after = stages[0][4:6]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((str(r.doc_id), len(tok.encode(r.text, add_special_tokens=False).ids) + 1) for r in before)
    assert sorted((str(r.doc_id), r.n_tokens) for r in after) == want


def test_run(spark):
    out = pipeline.run(spark, SF)
    assert out.count() > 100 and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert pipeline.ORACLE_SQL is None


def test_rows_with_null_or_repeated_ids_are_judged_for_themselves(spark, tmp_path):
    import random

    r = random.Random(11)
    texts = [" ".join(f"w{r.randrange(5000)}" for _ in range(200)) for _ in range(6)]
    item = " ".join(f"b{i}" for i in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(5, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (1, texts[4])]
    rows = [*clean, (5, texts[4]), (None, texts[4]), (None, texts[0] + " " + item + " " + texts[5]), (5, texts[5] + " " + item + " " + texts[1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    order = lambda found: sorted(found, key=str)
    one = written(pipeline.one_of_each_group(spark, docs.unionAll(docs.limit(3)).repartition(4), str(tmp_path)), "test-rows")
    assert order((x.doc_id, x.text) for x in one.collect()) == order([*clean, *rows[7:]])
    two = written(pipeline.without_benchmark(spark, one, str(tmp_path)), "test-rows")
    assert order((x.doc_id, x.text) for x in two.collect()) == order(clean)
    copies = {}
    for x in pipeline.mixed(spark, two, str(tmp_path)).collect():
        copies[x.doc_id, x.text] = copies.get((x.doc_id, x.text), 0) + 1
    # 1.5 times five texts of 200 words: seven texts and no half one
    assert set(copies) == set(clean) and sorted(copies.values()) == [1, 1, 1, 2, 2]
