"""Languages: held-out accuracy, kernels against sets, and what has no letters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusaudit.llm import language
from corpusaudit.llm.common import fold
from corpusaudit.llm.language import fit, fit_language_model, keep_known_languages, predict_languages

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_held_out_accuracy(docs):
    model = fit_language_model(docs.where(~fold("doc_id", 4, 2)), per_language=40)
    rows = predict_languages(docs, model).join(docs.select("doc_id", "lang", fold("doc_id", 4, 2).alias("held")), "doc_id").where("held").collect()
    assert len(rows) > 30
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_kernel_counts_shared_grams():
    def grams(t):
        t = f" {t.lower()} "
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    texts = [("en", "abc abd"), ("fr", "xyz aéé"), ("en", "bcd cab")]
    model = fit(texts, landmarks=3)
    known = set().union(*(grams(t) for _, t in texts))
    order = [texts[0][1], texts[1][1], texts[2][1]]
    for t in ["abc xyz", "ABD", "éa bcd"]:
        mine = grams(t) & known
        want = [len(mine & grams(x)) / np.sqrt(len(mine) * len(grams(x))) for x in order]
        assert np.allclose(model.features([t])[0, :-1], want, atol=1e-5)


def test_edges(spark, docs_of, docs):
    model = fit_language_model(docs, per_language=40)
    long = "The only one of these that will be and is for the others. " * 20_000
    rows = docs_of([(1, None), (2, ""), (3, "12 ... 漢字"), (4, "123 -- !"), (None, long), (5, "x"), (5, "x")])
    got = {(r.doc_id, r.lang_pred == "und", r.score == 0) for r in predict_languages(rows, model).collect()}
    assert {(1, True, True), (2, True, True), (4, True, True)} <= got
    assert (None, False, False) in got and (3, True, True) not in got
    kept = keep_known_languages(rows, model)
    assert kept.columns == rows.columns and not {1, 2, 4} & {r.doc_id for r in kept.collect()}
    nothing = fit_language_model(docs_of([(1, "a", None), (2, None, "en"), (3, "..", "en")]))
    assert {r.lang_pred for r in predict_languages(rows, nothing).collect()} == {"und"}
    assert predict_languages(rows.where("doc_id < 0"), model).collect() == []


def test_languages_that_were_not_learned_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) >= 100")
    languages = sorted(r.lang for r in docs.select("lang").distinct().collect())
    foreign = [
        "Быстрая коричневая лиса прыгает через ленивую собаку и бежит дальше в тёмный лес",
        "Nopea ruskea kettu hyppää laiskan koiran yli ja juoksee metsään, jossa on paljon puita",
        "素早い茶色の狐はのろまな犬を飛び越える",
        "Γρήγορη",
    ]
    for out in [None, *languages]:
        learned = docs.where(F.col("lang") != F.lit(out)) if out else docs
        taught = learned.where("doc_id % 2 = 0")
        model = language.fit_language_model(taught, calibrate=True)
        asked = learned.where("doc_id % 2 = 1")
        assert language.keep_known_languages(asked, model).count() >= 0.95 * asked.count()
        assert language.keep_known_languages(spark.createDataFrame([(t,) for t in foreign], "text string"), model).count() == 0
        if out:
            strange = docs.where(F.col("lang") == F.lit(out))
            assert language.keep_known_languages(strange, model).count() <= 0.05 * strange.count()
