"""Spelling variants against all pairs of words."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpusaudit.llm import queries, spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(counts, ratio=5):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def table_of(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("part", F.lit("x")).repartition(4)


def got(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


@pytest.mark.parametrize("letters, seed", [("ab", 1), ("abcdeé", 2), ("aßÀ😀", 3)])
def test_against_all_pairs(spark, letters, seed):
    rng = random.Random(seed)
    counts = {"".join(rng.choices(letters, k=rng.randint(1, 8))): 5 ** rng.randint(0, 6) + rng.randint(0, 1) for _ in range(400)}
    assert got(spelling.group_variants(table_of(spark, counts))) == expected(counts)


def test_parts_and_passes(spark, monkeypatch):
    """Lengths in several parts and filters in several passes lose no pair."""
    rng = random.Random(4)
    counts = {"".join(rng.choices("abc", k=rng.randint(5, 7))): rng.randint(1, 500) for _ in range(700)}
    monkeypatch.setattr(spelling, "PART_WORDS", 50)
    sizes = spelling.shards(table_of(spark, counts))
    assert max(p for p, _ in sizes.values()) > 3 and len(spelling.passes(sizes, 300)) > 3
    assert all(sum(8 * sizes[k][1] for k, _ in p) <= 300 for p in spelling.passes(sizes, 300))
    assert got(spelling.group_variants(table_of(spark, counts), budget=300)) == expected(counts)


def test_long_chain_of_forms(spark):
    counts = {"a" * (i + 3): 5**i for i in range(13)}
    out = got(spelling.group_variants(table_of(spark, counts)))
    assert out == expected(counts) and {r[2] for r in out} == {"a" * 15}


def test_ties_rows_and_empty(spark):
    counts = {"aaaa": 1, "aaab": 7, "aaaz": 7, "aaa": 7, "zzzz": 5, "zzzy": 25, "yyyy": 5, "yyyx": 24}
    rows = [*counts.items(), (None, 9), ("", 9), ("solo", None)]
    halves = [(w, n) for w, n in rows if w != "zzzy"] + [("zzzy", 12), ("zzzy", 13)]
    out = got(spelling.group_variants(spark.createDataFrame([r for r in halves if r[0] != "solo"], "word string, n long")))
    assert out == expected(counts)
    assert dict((r[0], r[1]) for r in out)["aaaa"] == "aaa"
    assert got(spelling.group_variants(spark.createDataFrame([], "word string, n long"))) == []
    assert got(spelling.group_variants(spark.createDataFrame([("a", 3)], "word string, n long"))) == [("a", None, "a", 3, 0, None)]
    assert len(got(spelling.group_variants(spark.createDataFrame([("x" * 3000, 3), ("x" * 2999, 30)], "word string, n long")))) == 2


def test_word_counts(docs_of):
    long = "Straße-straße ÉCOLE_école École " * 20_000
    rows = [(1, long), (2, None), (3, ""), (None, "abcdef " * 7), (4, "abcdef1abcdefg Abcdefg abcdefG ABCDEFG abcdefg"), (4, "abcdef " * 3), (5, "x" * 100_000)]
    df = docs_of([(i, t) for i, t in rows])
    plain = {r["word"]: r["n"] for r in spelling.word_counts(df).collect()}
    assert plain == {"straße": 40_000, "abcdef": 11, "abcdefg": 5}
    counts = {}
    for i, t in rows:
        for w in __import__("re").findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in w)
            h = zlib.crc32(f"{i}:{w}".encode()) if i is not None else 1
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w
            if len(w) >= 6:
                counts[w] = counts.get(w, 0) + 1
    want = {w: n for w, n in counts.items() if n >= 5}
    assert {r["word"]: r["n"] for r in spelling.word_counts(df, edit=queries.misspelled).collect()} == want
