"""Periodic runs against every period at every place."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from corpusaudit.llm import periodic_runs, queries

DATA = "/root/testdata"


def brute_runs(words, exponent=4, least=6):
    """Every period at every place; of equal stretches the smallest period."""
    n, best = len(words), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            a = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - a >= max(least, exponent * p):
                best.setdefault((a, i + p), p)
    return sorted((a, b - a, p) for (a, b), p in best.items())


def texts():
    rng = random.Random(7)
    for _ in range(400):
        n, letters = rng.randint(0, 60), rng.choice(["a", "ab", "abc"])
        yield rng.choices(letters, k=n)
    for _ in range(200):  # powers, with errors and stretches of others around them
        base = rng.choices("abcd", k=rng.randint(1, 6))
        words = rng.choices("ab", k=rng.randint(0, 5)) + base * rng.randint(2, 9) + base[: rng.randint(0, len(base))]
        words += rng.choices("abcd", k=rng.randint(0, 5)) + base * rng.randint(1, 6)
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = "x"
        yield words


def test_against_every_period():
    many = [[w.encode() for w in t] for t in texts()]
    for got, words in zip(periodic_runs.runs_of_texts(many), many):
        assert got == brute_runs(words), words
    for got, words in zip(periodic_runs.runs_of_texts(many, 2, 2), many):
        assert got == brute_runs(words, 2, 2), words
    for got, words in zip(periodic_runs.runs_of_texts(many, 3, 1), many):
        assert got == brute_runs(words, 3, 1), words


def test_order_and_common_prefixes():
    rng = np.random.default_rng(1)
    t = rng.integers(0, 2, 300)
    levels = periodic_runs.ranks(t, np.full(300, 300))
    order = np.argsort(levels[-1])
    suffixes = sorted(range(300), key=lambda i: t[i:].tolist())
    assert order.tolist() == suffixes
    lcp = periodic_runs.common_prefixes(levels, order[:-1], order[1:])
    for k, (a, b) in enumerate(zip(order[:-1], order[1:])):
        x, y = t[a:].tolist(), t[b:].tolist()
        assert lcp[k] == next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))


@pytest.mark.parametrize("words, runs", [
    ([b"a"] * 300_000, [(0, 300_000, 1)]),
    ([b"a", b"b", b"c"] * 70_000, [(0, 210_000, 3)]),
    (sum(([str(i).encode(), *[b"a"] * 7] for i in range(20_000)), []), 20_000),
    (sum(([str(i).encode(), *b"p q r s t".split()] for i in range(30_000)), []), 0),
    ([str(i).encode() for i in range(50_000)] * 4, [(0, 200_000, 50_000)]),
])
def test_very_long_texts(words, runs):
    start = time.time()
    got = periodic_runs.runs_of_texts([words])[0]
    assert (len(got) if isinstance(runs, int) else got) == runs
    assert time.time() - start < 30


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(((-m, s, q) for s, m, q in runs), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    first = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *first, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped))


def test_query(spark, docs_of, tmp_path):
    """The whole query on a small fixture."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["a", "b", "é", "d\u00a0e"], k=rng.randint(0, 120)))) for i in range(250)]
    rows += [(None, "a " * 9), (None, None), (7, None), (7, "x\ty\n" * 30), (8, ""), (9, " \r\x0b"), (10, "lone")]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((plain(*r) for r in rows), key=str)
    assert any(r[1] > 1 for r in got)


def test_empty_table_and_columns(spark, docs_of):
    assert periodic_runs.periodic_runs(docs_of([(1, "a")]).limit(0)).collect() == []
    out = periodic_runs.periodic_runs(docs_of([(1, "a " * 8 + "b")])).collect()
    assert [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out] == [(1, 9, [(0, 8, 1)], "a b")]


def test_query_on_given_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: plain(r["doc_id"], r["text"]) for r in docs if len(r["text"] or "") < 6000}
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, f"{DATA}/sf0.001").collect()}
    assert len(want) > 150 and {i: got[i] for i in want} == want
