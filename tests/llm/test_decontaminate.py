"""Benchmark passages against a search through all windows, without index and bounds."""

import math
import random
from collections import Counter

import numpy as np

from corpusaudit.llm import decontaminate
from corpusaudit.llm.decontaminate import B, K1, Index, contaminated, entries_of, words_of


def items_and_docs(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(150)] + ["the", "of"] * 30
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, text(r.randint(12, 40)) + ". " + text(r.randint(2, 8)) + ".") for i in range(40)]
    items += [(40, text(300)), (41, "What is w1 w2? " + text(6)), (42, None), (43, ""), (44, "w5 w6"), (45, items[3][1]), (None, text(20))]
    docs = []
    for i in range(80):
        parts = [text(r.randint(0, 400))]
        for _ in range(r.choice([0, 0, 1, 2])):
            _, t = r.choice(items)
            t = (t or "").split()
            if t and r.random() < 0.4:
                t[r.randrange(len(t))] = "changed"
            if r.random() < 0.3:
                t = t[: len(t) // 2]
            parts.insert(r.randrange(len(parts) + 1), " ".join(t).upper() if r.random() < 0.3 else " ".join(t))
            parts.append(text(r.randint(0, 300)))
        docs.append((i, "\n".join(parts)))
    return items, [*docs, (90, None), (91, ""), (None, docs[3][1]), (92, text(20_000) + " " + items[0][1]), (92, items[0][1])]


def shingles(w):
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(items, docs, threshold, similarity):
    entries = [(i, words, head) for i, t in items for words, head in entries_of(t or "")]
    df = Counter(w for _, e, _ in entries for w in set(e))
    mean = sum(len(e) for _, e, _ in entries) / len(entries)
    out = set()

    def impact(w, e):
        tf = e.count(w)
        return math.log(1 + (len(entries) - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(e) / mean))

    own = [sum(impact(w, e) for w in set(e)) for _, e, _ in entries]

    def part(e, window):
        return len(shingles(e) & {tuple(window[k : k + min(5, len(e))]) for k in range(len(window))}) / len(shingles(e))

    for d, t in docs:
        words = words_of(t or "")
        for a in range(0, max(1, len(words) - 128), 128):
            window = words[a : a + 256]
            for (i, e, head), total in zip(entries, own):
                if sum(impact(w, e) for w in set(window) & set(e)) / total >= threshold - 1e-12 and part(e, window) >= similarity:
                    if not head or min(part(e[:head], window), part(e[head:], window)) >= 0.5:
                        out.add((d, i))
    return out


def test_hits(spark, docs_of, monkeypatch):
    items, docs = items_and_docs()
    want = plain(items, docs, 0.5, 0.8)
    assert len(want) > 20
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = contaminated(docs_of(docs), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.score >= 0.5 and r.overlap >= 0.8 and min(r.question_overlap, r.answer_overlap) >= 0.5 for r in got)
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 1500)  # the benchmark in parts
    assert {(r.doc_id, r.item_id) for r in contaminated(docs_of(docs), benchmark).collect()} == want


def test_question_and_answer():
    assert [h for _, h in entries_of("What is it? A thing.")] == [3]
    assert [h for _, h in entries_of("One two. Three four five. Six")] == [5]
    assert [h for _, h in entries_of("only one sentence here")] == [0]
    assert entries_of("") == []


def test_another_answer_is_no_hit(spark, docs_of):
    question = " ".join(f"q{i}" for i in range(40)) + "?"
    benchmark = spark.createDataFrame([(1, f"{question} The answer is a1 a2 a3 a4.")], "item_id long, text string")
    docs = docs_of([(1, f"before {question} The answer is a1 a2 a3 a4. after"), (2, f"before {question} It was b1 b2 b3 b4 b5 b6."), (3, "The answer is a1 a2 a3 a4.")])
    assert [r.doc_id for r in contaminated(docs, benchmark).collect()] == [1]
    loose = {r.doc_id: r.answer_overlap for r in contaminated(docs, benchmark, parts_similarity=0.0).collect()}
    assert loose == {1: 1.0, 2: 0.0}


def test_repeated_items_are_one(spark, docs_of, monkeypatch):
    """Equal rows of an item are in one part of the index, once."""
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 200)
    built = []
    build = Index.build.__func__
    monkeypatch.setattr(Index, "build", classmethod(lambda cls, items, *rest: built.append(len(items)) or build(cls, items, *rest)))
    items = [(1, "one two three four five six")] * 500 + [(2, "one two three four five six"), (3, "seven eight nine ten eleven twelve")]
    docs = docs_of([(7, "x one two three four five six y")])
    got = contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(7, 1), (7, 2)] and sum(built) == 3


def test_empty_tables(spark, docs_of):
    benchmark = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contaminated(docs_of([(1, "a b c d e f")]), benchmark.where("item_id > 1")).collect() == []
    assert contaminated(docs_of([(1, "a b c d e f")]).where("doc_id > 1"), benchmark).collect() == []
    (row,) = contaminated(docs_of([(1, "x A b, c D e f!")]), benchmark).collect()
    assert (row.doc_id, row.item_id, row.passage, row.overlap) == (1, 1, 0, 1.0)


def test_bounds_hold():
    items = [(i, " ".join(f"w{(i * j) % 17}" for j in range(1, 12))) for i in range(1, 30)]
    entries = [w for _, t in items for w, _ in entries_of(t)]
    df = Counter(w for e in entries for w in set(e))
    index = Index.build(items, df, len(entries), 11.0)
    for terms in (np.arange(4), np.arange(len(index.words))):
        window, entry, score = index.retrieve(np.zeros(len(terms), np.int64), terms, 1, 0.3)
        every = np.zeros(len(entries))
        for t in terms:
            at = slice(index.post_start[t], index.post_start[t + 1])
            every[index.post_entry[at]] += index.post_impact[at]
        assert sorted(entry) == np.flatnonzero(every >= 0.3).tolist()
        assert np.allclose(score, every[entry])


def test_short_tails_and_short_items(spark, docs_of):
    r = random.Random(5)
    long = [[f"x{r.randrange(500)}" for _ in range(n - 1)] + ["the"] for n in (128, 129, 130, 257, 300)]
    for words in long:
        parts = [p for p, _ in entries_of(" ".join(words))]
        assert sum(parts, []) == words and max(map(len, parts)) <= 128
        assert len(words) <= 128 or min(map(len, parts)) >= 64
    items = [(i, " ".join(w)) for i, w in enumerate(long)] + [(10, "the"), (11, "of the")]
    docs = [(0, "all the clean texts"), (1, "some of the clean texts"), (2, "The!"), (3, "of the"), *((20 + i, "clean " + " ".join(w)) for i, w in enumerate(long))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = {(2, 10), (3, 11), *((20 + i, i) for i in range(5))}
    assert {(r.doc_id, r.item_id) for r in contaminated(docs_of(docs), benchmark).collect()} == {(1, 11), *whole}
    assert {(r.doc_id, r.item_id) for r in contaminated(docs_of(docs), benchmark, least_words=5).collect()} == whole
