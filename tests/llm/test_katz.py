"""The distributed backoff model against one computed in plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusaudit.llm import katz
from corpusaudit.llm.common import fold

WORDS = "the of and to a in that is was he for it with as his on be at by i".split()


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</s>"]


class Plain:
    """Unigrams and bigrams with Good-Turing discounts and Katz backoff, by definition."""

    def __init__(self, texts):
        self.uni, self.bi, self.ctx = Counter(), Counter(), Counter()
        for t in texts:
            before = "<s>"
            for w in tokens(t):
                self.uni[w] += 1
                self.bi[before, w] += 1
                self.ctx[before] += 1
                before = w
        self.n = sum(self.uni.values())
        self.d1, self.d2 = (self.discount(x) for x in (self.uni, self.bi))
        lost = sum(c * (1 - self.d1[c]) for c in self.uni.values() if c <= 5)
        self.size, self.unseen = (self.n, lost) if lost > 0 else (self.n + 1, 1.0)
        self.after = defaultdict(list)
        for (a, b), c in self.bi.items():
            self.after[a].append((b, c))

    @staticmethod
    def discount(counts):
        kinds = Counter(counts.values())
        d = defaultdict(lambda: 1.0)
        if kinds[1]:
            common = 6 * kinds[6] / kinds[1]
            for r in range(1, 6):
                if kinds[r] and common < 1:
                    x = ((r + 1) * kinds[r + 1] / (r * kinds[r]) - common) / (1 - common)
                    d[r] = x if 0 < x < 1 else 1.0
        return d

    def p1(self, w):
        c = self.uni[w]
        return (c * self.d1[c] if c else self.unseen) / self.size

    def p2(self, a, w):
        if not self.ctx[a]:
            return self.p1(w)
        pairs = self.after[a]
        size = self.ctx[a] + (0 if any(self.d2[c] < 1 for _, c in pairs) else 1)
        if self.bi[a, w]:
            c = self.bi[a, w]
            return c * self.d2[c] / size
        left = 1 - sum(c * self.d2[c] for _, c in pairs) / size
        return left / (1 - sum(self.p1(x) for x, _ in pairs)) * self.p1(w)

    def score(self, text):
        before, total = "<s>", 0.0
        for w in tokens(text):
            total += math.log10(self.p2(before, w))
            before = w
        return total


def some_docs(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = [r.choice(WORDS[: r.randint(2, 20)]) if r.random() < 0.8 else f"w{r.randint(0, 60)}" for _ in range(r.randint(0, 40))]
        out.append((i, " ".join(words) + r.choice(["", "\n", " The END é x"]), "x"))
    return [*out, (1000, None, "x"), (1001, "", None), (None, "the of and", "x"), (5, out[5][1], "x"), (1002, "zz yy " * 300, "x")]


@pytest.mark.parametrize("tokens_a_chunk", [50, 1 << 20])
def test_scores(spark, monkeypatch, tokens_a_chunk):
    monkeypatch.setattr(katz, "CHUNK_TOKENS", tokens_a_chunk)
    rows = some_docs(120, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    got = katz.katz_scores(docs, fold("doc_id", 7, 2), buckets=5).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    model = Plain([t for i, t, _ in rows if not held(i)])
    known = set(model.uni)
    assert len(got) == len(rows)
    want = sorted((str(i), held(i), len(tokens(t)), sum(w in known for w in tokens(t)), model.n, round(model.score(t), 6)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.score, 6)) for r in got) == want
    base = {i: sum(math.log10((model.uni[w] + 1) / (model.n + len(known) + 1)) for w in tokens(t)) for i, t, _ in rows}
    assert all(abs(base[r.doc_id] - r.base_score) < 1e-6 for r in got)
    for a in ["<s>", "the", "w7", "zz", "never"]:  # every context sums to one over words and the unseen event
        assert abs(sum(model.p2(a, w) for w in [*known, "\0unseen"]) - 1) < 1e-9


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert katz.katz_scores(docs.where("doc_id > 1"), F.lit(False)).collect() == []
    (row,) = katz.katz_scores(docs, F.lit(True)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)


def test_packing():
    r = np.random.default_rng(0)
    for n in (0, 1, 1000):
        keys = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        assert (katz.get_sorted(katz.put_sorted(keys)) == keys).all()
        values = r.integers(0, 600, n)
        assert (katz.get_small(b"xx" + katz.put_small(values), 2)[0] == values).all()


def test_counts_are_merged_in_little_memory():
    """Merging holds a few arrays as long as the bucket at a time, not one for each step."""
    import tracemalloc

    rng = np.random.default_rng(3)
    questions, n = [], 0
    for _ in range(6):
        keys = np.unique(rng.integers(1, 400_000, 100_000).astype(np.uint64))
        questions.append(katz._question(keys, katz.put_small(rng.integers(0, 3, len(keys)))))
        n += len(keys)
    tracemalloc.start()
    try:
        katz._merge_counts(questions, False)
        assert tracemalloc.get_traced_memory()[1] < 60 * n
    finally:
        tracemalloc.stop()
