"""Wide fingerprints: search against all pairs, recall by similarity, clean documents left alone."""

import random

import numpy as np
import pytest

from corpusaudit.llm import simhash_wide as wide


def near(fps, most):
    a = np.bitwise_count(fps[:, None] ^ fps[None]).sum(-1)
    return {(i, j) for i, j in zip(*np.nonzero(a <= most)) if i < j}


def parts(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def flipped(rng, n, most, groups=4):
    """Fingerprints in groups that differ in up to ``most`` bits from a centre."""
    centres = rng.integers(0, 1 << 63, (groups, wide.WORDS), dtype=np.uint64)
    bits = np.unpackbits(centres[rng.integers(0, groups, n)].view(np.uint8), axis=1)
    for row in bits:
        row[rng.choice(wide.BITS, rng.integers(0, most + 1), replace=False)] ^= 1
    return np.unique(np.packbits(bits, axis=1).view(np.uint64), axis=0)


@pytest.mark.parametrize("seed", [1, 2])
def test_search_finds_all_links(seed):
    rng = np.random.default_rng(seed)
    fps = flipped(rng, 300, 40)
    most = wide.most_bits(0.8)
    index = wide.GrayIndex(fps)
    q, m = index.search(fps, most)
    members = [x.tobytes() for x in index.members]
    at = {x.tobytes(): i for i, x in enumerate(fps)}
    assert {(i, at[members[j]]) for i, j in zip(q.tolist(), m.tolist()) if i < at[members[j]]} == near(fps, most)
    want = parts(len(fps), near(fps, most))
    a, b = wide.linked_tree(fps, most)
    assert len(a) < len(fps) and parts(len(fps), zip(a.tolist(), b.tolist())) == want
    sizes = np.array([1, 40, 0, 2, 30])
    n, ends = sizes.sum(), np.cumsum(sizes)
    a, b = wide.small_trees(fps[:n], sizes, most)
    inside = [(i, j) for i, j in near(fps[:n], most) if np.searchsorted(ends, i, "right") == np.searchsorted(ends, j, "right")]
    assert len(a) < n and parts(n, zip(a.tolist(), b.tolist())) == parts(n, inside)


def test_chunks_of_a_hot_node(spark, monkeypatch):
    """A group larger than a chunk stays one component, though no search sees all of it."""
    monkeypatch.setattr(wide, "CHUNK", 40)
    fps = flipped(np.random.default_rng(3), 500, 8, groups=2)
    df = spark.createDataFrame([(bytearray(x.tobytes()),) for x in fps], "fp binary").repartition(4)
    found = {bytes(r.fp): bytes(r.part) for r in wide.joined(df, wide.most_bits(0.8)).collect()}
    assert set(found) == {x.tobytes() for x in fps} and len(set(found.values())) == 2
    # what one order has joined is not written again by the next
    known = spark.createDataFrame([(bytearray(f), bytearray(p)) for f, p in found.items()], "fp binary, part binary")
    assert wide.links(known, 1, wide.most_bits(0.8)).count() == 0


def changed(rng, words, k):
    out = list(words)
    for i in rng.sample(range(len(words)), k):
        out[i] = f"x{rng.randrange(10**9)}"
    return " ".join(out)


def similarity(a, b):
    one, two = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(one & two) / len(one | two)


def test_recall_and_clean_documents(spark):
    """Texts of 200 and of 1000 words with one, five and ten changed words, by the similarity that leaves."""
    rng = random.Random(5)
    rows, pairs = [], []
    for n in (200, 1000):
        for k in (1, 5, 10):
            for _ in range(60):
                words = [f"w{rng.randrange(20_000)}" for _ in range(n)]
                a, b = " ".join(words), changed(rng, words, k)
                pairs.append((similarity(a, b), len(rows), n, k))
                rows += [(len(rows), a), (len(rows) + 1, b)]
    clean = len(rows)
    shared = [f"s{i}" for i in range(60)]
    for _ in range(400):  # half of them with a passage that the others have too
        rows.append((len(rows), " ".join([f"w{rng.randrange(20_000)}" for _ in range(200)] + (shared if rng.random() < 0.5 else []))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    of = {r.doc_id: r.component_id for r in wide.similar_documents(docs).collect()}
    similar = [of[i] == of[i + 1] for s, i, _, _ in pairs if s >= 0.8]
    assert len(similar) > 150 and sum(similar) / len(similar) >= 0.95
    assert sum(of[i] == i for i in range(clean, len(rows))) / (len(rows) - clean) >= 0.99
    assert all(of[i] == of[i + 1] for s, i, _, _ in pairs if s >= 0.9)


def test_awkward_rows(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  two"), (None, "one two"), (6, long), (7, long + " end"), (7, "another"), (None, None)]
    got = {(r.doc_id, r.component_id) for r in wide.similar_documents(docs_of(rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (None, 1), (4, 4), (5, 4), (None, 4), (6, 6), (7, 6), (7, 7)}
    assert wide.similar_documents(docs_of(rows).limit(0)).collect() == []
