"""Exact and near duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash

from corpusaudit.llm.exact_dedup import CountingQuotientFilter, drop_copies, exact_groups
from corpusaudit.llm.simhash import GrayIndex, linked_tree, near_duplicates, simhash


def test_filters_lose_nothing():
    r = np.random.default_rng(2)
    for n in (0, 1, 5, 1000):
        values = r.choice(r.integers(0, 2**64, max(1, n // 2), dtype=np.uint64), n) if n else np.empty(0, np.uint64)
        parts = [CountingQuotientFilter.of(v) for v in np.array_split(values, 4)]
        for bits in (0, 3):
            slices = [(top, f.to_bytes(bits)) for p in parts for top, f in p.slices(bits)]
            found = {}
            for top in {t for t, _ in slices}:
                whole = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(d, top, bits) for t, d in slices if t == top])
                found |= dict(zip(whole.fingerprints.tolist(), whole.counts.tolist()))
            want = np.unique(values, return_counts=True)
            assert found == dict(zip(want[0].tolist(), want[1].tolist()))


def exact_rows():
    r = random.Random(4)
    rows = [(i, r.choice(["a b", "a  b", "a\tb", " a b", "A b", "", "é x", "same " * 50])) for i in range(50)]
    return [*rows, (60, None), (61, "unique"), (None, "a b"), (None, "alone"), (61, "unique"), (62, "long " * 50_000)]


def test_exact_groups(docs_of):
    rows = exact_rows()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(map(tuple, exact_groups(docs_of(rows)).collect()), key=str) == sorted(want, key=str)
    kept = drop_copies(docs_of(rows))
    assert "fp" in kept.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({w[0] for w in want if w[3]}, key=str)
    assert exact_groups(docs_of(rows).where("doc_id < 0")).collect() == []


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_index_finds_all_and_only_near_numbers():
    r = np.random.default_rng(1)
    for n in (2, 3, 9, 60, 400):
        base = r.integers(0, 2**63, 4, dtype=np.uint64)
        flips = (np.uint64(1) << r.integers(0, 64, (2, n)).astype(np.uint64)).astype(np.uint64)
        x = np.unique(base[r.integers(0, 4, n)] ^ flips[0] ^ flips[1])
        index = GrayIndex(x)
        q, m = index.search(x, 2)
        got = set(zip(x[q].tolist(), index.members[m].tolist()))
        assert got == {(a, b) for a in x.tolist() for b in x.tolist() if (a ^ b).bit_count() <= 2}
    chain = np.array([0, 3, 15, 63], np.uint64)
    a, b = linked_tree(chain)
    assert len(a) == 3 and set(b.tolist()) == {0}


def test_near_duplicates(docs_of):
    r = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choice(words) for _ in range(200)) for _ in range(12)]
    rows = []
    for i in range(150):
        t = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((i, " ".join(t)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "One"), (204, "one"), (205, "a b"), (206, "a b c"), (None, "a b c"), (3, rows[3][1]), (207, "x y Z " * 9000)]
    fp = [plain_simhash(t) for _, t in rows]
    assert fp == [simhash((t or "").encode()) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = root[a], root[b]
                root = [min(x, y) if z in (x, y) else z for z in root]
    first = {}
    for k, (i, _) in enumerate(rows):
        first.setdefault(root[k], []).append(i)
    want = [(i, f"{fp[k]:016x}", min((x for x in first[root[k]] if x is not None), default=None)) for k, (i, _) in enumerate(rows)]
    got = near_duplicates(docs_of(rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert near_duplicates(docs_of(rows).where("doc_id < 0")).collect() == []
