"""Suffix arrays and removal of repeated strings against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from corpusaudit.llm import repeats
from corpusaudit.llm.repeats import anchors, gram_hashes, shard_repeats, string_hashes
from corpusaudit.llm.substring_dedup import remove_repeats
from corpusaudit.llm.suffix_array import permuted_prefixes, suffix_array


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(0)
    for _ in range(150):
        t = np.append(r.integers(1, 1 + r.integers(1, 5), r.integers(1, 60)), 0).astype(np.uint16)
        sa = suffix_array(t)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        least = int(r.integers(1, 6))
        _, shares = permuted_prefixes(t, sa, least)
        for i, j in zip(sa[1:], sa):
            assert shares[i] == (t[i : i + least].tolist() == t[j : j + least].tolist() and max(i, j) + least <= len(t))


def repeated(data, length, scope=None, across=False):
    places = defaultdict(list)
    for o, x in enumerate(data):
        for i in range(len(x) - length + 1):
            places[scope and scope[o], x[i : i + length]].append((o, i))
    marks = [np.zeros(len(x), bool) for x in data]
    for found in places.values():
        if len(found) > 1 and (not across or len({o for o, _ in found}) > 1):
            for o, i in found:
                marks[o][i : i + length] = True
    return marks


@pytest.mark.parametrize("across", [False, True])
def test_shards(across):
    r = np.random.default_rng(3)
    for _ in range(100):
        length = int(r.integers(2, 9))
        data = [bytes(r.integers(97, 99, r.integers(1, 30)).astype(np.uint8)) for _ in range(r.integers(1, 6))]
        scope = r.integers(0, 2, len(data))
        got = [np.zeros(len(x), bool) for x in data]
        for f, a, b in shard_repeats(np.arange(len(data)), scope, np.zeros(len(data), int), data, length, across):
            got[f][a:b] = True
        want = repeated(data, length, scope.tolist(), across) if across else None
        if want is None:
            want = [np.zeros(len(x), bool) for x in data]
            for s in (0, 1):
                at = [k for k in range(len(data)) if scope[k] == s]
                for k, m in zip(at, repeated([data[k] for k in at], length)):
                    want[k] = m
        assert all((a == b).all() for a, b in zip(got, want))


def test_equal_strings_share_an_anchor():
    r = random.Random(5)
    text = lambda n: bytes(r.choice(b"abcd ") for _ in range(n))
    for _ in range(50):
        s = text(40)
        places = []
        for _ in range(2):
            before = text(r.randint(0, 50))
            place, h = anchors(before + s + text(r.randint(0, 50)), 40, 8)
            places.append({(p - len(before), x) for p, x in zip(place.tolist(), h.tolist()) if len(before) <= p <= len(before) + 32})
        assert places[0] & places[1]
    assert len(anchors(b"x" * 39, 40, 8)[0]) == 0


def test_hashes_of_runs():
    t = np.frombuffer(b"abcabcabcabcab", np.uint8)
    for h in (gram_hashes(t, 4), string_hashes(t, 4, np.uint64(1)), string_hashes(t, 7, np.uint64(1))):
        n = len(t) - len(h) + 1
        for i in range(len(h)):
            for j in range(len(h)):
                assert (h[i] == h[j]) == (bytes(t[i : i + n]) == bytes(t[j : j + n]))


def rows():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(30) for _ in range(6)]
    out = []
    for i in range(70):
        parts = [text(r.randint(0, 30))]
        for _ in range(r.choice([0, 1, 1, 2])):
            parts += [r.choice(passages)[: r.choice([60, 90, 150, 1000])], text(r.randint(0, 40))]
        out.append((i, " ".join(parts)))
    return [*out, (80, None), (81, ""), (82, "short"), (83, out[1][1]), (84, out[1][1]), (None, out[2][1]), (5, out[5][1]), (6, "other " + passages[0]), (85, "z" * 500), (86, "ab" * 300 + passages[1])]


@pytest.mark.parametrize("gathered", [1000, 1, 3])
def test_removal(docs_of, monkeypatch, gathered):
    monkeypatch.setattr(repeats, "GATHERED", gathered)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 3000)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 1500)
    data = [(t or "").encode() for _, t in rows()]
    want = []
    for (i, _), x, m in zip(rows(), data, repeated(data, 80)):
        kept = bytes(np.frombuffer(x, np.uint8)[~m])
        want.append((i, len(x), int(m.sum()), int((np.diff(np.append(0, m.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = remove_repeats(docs_of(rows()), length=80).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 3000


def test_empty(docs_of):
    assert remove_repeats(docs_of(rows()).where("doc_id < 0")).collect() == []


def test_passages_by_length(docs_of):
    """Of passages that two documents share those of 400 bytes or more go, whole, and shorter ones stay, whole."""
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9)))
    passages = [" ".join(word() for _ in range(n)) for n in range(45, 95)]
    docs = {}
    for i, p in enumerate(passages):
        for k in (0, 1):  # the bytes beside the passage differ, so that nothing but it repeats
            docs[2 * i + k] = ("\x01\x02"[k] + p + "\x03\x04"[k], " ".join(word() for _ in range(40)))
    got = {x.doc_id: bytes(x.kept).decode() for x in remove_repeats(docs_of([(i, own + around + own) for i, (around, own) in docs.items()])).collect()}
    for i, (around, own) in docs.items():
        gone = len(around) - 2 >= 400
        assert got[i] == own + (around[0] + around[-1] if gone else around) + own
    assert {len(p) >= 400 for p in passages if len(p.split()) > 50} == {True, False}
