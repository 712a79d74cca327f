"""Periodic runs of words: maximal stretches that repeat themselves with a period, by maximal pairs.

A run of period p and length m is the pair of equal strings of m - p words that start p apart and can be extended
neither to the left (the words before them differ) nor to the right. Such maximal pairs are read off the tree of LCP
intervals, bottom-up: two starts from different children of an interval agree in exactly its number of words, and they
are a maximal pair if their left words differ. Each interval keeps its starts in order, and in lists by left word.
For a run of exponent e the starts are at most 1 / (e - 1) of the common words apart, so a start looks for partners
inside that distance only: in the stretch of starts, or in the lists of other left words, whichever are fewer. The
smaller child is always put into the larger one.

A text is one row; suffixes are ordered for many texts at once, words of different texts being different symbols.
Nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import binaries

EXPONENT = 4
LENGTH = 6
#: Words of texts that are ordered together; a longer text is ordered alone.
TOGETHER = 200_000


def _firsts(change: np.ndarray) -> np.ndarray:
    """For each place the first place of its group; ``change`` tells where a group starts."""
    return np.maximum.accumulate(np.where(change, np.arange(len(change)), 0))


def _changes(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], x[1:] != x[:-1]])


def ranks(symbols: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For 1, 2, 4, ... symbols: the place of each suffix by that many, equal ones sharing the first place of theirs.

    ``ends`` is the end of the text of each place. Only suffixes that are still equal to another are ordered again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = _firsts(_changes(symbols[order]))
    out, width = [rank.astype(np.int32)], 1
    open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(open_):
        right = open_ + width
        second = np.where(right < ends[open_], rank[np.minimum(right, n - 1)] + 1, 0)
        key = rank[open_] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        open_, key = open_[order], key[order]
        new = _changes(key)
        first = _firsts(new)
        rank[open_] += first - _firsts(_changes(rank[open_]))
        out.append(rank.astype(np.int32))
        sizes = np.bincount(first, minlength=len(first))
        open_ = open_[sizes[first] > 1]
        width *= 2
    return out


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes at ``a`` and at ``b`` (different places) have in common."""
    length = np.zeros(len(a), np.int64)
    end = len(levels[0])
    for depth in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        inside = np.flatnonzero((x < end) & (y < end))
        same = inside[levels[depth][x[inside]] == levels[depth][y[inside]]]
        length[same] += 1 << depth
    return length


class _Starts:
    """Starts below an interval, in order and in lists by left word."""

    __slots__ = ("all", "by_left")

    def __init__(self, start: int, left: int):
        self.all, self.by_left = [start], {left: [start]}

    def partners(self, start: int, left: int, gap: int, lefts: list[int]) -> list[int]:
        """Starts at most ``gap`` away with another left word."""
        lo, hi = bisect_left(self.all, start - gap), bisect_right(self.all, start + gap)
        if hi - lo <= len(self.by_left):
            return [x for x in self.all[lo:hi] if lefts[x] != left]
        others = [xs for other, xs in self.by_left.items() if other != left]
        return [x for xs in others for x in xs[bisect_left(xs, start - gap) : bisect_right(xs, start + gap)]]

    def take(self, other: _Starts) -> None:
        _insert(self.all, other.all)
        for left, xs in other.by_left.items():
            mine = self.by_left.get(left)
            if mine is None:
                self.by_left[left] = xs
            else:
                _insert(mine, xs)


def _insert(into: list[int], xs: list[int]) -> None:
    if len(xs) < 8:
        for x in xs:
            if x > into[-1]:
                into.append(x)
            else:
                insort(into, x)
    else:
        into.extend(xs)
        into.sort()


def maximal_runs(symbols: np.ndarray, ends: np.ndarray, exponent: int = EXPONENT, least: int = LENGTH) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, in order of start and period. No symbol is in two texts."""
    n = len(symbols)
    if n < 2:
        return []
    # what the two strings of a run have in common at least, for any period
    shortest = min(max((exponent - 1) * p, least - p) for p in range(1, least + 1))
    levels = ranks(symbols, ends)
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    depth = min(shortest.bit_length() - 1, len(levels) - 1)
    near = np.flatnonzero(levels[depth][order[1:]] == levels[depth][order[:-1]])
    lcp = common_prefixes(levels, order[near], order[near + 1])
    deep = lcp >= shortest
    near, lcp = near[deep].tolist(), lcp[deep].tolist()
    lefts = np.concatenate([[-1], symbols[:-1]])
    lefts[np.concatenate([[0], ends[:-1]]) == np.arange(n)] = -1  # firsts of texts have no left word
    starts, lefts = order.tolist(), lefts.tolist()

    found: dict[tuple[int, int], int] = {}
    most = exponent - 1
    stack: list[tuple[int, _Starts]] = []
    before = -2
    now = None

    def pair(common: int, a: _Starts, b: _Starts) -> _Starts:
        """Two children of an interval as one; their maximal pairs are runs, of which the smallest period is kept."""
        if len(a.all) < len(b.all):
            a, b = b, a
        gap = common // most
        for left, xs in b.by_left.items():
            for x in xs:
                for y in a.partners(x, left, gap, lefts):
                    start, period = (x, y - x) if x < y else (y, x - y)
                    end = start + period + common
                    if end - start >= least and found.get((start, end), end) > period:
                        found[start, end] = period
        a.take(b)
        return a

    def close(common: int, now: _Starts | None) -> _Starts | None:
        while stack and stack[-1][0] > common:
            now = pair(*stack.pop(), now)
        return now

    for place, common in zip(near, lcp):
        if place != before + 1:  # a part of the order that shares too little with the one before
            close(0, now)
            now = _Starts(starts[place], lefts[starts[place]])
        before = place
        now = close(common, now)
        if stack and stack[-1][0] == common:
            stack[-1] = (common, pair(common, stack[-1][1], now))
        else:
            stack.append((common, now))
        right = starts[place + 1]
        now = _Starts(right, lefts[right])
    close(0, now)
    return sorted((start, end - start, period) for (start, end), period in found.items())


def runs_of_texts(texts: list[list[bytes]], exponent: int = EXPONENT, least: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, given as words."""
    symbols, first = [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        symbols.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + first)
        first += len(known)
    sizes = np.array([len(w) for w in texts])
    ends = np.cumsum(sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in maximal_runs(np.concatenate(symbols), np.repeat(ends, sizes), exponent, least):
        text = int(np.searchsorted(ends, start, side="right"))
        out[text].append((start - int(ends[text] - sizes[text]), length, period))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words that no run contains behind its first period, joined by spaces."""
    if runs:
        depth = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            depth[start + period] += 1
            depth[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
    return b" ".join(words)


def _together(texts: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for i, words in enumerate(texts):
        if i > a and size + len(words) > TOGETHER:
            yield a, i
            a, size = i, 0
        size += len(words)
    if a < len(texts):
        yield a, len(texts)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, least: int = LENGTH) -> DataFrame:
    """One row per document: id, ``n_words``, ``runs`` (start, length, period, by start and period), ``collapsed``.

    A run is a stretch of words with smallest period p, at least ``least`` words and ``exponent`` periods long, that
    no neighbouring word extends. ``collapsed`` keeps of each run its first period; a word goes if any run has it
    behind that. A null or empty text has no words, no runs and an empty ``collapsed``. Ids are only passed through,
    so they may be null or repeated; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            texts = [t.split() for t in binaries(batch, "text")]
            for a, b in _together(texts):
                found = runs_of_texts(texts[a:b], exponent, least)
                runs = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found], kind)
                kept = pa.array([collapse(w, r) for w, r in zip(texts[a:b], found)], pa.binary()).cast(pa.string())
                words = pa.array([len(w) for w in texts[a:b]], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), words, runs, kept], names=["id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)
