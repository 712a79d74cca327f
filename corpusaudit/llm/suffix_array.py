"""Suffix array by induced sorting and permuted common prefixes, in whole-array steps.

Suffixes are smaller (S) or larger (L) than the one to their right. The leftmost S of a run starts a piece; pieces are
sorted, named, and runs of 2, 4, 8, ... names are named in turn until all differ.
From the order of the leftmost S suffixes the L and then the S suffixes are induced, bucket by bucket: all suffixes
that stand in a bucket are moved at once, and runs of one symbol take a step each. Text is numbers below 258.
"""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its right neighbour; the last one (a sentinel) is."""
    n = len(t)
    step = np.sign(t[1:].astype(np.int32) - t[:-1].astype(np.int32))
    at = np.where(step != 0, np.arange(n - 1), n)  # equal symbols take the type of the next change
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = np.append(step, 1)[np.minimum(nxt, n - 1)] > 0
    return small


def _append(sa: np.ndarray, t: np.ndarray, found: np.ndarray, at: np.ndarray, way: int) -> None:
    """Put suffixes into the buckets of their first symbols, in the order given; ``at`` are the ends that grow."""
    if not len(found):
        return
    symbols = t[found]
    order = np.argsort(symbols, kind="stable")
    counts = np.bincount(symbols, minlength=len(at))
    inside = np.arange(len(found)) - np.repeat(np.cumsum(counts) - counts, counts)
    symbols = symbols[order]
    sa[at[symbols] + way * inside] = found[order]
    at += way * counts


def induce(t: np.ndarray, small: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost S suffixes in (some) order."""
    counts = np.bincount(t)
    ends = np.cumsum(counts)
    heads, sa = ends - counts, np.zeros(len(t), np.int32)
    first = t[starts]
    of = np.searchsorted(first, np.arange(len(counts) + 1))
    at = heads.copy()
    for c in np.flatnonzero(counts).tolist():
        done = heads[c]
        while done < at[c]:  # what stands there, then what that has added to the bucket itself
            now = sa[done : at[c]]
            done = at[c]
            left = now[now > 0] - 1
            _append(sa, t, left[~small[left]], at, 1)
        left = starts[of[c] : of[c + 1]]
        left = left[left > 0] - 1
        _append(sa, t, left[~small[left]], at, 1)
    larger_ends, at = at, ends - 1
    for c in np.flatnonzero(counts).tolist()[::-1]:
        done = ends[c] - 1
        while done > at[c]:
            now = sa[at[c] + 1 : done + 1][::-1]
            done = at[c]
            left = now[now > 0] - 1
            _append(sa, t, left[small[left]], at, -1)
        now = sa[heads[c] : larger_ends[c]][::-1]
        left = now[now > 0] - 1
        _append(sa, t, left[small[left]], at, -1)
        if c == t[-1] and not counts[:c].any():
            sa[heads[c]] = len(t) - 1  # the sentinel has no left neighbour that would induce it
    return sa


def _name_pieces(t: np.ndarray, small: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of each piece (from its start to the next start, both included) by its order; equal pieces share one."""
    order = starts[np.argsort(t[starts], kind="stable")]
    sa = induce(t, small, order)
    is_start = np.zeros(len(t), bool)
    is_start[starts] = True
    by_order = sa[is_start[sa]]
    length = np.zeros(len(t), np.int64)
    length[starts[:-1]] = np.diff(starts) + 1
    length[starts[-1]] = 1
    a, b = by_order[:-1], by_order[1:]
    same = length[a] == length[b]
    at = np.flatnonzero(same)
    offset = 0
    while len(at):  # compared symbol by symbol, while equal
        equal = t[a[at] + offset] == t[b[at] + offset]
        same[at[~equal]] = False
        offset += 1
        at = at[equal]
        at = at[length[a[at]] > offset]
    names = np.zeros(len(t), np.int64)
    names[by_order] = np.concatenate([[0], np.cumsum(~same)])
    return names[starts]


def _firsts(change: np.ndarray) -> np.ndarray:
    """For each place the first place of its group; ``change`` tells where a group starts."""
    return np.maximum.accumulate(np.where(change, np.arange(len(change)), 0))


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of all suffixes. The last symbol must be the only smallest one."""
    if len(t) < 3:
        return np.argsort(t, kind="stable").astype(np.int32)
    small = classify(t)
    starts = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    names = _name_pieces(t, small, starts)
    n = len(names)
    order = np.argsort(names, kind="stable")
    first = _firsts(np.append(True, names[order][1:] != names[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = first
    reach = 1
    while True:  # only what shares its name with another is sorted again, by the name that follows
        tied = np.flatnonzero((first != np.arange(n)) | np.append(first[1:] == np.arange(n - 1), False))
        if not len(tied):
            break
        which = order[tied]
        tail = np.where(which + reach < n, rank[np.minimum(which + reach, n - 1)] + 1, 0)
        key = rank[which] * (n + 1) + tail
        sub = np.argsort(key, kind="stable")
        order[tied], key = which[sub], key[sub]
        first[tied] = tied[_firsts(np.append(True, key[1:] != key[:-1]))]
        rank[order[tied]] = first[tied]
        reach *= 2
    return induce(t, small, starts[order])


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text position the suffix before it in the order, and whether they share ``least`` symbols or more.

    A common prefix is one shorter than that of the position before when both suffixes follow the same symbol. Only
    where they do not is it counted out, eight symbols at a time, and as far as the positions that hang on it need.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    own = (before <= 0) | (i == 0)
    own[~own] = t[i[~own] - 1] != t[before[~own] - 1]
    at = np.flatnonzero(own)
    need = least + np.diff(np.append(at, n))
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([t, np.zeros(7, t.dtype)]), 8)
    shared = np.zeros(len(at), np.int64)
    live = np.flatnonzero(before[at] >= 0)
    offset = 0
    while len(live):
        a, b = at[live] + offset, before[at[live]] + offset
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
        differ = words[a] != words[b]
        some = differ.any(axis=1)
        shared[live] = offset + np.where(some, differ.argmax(axis=1), 8)
        offset += 8
        live = live[~some & (offset < need[live])]
    last = np.cumsum(own) - 1
    return before, shared[last] - (i - at[last]) >= least
