"""Suffix array by induced sorting, and permuted common prefixes, for one shard of bytes.

Suffixes are classified (S or L), leftmost-S substrings are sorted by an induced pass and
named, the shorter string of names is sorted where names repeat, and a last induced pass
gives all suffixes. The induced passes run bucket by bucket in numpy. The string of names
has as many letters as places, so buckets would hold one or two names each: it is sorted
by ranks of doubled spans instead, a few array sorts in all.

Common prefixes are computed in text order. Where the byte before a suffix equals the byte
before its predecessor, the prefix is that of the place before less one; only the other
places are compared byte by byte, eight at a time.
"""

from __future__ import annotations

import numpy as np


def classify(s: np.ndarray) -> np.ndarray:
    """True where the suffix is S-type (smaller than its successor); ``s`` ends with a unique smallest 0."""
    n = len(s)
    kind = np.zeros(n, bool)
    kind[-1] = True
    less, equal = s[:-1] < s[1:], s[:-1] == s[1:]
    # a position equal to its successor takes the type of the end of its run
    where = np.where(~equal, np.arange(n - 1), n - 1)
    end = np.minimum.accumulate(where[::-1])[::-1]
    kind[:-1] = np.append(less, True)[end]
    return kind


def _scatter(sa: np.ndarray, at: np.ndarray, positions: np.ndarray, chars: np.ndarray, step: int) -> None:
    """Append positions to the buckets of their characters, in order, from the front (step 1) or the back (-1)."""
    order = np.argsort(chars, kind="stable")  # by counting: the characters have 16 bits
    chars, positions = chars[order], positions[order]
    new = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
    size = np.diff(np.append(new, len(chars)))
    rank = np.arange(len(chars)) - np.repeat(new, size)
    sa[at[chars] + step * rank] = positions
    at[chars[new]] += step * size


def induce(s: np.ndarray, kind: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """Order of all suffixes from that of the leftmost-S ones."""
    n = len(s)
    size = np.bincount(s, minlength=sigma)
    end = np.cumsum(size)
    start = end - size
    sa = np.full(n, -1, np.int64)
    tail = end - 1
    if len(lms):
        _scatter(sa, tail, lms[::-1], s[lms[::-1]], -1)
    head = start.copy()
    used = np.flatnonzero(size)
    for c in used:  # L-type suffixes, left to right
        done = start[c]
        for part in ("l", "s"):
            while True:
                chunk = sa[done : head[c]] if part == "l" else sa[tail[c] + 1 : end[c]]
                before = chunk[chunk > 0] - 1
                before = before[~kind[before]]
                done = head[c]
                if len(before):
                    _scatter(sa, head, before, s[before], 1)
                if part == "s" or done == head[c]:
                    break
    back = end - 1
    for c in used[::-1]:  # S-type suffixes, right to left; they replace the leftmost-S ones
        sa[head[c] : end[c]][: max(0, back[c] - head[c] + 1)] = -1
        done = end[c]
        while True:
            chunk = sa[back[c] + 1 : done][::-1]
            before = chunk[chunk > 0] - 1
            before = before[kind[before]]
            done = back[c] + 1
            if len(before):
                _scatter(sa, back, before, s[before], -1)
            if done == back[c] + 1:
                break
        chunk = sa[start[c] : head[c]][::-1]
        before = chunk[chunk > 0] - 1
        before = before[kind[before]]
        if len(before):
            _scatter(sa, back, before, s[before], -1)
    sa[0] = n - 1
    return sa


def order_names(names: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a string of names, by ranks of spans that double."""
    n = len(names)
    rank = names.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    open_ = order  # the places, in order, whose rank others share
    span = 1
    while True:
        same = rank[open_[1:]] == rank[open_[:-1]]
        tied = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(open_) else same
        if not tied.any():
            return np.argsort(rank)
        open_ = open_[tied]
        # ranks count the places before a group; tied places are told apart by the rank `span` places on
        if span == 1:
            first = np.searchsorted(rank[order], rank, side="left")
            rank = first.astype(np.int64)
        after = open_ + span
        key = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.lexsort((key, rank[open_]))
        open_, key = open_[by], key[by]
        group = rank[open_]
        lead = np.concatenate([[True], group[1:] != group[:-1]])
        new = lead | np.concatenate([[True], key[1:] != key[:-1]])
        at = np.arange(len(open_))
        start = np.maximum.accumulate(np.where(lead, at, 0))
        rank[open_] = group + np.maximum.accumulate(np.where(new, at, 0)) - start
        span *= 2


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffix array of ``data`` (non-negative integers below 65,535) with a sentinel appended; the sentinel comes first."""
    s = np.append(data.astype(np.uint16) + np.uint16(1), np.uint16(0))
    sigma = int(s.max()) + 1
    kind = classify(s)
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    if len(lms) > 1:
        sa = induce(s, kind, lms, sigma)
        is_lms = np.zeros(len(s), bool)
        is_lms[lms] = True
        ordered = sa[is_lms[sa]]
        index = np.empty(len(s), np.int64)
        index[lms] = np.arange(len(lms))
        at = index[ordered]
        # neighbours in the order share a name if their substrings, next leftmost-S character included, are equal
        length = np.append(np.diff(lms), len(s) - 1 - lms[-1])[at] + 1
        differs = length[1:] != length[:-1]
        left = np.flatnonzero(~differs)
        for j in range(int(length.max())):
            left = left[length[left] > j]
            if not len(left):
                break
            off = s[ordered[left] + j] != s[ordered[left + 1] + j]
            differs[left[off]] = True
            left = left[~off]
        names = np.empty(len(lms), np.int64)
        names[at] = np.concatenate([[0], np.cumsum(differs)])
        lms = lms[order_names(names)] if names.max() + 1 < len(lms) else ordered
    return induce(s, kind, lms, sigma)


def permuted_lcp(data: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text position: common prefix with its predecessor in suffix order, and that predecessor (-1: none).

    Prefixes stop at a separator (a byte 255).
    """
    n = len(data)
    phi = np.full(n + 1, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi = phi[:n]
    phi[phi == n] = -1
    lcp = np.zeros(n, np.int64)
    if not n:
        return lcp, phi
    # places from where no common prefix is passed on: other bytes before them, or a border
    prior = np.concatenate([[255], data[:-1]])
    chained = (phi > 0) & (prior != 255)
    chained &= prior == prior[np.maximum(phi, 0)]
    own = np.flatnonzero(~chained & (phi >= 0))
    padded = np.full(n + 16, 255, np.uint8)
    padded[:n] = data
    words = np.lib.stride_tricks.as_strided(padded, (n + 8, 8), (1, 1))
    ones, high = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
    a, b, done = own, phi[own], 0
    while len(own):
        x = np.ascontiguousarray(words[a]).view(np.uint64)[:, 0]
        y = np.ascontiguousarray(words[b]).view(np.uint64)[:, 0]
        gap = ~x
        # the lowest byte that differs or is a separator; what the borrow marks above it does not matter
        off = (x ^ y) | ((gap - ones) & x & high)
        same = off == 0
        low = off[~same]
        low &= ~low + np.uint64(1)
        lcp[own[~same]] = done + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        own, a, b = own[same], a[same] + 8, b[same] + 8
        done += 8
    heads = np.maximum.accumulate(np.where(chained, -1, np.arange(n)))
    return np.where(chained, lcp[heads] - (np.arange(n) - heads), lcp), phi
