"""Suffix arrays by induced sorting, and permuted longest common prefixes.

Suffixes are classified as rising (S) or falling (L); the leftmost S suffixes of each run are
sorted by inducing, named, and if names repeat their order comes from the reduced string,
recursively. A string of bytes has few buckets, so inducing scans it bucket by bucket: all
entries of a bucket that are known pass on their predecessors at once, and runs of one symbol
take a wave each. Reduced strings have as many buckets as names and are scanned entry by entry.
"""

from __future__ import annotations

import numpy as np

#: Symbols of a string of bytes: the bytes, a separator and the sentinel.
BYTE_SYMBOLS = 258


def rising(x: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last (the sentinel) counts as such."""
    n = len(x)
    differs = np.flatnonzero(x[:-1] != x[1:])
    following = np.searchsorted(differs, np.arange(n - 1))
    up = x[differs] < x[differs + 1]
    return np.append(up[following], True)


def dealt(queue: dict[int, list[np.ndarray]], at: np.ndarray, symbols: np.ndarray) -> None:
    """Append positions to the queues of their symbols, in order."""
    if not len(at):
        return
    order = np.argsort(symbols.astype(np.uint16), kind="stable")  # by radix
    at, symbols = at[order], symbols[order]
    cuts = np.flatnonzero(np.diff(symbols)) + 1
    for s, part in zip(symbols[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
        queue.setdefault(s, []).append(part)


def induce(x: np.ndarray, up: np.ndarray, lms: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The suffix array from LMS suffixes in order; from any order, LMS substrings come out sorted."""
    seeds: dict[int, list[np.ndarray]] = {}
    dealt(seeds, lms, x[lms])
    falls: dict[int, list[np.ndarray]] = {}
    none = np.empty(0, np.int64)
    done: dict[int, np.ndarray] = {}
    for c in used.tolist():
        waves, parts = falls.pop(c, []), []
        wave = np.concatenate(waves) if waves else none
        while len(wave):
            parts.append(wave)
            before = wave[wave > 0] - 1
            before = before[~up[before]]
            symbols = x[before]
            dealt(falls, before[symbols != c], symbols[symbols != c])
            wave = before[symbols == c]
        done[c] = np.concatenate(parts) if parts else none
        for part in seeds.get(c, []):
            before = part[part > 0] - 1
            before = before[~up[before]]
            dealt(falls, before, x[before])
    rises: dict[int, list[np.ndarray]] = {0: [np.array([len(x) - 1])]}
    out = []
    for c in used[::-1].tolist():
        waves, parts = rises.pop(c, []), []
        wave = np.concatenate(waves) if waves else none
        while len(wave):
            parts.append(wave)
            before = wave[wave > 0] - 1
            before = before[up[before]]
            symbols = x[before]
            dealt(rises, before[symbols != c], symbols[symbols != c])
            wave = before[symbols == c]
        last = done[c][::-1]
        before = last[last > 0] - 1
        before = before[up[before]]
        dealt(rises, before, x[before])
        out += [*parts, last]
    return np.concatenate(out)[::-1]


def induce_names(x: np.ndarray, up: np.ndarray, lms: np.ndarray, used: np.ndarray) -> np.ndarray:
    """As induce, for dense names as symbols: two linear scans over the suffix array itself."""
    n, size = len(x), len(used)
    tops = np.cumsum(np.bincount(x, minlength=size))
    heads = (tops - np.bincount(x, minlength=size)).tolist()
    # The seeds stand at the ends of their buckets, in order.
    seeds = x[lms]
    order = np.argsort(seeds, kind="stable")
    lms, seeds = lms[order], seeds[order]
    last_of = np.searchsorted(seeds, np.arange(size), side="right")
    start = np.full(n, -1, np.int64)
    start[tops[seeds] - last_of[seeds] + np.arange(len(lms))] = lms
    sa = start.tolist()
    # bucket[p]: the symbol before p if the suffix from there falls (rises), else -1; so for p = -1, an empty place.
    symbol = np.append(np.concatenate([[-1], x[:-1]]), -1)
    before = np.concatenate([[False], up[:-1], [False]])
    bucket = np.where(before, -1, symbol).tolist()
    for p in sa:
        c = bucket[p]
        if c >= 0:
            at = heads[c]
            sa[at] = p - 1
            heads[c] = at + 1
    # Of the S suffixes only the sentinel keeps its place; the others are induced anew.
    falling = np.array(sa)
    falling[(falling >= 0) & up[falling]] = -1
    falling[0] = n - 1
    sa = falling.tolist()
    bucket = np.where(before, symbol, -1).tolist()
    ends = (tops - 1).tolist()
    for p in reversed(sa):
        c = bucket[p]
        if c >= 0:
            at = ends[c]
            sa[at] = p - 1
            ends[c] = at - 1
    return np.array(sa)


def equal_substrings(x: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether x[a:a+length] == x[b:b+length], pair by pair."""
    same = np.ones(len(a), bool)
    active, k = np.arange(len(a)), 0
    while len(active):
        active = active[length[active] > k]
        ok = x[a[active] + k] == x[b[active] + k]
        same[active[~ok]] = False
        active, k = active[ok], k + 1
    return same


def suffix_array(x: np.ndarray, names: bool = False) -> np.ndarray:
    """Suffix array of a string of bytes (as symbols below BYTE_SYMBOLS), or of dense names, that ends with its only 0."""
    n = len(x)
    if n == 1:
        return np.zeros(1, np.int64)
    used = np.arange(int(x.max()) + 1) if names else np.unique(x)
    scan = induce_names if names else induce
    up = rising(x)
    lms = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    order = scan(x, up, lms, used)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    # Names of LMS substrings; the one at the sentinel is alone.
    length = np.ones(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    same[:1] = False
    at = np.flatnonzero(same)
    same[at] = equal_substrings(x, a[at], b[at], length[a[at]])
    name = np.empty(n, np.int64)
    name[order] = np.concatenate([[0], np.cumsum(~same)])
    reduced = name[lms]
    if reduced.max() < len(lms) - 1:
        order = lms[suffix_array(reduced, names=True)]
    else:
        order = np.empty(len(lms), np.int64)
        order[reduced] = lms
    return scan(x, up, order, used)


def permuted_lcp(x: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position its predecessor in suffix order (-1 for the first) and their common prefix.

    Only irreducible values are compared symbol by symbol; the others follow, each one less
    than its left neighbour's.
    """
    n = len(x)
    phi = np.empty(n, np.int64)
    phi[sa[0]] = -1
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    reducible = np.zeros(n, bool)
    inner = (phi[1:] > 0) & (phi[:-1] >= 0)
    reducible[1:] = inner & (x[:-1] == x[np.maximum(phi[1:], 1) - 1])
    own = np.flatnonzero(~reducible & (phi >= 0))
    width = 8
    padded = np.append(x, -1).astype(np.int16 if x.max() < 32000 else np.int64)
    lcp = np.zeros(n, np.int64)
    active, k = own, 0
    while len(active):
        a, b = active + k, phi[active] + k
        step = np.zeros(len(active), np.int64)
        alive = np.ones(len(active), bool)
        for j in range(width):
            alive &= padded[np.minimum(a + j, n)] == padded[np.minimum(b + j, n)]
            alive &= (a + j < n) & (b + j < n)
            step += alive
        lcp[active] += step
        active, k = active[step == width], k + width
    total = np.full(n, -1, np.int64)
    total[own] = lcp[own] + own
    total[phi < 0] = np.flatnonzero(phi < 0)
    last = np.maximum.accumulate(np.where(total >= 0, i, -1))
    return phi, total[last] - i


def repeated_starts(strings: list[bytes], width: int) -> list[np.ndarray]:
    """For each string the starts of its substrings of `width` bytes that also start elsewhere in the shard."""
    flat = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 2
    sizes = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(sizes)
    x = np.append(np.insert(flat, ends, 1), 0)  # a separator after each string, then the sentinel
    sa = suffix_array(x)
    phi, lcp = permuted_lcp(x, sa)
    long = np.flatnonzero(lcp >= width)
    hit = np.zeros(len(x), bool)
    hit[long] = True
    hit[phi[long]] = True
    # A separator inside the common prefix does not count: the string must have room for the substring.
    starts = np.concatenate([[0], ends[:-1] + np.arange(1, len(sizes))])
    return [np.flatnonzero(hit[s : s + max(0, n - width + 1)]) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
