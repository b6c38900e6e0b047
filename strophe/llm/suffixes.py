"""Suffix arrays by induced sorting, and permuted common prefixes, over the bytes of one shard."""

from __future__ import annotations

import numpy as np

SEPARATOR = 0xFF  # a byte that UTF-8 never holds


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S); ``t`` ends in a unique smallest value."""
    n = len(t)
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(t[1:] - t[:-1])
    rise[-1] = 1
    at = np.where(rise != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]  # the end of a run of equal values decides for all of it
    return rise[nearest] > 0


def _deal(sa: np.ndarray, at: np.ndarray, items: np.ndarray, t: np.ndarray, step: int) -> None:
    """Put ``items``, in their order, at the open end of their buckets; ``at`` moves on by ``step``."""
    if not len(items):
        return
    order = _sorted_by(t[items], len(at) + 1)
    items = items[order]
    c = t[items]
    first = np.r_[0, np.flatnonzero(c[1:] != c[:-1]) + 1]
    size = np.diff(np.r_[first, len(c)])
    within = np.arange(len(c)) - np.repeat(first, size)
    sa[at[c] + step * within] = items
    at[c[first]] += step * size


def _induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The suffix array that follows from leftmost-smaller suffixes given in sorted order."""
    n, k = len(t), len(starts) - 1
    sa = np.full(n, -1, np.int64)
    by = _sorted_by(t[seeds], k)
    seeds = seeds[by]
    cut = np.searchsorted(t[seeds], np.arange(k + 1))
    head = starts[:-1].copy()
    for c in range(k):  # larger suffixes, from the small values up
        done = starts[c]
        while done < head[c]:  # what the bucket gets from itself comes in further rounds
            now, done = sa[done : head[c]], head[c]
            back = now[now > 0] - 1
            _deal(sa, head, back[~small[back]], t, 1)
        back = seeds[cut[c] : cut[c + 1]]
        _deal(sa, head, back[back > 0] - 1, t, 1)
    tail = starts[1:] - 1
    for c in range(k - 1, -1, -1):  # smaller suffixes, from the large values down
        done = starts[c + 1] - 1
        while done > tail[c]:
            now, done = sa[tail[c] + 1 : done + 1][::-1], tail[c]
            back = now[now > 0] - 1
            _deal(sa, tail, back[small[back]], t, -1)
        now = sa[starts[c] : head[c]][::-1]
        back = now[now > 0] - 1
        _deal(sa, tail, back[small[back]], t, -1)
    sa[0] = n - 1
    return sa


def _sorted_by(values: np.ndarray, bound: int) -> np.ndarray:
    """Stable order of values below ``bound``; sixteen bits are sorted by radix."""
    return np.argsort(values.astype(np.uint16) if bound <= 1 << 16 else values, kind="stable")


def _doubled(t: np.ndarray) -> np.ndarray:
    """Suffix array by doubling ranks: ends the recursion where the alphabet is large.

    A rank is the first place of its group; suffixes that are alone in theirs are not sorted again.
    """
    n, width = len(t), 1
    order = _sorted_by(t, int(t.max()) + 1)
    rank, at = np.empty(n, np.int64), np.arange(n)

    def regroup(places: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Ranks by ``key`` of the suffixes at ``places``; the places of those that are not alone yet."""
        first = np.r_[True, key[1:] != key[:-1]]
        rank[order[places]] = np.maximum.accumulate(np.where(first, places, 0))
        return places[~(first & np.r_[first[1:], True])]

    alive = regroup(at, t[order])
    while len(alive):
        items = order[alive]
        further = items + width
        key = rank[items] * (n + 1) + np.where(further < n, rank[np.minimum(further, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[alive] = items[by]
        alive = regroup(alive, key[by])
        width *= 2
    return order


def suffix_array(t: np.ndarray, alphabet: int, direct: int = 1024) -> np.ndarray:
    """Induced sorting; ``t`` ends in its only 0. Reduced strings of a larger alphabet are doubled."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    starts = np.r_[0, np.cumsum(np.bincount(t, minlength=alphabet))]
    if len(lms) > 1:
        sa = _induce(t, small, lms, starts)  # sorts the leftmost-smaller substrings
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ordered = sa[is_lms[sa]]
        end = np.zeros(n, np.int64)
        end[lms] = np.r_[lms[1:], n - 1]
        size = end[ordered] - ordered
        differs = np.ones(len(ordered), bool)
        differs[1:] = size[1:] != size[:-1]
        alive = np.flatnonzero(~differs)
        k = 0
        while len(alive):  # name equal substrings equally
            a, b = ordered[alive], ordered[alive - 1]
            apart = t[a + k] != t[b + k]
            differs[alive[apart]] = True
            alive = alive[~apart & (k < size[alive])]
            k += 1
        names = np.cumsum(differs) - 1
        if names[-1] + 1 < len(lms):
            reduced = np.zeros(n, np.int64)
            reduced[ordered] = names
            reduced = reduced[lms]
            order = suffix_array(reduced, int(names[-1]) + 1, direct) if names[-1] < direct else _doubled(reduced)
            ordered = lms[order]
        lms = ordered
    return _induce(t, small, lms, starts)


def repeated_starts(segments: list[bytes], starts: np.ndarray, lengths: tuple[int, ...]) -> list[list[np.ndarray]]:
    """For each of ``lengths`` and each segment, which of its first ``starts`` places begin a string of so
    many bytes that begins at such a place elsewhere too, in the same segment or another one.
    """
    text = np.frombuffer(bytes([SEPARATOR]).join(segments) + bytes([SEPARATOR]), np.uint8)
    n = len(text)
    sa = suffix_array(np.r_[text.astype(np.int64) + 1, 0], 257)[1:]
    ends = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)) + 1) - 1
    cuts = np.r_[0, ends[:-1] + 1]
    own = np.zeros(n + 1, np.int8)  # places that are starts; the bytes behind them belong to other segments
    np.add.at(own, cuts, 1)
    np.add.at(own, cuts + starts, -1)
    own = np.cumsum(own)[:n] > 0
    sa = sa[own[sa]]
    before = np.full(n, -1, np.int64)  # the start that sorts just before each start
    before[sa[1:]] = sa[:-1]
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    # permuted common prefixes: where the neighbour moves along, the prefix is one shorter
    at = np.arange(n)
    chained = np.zeros(n, bool)
    chained[1:] = (before[1:] > 0) & (before[1:] == before[:-1] + 1) & (text[:-1] == text[before[1:] - 1]) & (left[:-1] > 0) & own[:-1]
    fresh = np.flatnonzero(~chained & (before >= 0))
    limit = np.minimum(left[fresh], left[before[fresh]])
    words = np.ndarray((n,), "<u8", buffer=text.tobytes() + b"\0" * 8, strides=(1,))
    common, alive, k = limit.copy(), np.flatnonzero(limit > 0), 0
    while len(alive):
        differ = words[fresh[alive] + k] ^ words[before[fresh[alive]] + k]
        stop = differ != 0
        low = differ[stop] & (~differ[stop] + np.uint64(1))
        here = alive[stop]
        common[here] = np.minimum(limit[here], k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3))
        alive = alive[~stop]
        k += 8
        alive = alive[limit[alive] > k]
    plcp = np.zeros(n, np.int64)
    plcp[fresh] = common
    origin = np.maximum.accumulate(np.where(chained, 0, at))
    plcp = np.maximum(plcp[origin] - (at - origin), 0)
    plcp[before < 0] = 0
    out = []
    for length in lengths:
        again = plcp >= length
        again[before[again]] = True
        out.append([again[a : a + k] for a, k in zip(cuts.tolist(), starts.tolist(), strict=True)])
    return out
