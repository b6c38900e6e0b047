"""Minimal acyclic automata with word numbers, built and asked by numpy.

Words are rows of symbols 1, 2, ..., filled up with 0. The states are the different right languages of
the trie's nodes (told by a 64-bit hash worked out from the leaves up), so the automaton is minimal. Every
state knows how many words lie behind it; the sum of what a path passes by is the number of its word in
sorted order, a minimal perfect hash.
"""

from __future__ import annotations

import numpy as np


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Automaton:
    """The minimal automaton of different words; state 0 is dead, state 1 the first one."""

    def __init__(self, codes: np.ndarray, symbols: int) -> None:
        """``codes``: sorted different rows of symbols below ``symbols``, filled with 0."""
        n, width = codes.shape
        self.words = n
        lengths = (codes != 0).sum(1)
        unlike = codes[1:] != codes[:-1]
        shared = np.r_[-1, unlike.argmax(1)] if n and width else np.full(n, -1)
        # trie nodes of each depth, from the deepest up: hash of the right language, words behind
        hashes, counts, finals, edges = [], [], [], []
        below = None  # (first row, hash, count) of the nodes one deeper
        for depth in range(width, -1, -1):
            rows = np.flatnonzero(lengths >= depth)
            new = shared[rows] < depth if depth else np.arange(len(rows)) == 0
            first = rows[new]
            if not len(first):
                continue
            final = (lengths[first] == depth).astype(np.uint64)
            h, count, edge = final * np.uint64(0x9E3779B97F4A7C15), final.astype(np.int64), None
            if below is not None and len(below[0]):
                parent = np.searchsorted(first, below[0], "right") - 1
                symbol = codes[below[0], depth].astype(np.int64)
                part = _mixed(below[1] + symbol.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                np.add.at(h, parent, part)
                count = count + np.bincount(parent, below[2], len(first)).astype(np.int64)
                edge = (parent, symbol, below[1])
            h = _mixed(h + np.uint64(1))
            if edge is not None:
                edges.append((h[edge[0]], edge[1], edge[2]))
            hashes.append(h)
            counts.append(count)
            finals.append(final)
            below = (first, h, count)
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        names, at = np.unique(every, return_index=True)
        self.size = len(names)
        self.final = np.r_[False, np.concatenate(finals)[at].astype(bool)] if len(names) else np.zeros(1, bool)
        behind = np.r_[0, np.concatenate(counts)[at]] if len(names) else np.zeros(1, np.int64)
        self.start = int(np.searchsorted(names, every[-1])) + 1 if len(names) else 0
        # transitions, sorted by state and symbol
        if edges:
            source, label, target = (np.concatenate(x) for x in zip(*edges, strict=True))
            key = (np.searchsorted(names, source) + 1) * np.int64(symbols) + label
            key, at = np.unique(key, return_index=True)
            self.label, self.target = key % symbols, np.searchsorted(names, target[at]) + 1
            source = key // symbols
        else:
            key = source = self.label = self.target = np.zeros(0, np.int64)
        self.first = np.searchsorted(source, np.arange(self.size + 2))
        passed = np.cumsum(behind[self.target]) - behind[self.target]
        before = passed - passed[self.first[source]] if len(key) else passed
        self.passed = before + self.final[source]
        self.key, self.symbols = key, symbols

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states (0: none) and the words passed by."""
        if not len(self.key):
            return np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
        want = state * self.symbols + symbol
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        hit = self.key[at] == want
        return np.where(hit, self.target[at], 0), np.where(hit, self.passed[at], 0)

    def near(self, codes: np.ndarray, lengths: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query row, word number) of the words one edit away from a query whose first ``exact`` symbols
        stand unchanged: the symbols are followed as they are, the rest with one error. No pair comes twice."""
        query, padded = np.arange(len(codes)), np.c_[codes, np.zeros(len(codes), codes.dtype)]
        state, number = np.full(len(codes), self.start), np.zeros(len(codes), np.int64)
        for i in range(int(exact.max(initial=0))):
            on = exact[query] > i
            after, passed = self.step(state[on], codes[query[on], i])
            state[on], number[on] = after, number[on] + passed
            alive = state > 0
            query, state, number = query[alive], state[alive], number[alive]
        place = exact[query]
        found_q, found_n = [], []
        # words with an error behind them, in step with those without: equal ways are one
        q = s = n = p = np.zeros(0, np.int64)
        while len(query) or len(q):
            done = p == lengths[q]
            hit = done & self.final[s]
            found_q.append(q[hit])
            found_n.append(n[hit])
            q, s, n, p = q[~done], s[~done], n[~done], p[~done]
            s, passed = self.step(s, codes[q, p])
            alive = s > 0
            q, s, n, p = q[alive], s[alive], (n + passed)[alive], p[alive] + 1
            # one error here: a symbol more, another one, or one less
            out = self.first[state + 1] - self.first[state]
            row = np.repeat(np.arange(len(query)), out)
            edge = self.first[state][row] + np.arange(len(row)) - np.repeat(np.cumsum(out) - out, out)
            left = place < lengths[query]
            other = left[row] & (self.label[edge] != padded[query[row], place[row]])
            more = number[row] + self.passed[edge]
            q = np.concatenate([q, query[row], query[row][other], query[left]])
            s = np.concatenate([s, self.target[edge], self.target[edge][other], state[left]])
            n = np.concatenate([n, more, more[other], number[left]])
            p = np.concatenate([p, place[row], place[row][other] + 1, place[left] + 1])
            order = np.lexsort((p, s, n, q))
            q, s, n, p = q[order], s[order], n[order], p[order]
            new = np.ones(len(q), bool)
            new[1:] = (q[1:] != q[:-1]) | (n[1:] != n[:-1]) | (s[1:] != s[:-1]) | (p[1:] != p[:-1])
            q, s, n, p = q[new], s[new], n[new], p[new]
            # no error here
            query, state, number, place = query[left], state[left], number[left], place[left]
            state, passed = self.step(state, codes[query, place])
            alive = state > 0
            query, state, number, place = query[alive], state[alive], (number + passed)[alive], place[alive] + 1
        if not found_q:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, n = np.concatenate(found_q), np.concatenate(found_n)
        both = np.unique(q * np.int64(self.words) + n)
        return both // self.words, both % self.words
