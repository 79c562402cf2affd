"""An FM-index over the words of one shard: suffix order, a wavelet matrix of the last column, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


class Bits:
    """A bit vector with constant-time rank: 64-bit words and a running count before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(ones, dtype=np.int64)[:-1]]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w, o = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << o) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


def suffix_order(symbols: np.ndarray, alphabet: int) -> np.ndarray:
    """Start positions in order of suffix. As many symbols as fit in 63 bits give the first order;
    then only groups that are still equal are ordered by the rank of what follows, twice as far each time.
    The caller gives each end of document a symbol of its own, so all suffixes differ."""
    n = len(symbols)
    bits = max(1, int(alphabet - 1).bit_length())
    depth = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    for j in range(depth):
        key[: n - j] |= symbols[j:] << (bits * (depth - 1 - j)) if j < n else 0
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    alone = new & np.concatenate([new[1:], [True]])
    open_ = np.flatnonzero(~alone)
    while len(open_):
        at = order[open_]
        after = at + depth
        then = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        group = rank[at]
        place = np.lexsort((then, group))
        at, then, group = at[place], then[place], group[place]
        order[open_] = at
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (then[1:] != then[:-1])])
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        alone = new & np.concatenate([new[1:], [True]])
        open_ = open_[~alone]
        depth *= 2
    return order


class FMIndex:
    """Built from documents given as arrays of word numbers 0 .. vocabulary-1."""

    def __init__(self, documents: list[np.ndarray], vocabulary: int):
        docs = len(documents)
        lengths = np.array([len(d) for d in documents], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
        ends = self.starts + lengths
        n = int((lengths + 1).sum())
        text = np.zeros(n, np.int64)  # symbol 0 ends a document, word w is w + 1
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = np.concatenate(documents) + 1
        unique = text + (docs - 1)
        unique[ends] = np.arange(docs)  # ends sort by document, before all words
        order = suffix_order(unique, docs + vocabulary)
        last = text[order - 1]
        counts = np.bincount(text, minlength=vocabulary + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        self.present = counts > 0
        sampled = (order % SAMPLE == 0) | (last == 0)
        self.marks = Bits(sampled)
        self.samples = order[sampled]
        self.n = n
        self.height = max(1, int(vocabulary).bit_length())
        self.levels, self.zeros = [], []
        for level in range(self.height - 1, -1, -1):
            bit = ((last >> level) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int((~bit).sum()))
            last = np.concatenate([last[~bit], last[bit]])
        # after the last level equal symbols stand together; where each symbol's run begins
        self.first = np.zeros(vocabulary + 1, np.int64)
        heads = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        self.first[last[heads]] = heads

    def _down(self, symbol: np.ndarray, *positions: np.ndarray) -> list[np.ndarray]:
        """How often ``symbol`` stands before each position of the last column."""
        positions = list(positions)
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.height - 1 - k)) & 1 == 1
            for i, p in enumerate(positions):
                r = bits.rank(p)
                positions[i] = np.where(one, zeros + r, p - r)
        return [p - self.first[symbol] for p in positions]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern. ``patterns`` holds word
        numbers, one pattern a row, -1 where a word is not in the shard and -2 before a shorter pattern's first word."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        missing = (patterns == -1).any(1)
        high[missing] = 0
        live = np.flatnonzero(~missing)
        for column in range(patterns.shape[1] - 1, -1, -1):
            live = live[high[live] > low[live]]
            step = live[patterns[live, column] >= 0]
            if not len(step):
                continue
            symbol = patterns[step, column] + 1
            a, b = self._down(symbol, low[step], high[step])
            low[step], high[step] = self.before[symbol] + a, self.before[symbol] + b
        high[high <= low] = low[high <= low]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back to a sampled suffix, at most SAMPLE - 1 times."""
        found, steps = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        open_, at = np.arange(len(rows)), rows.copy()
        while len(open_):
            hit = self.marks.get(at) == 1
            found[open_[hit]] = self.samples[self.marks.rank(at[hit])] + steps[open_[hit]]
            open_, at = open_[~hit], at[~hit]
            if not len(open_):
                break
            symbol, p = np.zeros(len(at), np.int64), at
            for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
                bit, r = bits.get(p), bits.rank(p)
                symbol |= bit << (self.height - 1 - k)
                p = np.where(bit == 1, zeros + r, p - r)
            at = self.before[symbol] + p - self.first[symbol]
            steps[open_] += 1
        return found
