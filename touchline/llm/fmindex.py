"""A compressed FM-index over integer symbols, searched for many patterns at once.

The Burrows-Wheeler transform of the text is kept as a wavelet tree in level
order: one bit vector per bit of a symbol, 64 bits to a word, with the count of
ones before each word. Suffixes are sorted by their first ``DEPTH`` symbols,
which is exact for patterns up to that length.
"""

from __future__ import annotations

import numpy as np

DEPTH = 256


def suffix_order(text: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < depth:
        nxt = np.zeros(n, np.int64)
        nxt[:-k] = rank[k:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        k *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))[:-1]]).astype(np.int64)
        self.zeros = len(bits) - int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class FMIndex:
    def __init__(self, text: np.ndarray) -> None:
        """``text``: symbols from 1; 0 separates what no pattern may cross, and must come last."""
        self.size, self.levels = len(text), max(1, int(text.max(initial=1)).bit_length())
        order = suffix_order(text)
        bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.levels))])
        self.bits: list[Bits] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt >> level) & 1
            self.bits.append(Bits(bit))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        # where each symbol's run begins in the last level's order
        last = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.begin = np.zeros(1 << self.levels, np.int64)
        self.begin[bwt[last]] = last

    def back(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of patterns extended by a symbol on the left."""
        n = len(lo)
        at, symbols = np.concatenate([lo, hi]), np.concatenate([symbol, symbol])
        for level, bits in zip(range(self.levels - 1, -1, -1), self.bits):
            ones = bits.rank(at)
            at = np.where((symbols >> level) & 1, bits.zeros + ones, at - ones)
        at += (self.first[symbol] - self.begin[symbol])[np.arange(2 * n) % n] if n else 0
        return at[:n], at[n:]


def repeated_windows(index: FMIndex, text: np.ndarray, starts: np.ndarray, windows: np.ndarray, width: int, copied: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matching statistics against a threshold: (segment, first, last) ranges of windows that occur at least twice in the index.

    Segments begin at ``starts`` of the indexed ``text`` and hold ``windows`` windows of ``width`` words. Each works on its
    undecided windows from both sides. Left: the first window is searched backwards from its end; where the match breaks at
    a word, no window over that word and the end repeats, so all up to that word are passed. Right: from the end of
    the last window a match is carried to the left as far as it repeats, which settles every window inside it. Segments that
    are ``copied`` begin on the right, as they are likely to match whole; the others on the left."""
    most = max(1, DEPTH - width + 1)  # longer segments are worked on in parts, each of which one match can settle
    n_parts = -(-windows // most)
    lane = np.repeat(np.arange(len(starts)), n_parts)
    part = np.arange(len(lane)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
    low = starts[lane].astype(np.int64) + part * most  # undecided windows, as places in the text
    high = np.minimum(low + most, (starts + windows)[lane]) - 1
    n = len(lane)
    right = np.zeros(n, bool) if copied is None else copied[lane]
    at = np.where(right, high, low) + width - 1
    end = at.copy()
    l, h = np.zeros(n, np.int64), np.full(n, index.size, np.int64)
    out = [(np.zeros(0, np.int64),) * 3]
    while len(lane):
        nl, nh = index.back(text[at], l, h)
        ok = nh - nl >= 2
        l, h = np.where(ok, nl, l), np.where(ok, nh, h)
        at = np.where(ok, at - 1, at)
        done = ~ok | (at < low) | (right & (end - at >= DEPTH - 1))
        if done.any():
            k = np.flatnonzero(done)
            was_right = right[k]
            # left: a match moves to the right side, a break passes the windows up to it
            on_left = k[~was_right]
            low[on_left] = np.where(ok[on_left], low[on_left], at[on_left] + 1)
            right[on_left] = ok[on_left]
            # right: the windows inside the match are repeated, and the ones before it start anew on the left side;
            # without a window inside it, the last window isn't repeated
            on_right = k[was_right]
            hit = at[on_right] + 1 <= high[on_right]
            some = on_right[hit]
            out.append((lane[some], np.maximum(at[some] + 1, low[some]), high[some].copy()))
            high[on_right] = np.where(hit, at[on_right], high[on_right] - 1)
            right[some] = False
            end[k] = np.where(right[k], high[k], low[k]) + width - 1
            at[k] = end[k]
            l[k], h[k] = 0, index.size
            keep = low <= high
            if not keep.all():
                lane, low, high, right, at, end, l, h = (x[keep] for x in (lane, low, high, right, at, end, l, h))
    seg, a, b = (np.concatenate(x) for x in zip(*out))
    return seg, a - starts[seg], b - starts[seg]
