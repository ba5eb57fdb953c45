"""A full-text index over a sequence of symbols: BWT in a wavelet matrix, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

_U64 = np.uint64
#: Every so many positions of the text one is kept with the index.
SAMPLE = 8


class Bits:
    """A bit vector with rank in constant time: packed words and the count before each."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        words = -(-self.n // 64) + 1
        packed = np.zeros(words * 8, np.uint8)
        b = np.packbits(bits, bitorder="little")
        packed[: len(b)] = b
        self.words = packed.view(_U64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many ones lie before each position."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((_U64(1) << (i & 63).astype(_U64)) - _U64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(_U64)) & _U64(1)


class WaveletMatrix:
    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = ((seq >> shift) & 1).astype(bool)
            self.levels.append((shift, Bits(bit), int(len(seq) - bit.sum())))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol lies before each position."""
        start = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = ((c >> shift) & 1).astype(bool)
            ri, rs = bits.rank(i), bits.rank(start)
            i = np.where(one, zeros + ri, i - ri)
            start = np.where(one, zeros + rs, start - rs)
        return i - start

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it lies before."""
        c, start = np.zeros_like(i), np.zeros_like(i)
        for _, bits, zeros in self.levels:
            one = bits.get(i).astype(bool)
            ri, rs = bits.rank(i), bits.rank(start)
            i = np.where(one, zeros + ri, i - ri)
            start = np.where(one, zeros + rs, start - rs)
            c = 2 * c + one
        return c, i - start


class FMIndex:
    """Symbols are 1 .. sigma - 1; 0 separates and ends the texts and is never searched for.

    Every separator sorts as a symbol of its own, so comparing suffixes ends at the next one, whatever copies the texts
    hold. The places behind separators are sampled, so that no walk crosses one.
    """

    def __init__(self, text: np.ndarray, sigma: int):
        text = np.append(text, 0).astype(np.int64)
        n, zero = len(text), text == 0
        rank, h = np.where(zero, np.cumsum(zero) - 1, text + zero.sum()), 1
        while True:
            second = np.zeros(n, np.int64)
            second[: n - h] = rank[h:] + 1
            both = rank * (int(rank.max()) + 2) + second
            sa = np.argsort(both, kind="stable")
            s = both[sa]
            rank = np.empty(n, np.int64)
            rank[sa] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
            h *= 2
            if h >= n or rank.max() == n - 1:
                break
        self.n, self.sigma = n, sigma
        bwt = text[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.wm = WaveletMatrix(bwt, sigma)
        sampled = (sa % SAMPLE == 0) | (bwt == 0)
        self.marks, self.samples = Bits(sampled), sa[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of rows of each phrase; phrases are the rows of an array, filled up with zeros."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(phrases.shape[1]):
            live = np.flatnonzero((lengths > step) & (lo < hi))
            if not len(live):
                break
            c = phrases[live, lengths[live] - 1 - step]
            lo[live] = self.first[c] + self.wm.rank(c, lo[live])
            hi[live] = self.first[c] + self.wm.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row: back step by step to a sampled one."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.marks.get(at[live]).astype(bool)
            d = live[done]
            out[d] = self.samples[self.marks.rank(at[d])] + steps[d]
            live = live[~done]
            c, before = self.wm.access(at[live])
            at[live] = self.first[c] + before
            steps[live] += 1
        return out
