"""A compressed word-level FM-index: a wavelet matrix and two bit vectors.

The suffix order and the ranks from which it comes live only while the index is
built. What is kept, beside the vocabulary, is the wavelet matrix of the words
before each suffix, a bit per suffix that tells whether its first ``depth`` (or
``depth`` - 1) words are new, and one sample per group of suffixes equal in
``depth`` words: the least label of the texts that hold them. So a window's
label is found by backward search only.
"""

from __future__ import annotations

import numpy as np

#: 64-bit words of a bit vector between two stored counts.
BLOCK = 8


class Bits:
    """A bit vector with rank and select; counts every BLOCK words."""

    def __init__(self, bit: np.ndarray):
        words = len(bit) // 64 + 1
        packed = np.zeros(-(-words // BLOCK) * BLOCK * 8, np.uint8)
        raw = np.packbits(bit, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view(np.uint64)
        inside = np.bitwise_count(self.words).reshape(-1, BLOCK).astype(np.uint16)
        # ones before each block, and before each word within its block
        self.blocks = np.append(0, np.cumsum(inside.sum(1, dtype=np.uint32)))[:-1].astype(np.uint32)
        self.inner = (np.cumsum(inside, 1, dtype=np.uint16) - inside).reshape(-1).astype(np.uint16)
        self.size, self.total = len(bit), int(bit.sum())

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.blocks.nbytes + self.inner.nbytes

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.blocks[word // BLOCK].astype(np.int64) + self.inner[word] + np.bitwise_count(self.words[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th one (from 0); the size, where there is none."""
        block = np.searchsorted(self.blocks, k, "right") - 1
        out = np.full(len(k), self.size, np.int64)
        there = np.flatnonzero(k < self.total)
        left = k[there] - self.blocks[block[there]]
        word = block[there] * BLOCK
        for step in (4, 2, 1):  # the last word of the block that has no more ones before it
            ahead = word + step
            word = np.where(self.inner[ahead] <= left, ahead, word)
        left = left - self.inner[word]
        rest = self.words[word].copy()
        at = np.zeros(len(there), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(rest & np.uint64((1 << width) - 1)).astype(np.int64)
            up = low <= left
            left, at = np.where(up, left - low, left), np.where(up, at + width, at)
            rest = np.where(up, rest >> np.uint64(width), rest)
        out[there] = word * 64 + at
        return out


class WaveletMatrix:
    """Rank queries over small integers: a bit vector per bit."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.depth = max(1, int(symbols - 1).bit_length())
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        at = values.astype(np.uint32)
        for level in range(self.depth):
            bit = (at >> np.uint32(self.depth - 1 - level)) & np.uint32(1) == 1
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(at) - bit.sum()))
            at = np.concatenate([at[~bit], at[bit]])
        every = np.arange(symbols, dtype=np.int64)
        self.base = self._down(every, np.zeros(symbols, np.int64)).astype(np.uint32)

    @property
    def nbytes(self) -> int:
        return sum(b.nbytes for b in self.bits) + self.base.nbytes

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits in enumerate(self.bits):
            ones = bits.rank(i)
            up = (symbol >> (self.depth - 1 - level)) & 1 == 1
            i = np.where(up, self.zeros[level] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._down(symbol, i) - self.base[symbol].astype(np.int64)


def _sorted_by(text: np.ndarray, depth: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in the order of their first 2^k >= depth words, and where the
    first ``depth - 1`` and ``depth`` words of one differ from those before it."""
    n = len(text)
    ranks = [text]
    order, length = np.argsort(text, kind="stable"), 1
    while length < depth:
        last = ranks[-1]
        after = np.zeros(n, np.int64)
        after[: n - length] = last[length:] + 1 if length < n else 0
        key = last * (n + 2 + largest) + after
        order = np.argsort(key, kind="stable")
        new = np.append(0, key[order][1:] != key[order][:-1]).astype(np.int64) if n else np.zeros(0, np.int64)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        ranks.append(rank)
        length *= 2

    def changes(words: int) -> np.ndarray:
        new, done = np.zeros(n, bool), 0
        new[:1] = True
        for level in range(len(ranks) - 1, -1, -1):
            while done + (1 << level) <= words:
                r = np.append(ranks[level], np.full(words + 1, -1))[order + done]
                new[1:] |= r[1:] != r[:-1]
                done += 1 << level
        return new

    return order, changes(depth - 1), changes(depth)


class FMIndex:
    """Index of texts (lists of word hashes) for patterns of up to ``depth`` words.

    ``labels`` has a number per text; ``least`` answers with the least of those
    of the texts that hold a pattern of ``depth`` words. Patterns of no more
    than ``depth`` words can't tell suffixes apart that agree in as many, so
    these needn't be in order.
    """

    def __init__(self, words: np.ndarray, first: np.ndarray, labels: np.ndarray, depth: int):
        self.depth = depth
        self.vocabulary = np.unique(words)
        n = len(words) + len(first) - 1
        text = np.zeros(n, np.int64)  # 0 ends each text
        size = np.diff(first)
        text_of = np.repeat(np.arange(len(size)), size + 1)
        start = first[:-1] + np.arange(len(size))
        own = np.arange(n) < (start + size)[text_of]
        text[own] = np.searchsorted(self.vocabulary, words) + 1
        symbols = len(self.vocabulary) + 1
        order, shorter, whole = _sorted_by(text, depth, len(self.vocabulary))
        self.lower = np.append(0, np.cumsum(np.bincount(text, minlength=symbols)))[:-1].astype(np.uint32)
        self.wavelet = WaveletMatrix(text[order - 1] if n else text, symbols)
        self.shorter, self.whole = Bits(shorter), Bits(whole)
        self.labels = np.unique(labels)
        at = np.searchsorted(self.labels, labels).astype(np.uint32)[text_of[order]]
        self.samples = np.minimum.reduceat(at, np.flatnonzero(whole)) if n else np.zeros(0, np.uint32)
        self.size = n

    @property
    def nbytes(self) -> int:
        """Bytes of all that is kept."""
        return self.wavelet.nbytes + self.shorter.nbytes + self.whole.nbytes + self.samples.nbytes + self.labels.nbytes + self.lower.nbytes + self.vocabulary.nbytes

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: intervals of symbol + pattern from those of the pattern."""
        n = len(low)
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.lower[symbol].astype(np.int64)
        return base + both[:n], base + both[n:]

    def symbols(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words, and which words the index knows."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return at + 1, self.vocabulary[at] == words

    def matches(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of streamed texts: for each word, the length of the
        longest indexed passage from it on, ``depth`` at most, and for those of
        ``depth`` words the first position of their interval (else -1).

        All texts go backwards at once. A match of depth words loses its last
        word by widening its interval to that of the suffixes equal in depth - 1
        words; where a step fails, the match is shortened from its right end.
        """
        k = self.depth
        lengths, out = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        symbol, known = self.symbols(words)
        if not self.size or not len(words):
            return lengths, out
        size = np.diff(first)
        live = np.argsort(-size, kind="stable")
        at = first[1:][live] - 1
        low, high, length = np.zeros(len(live), np.int64), np.full(len(live), self.size, np.int64), np.zeros(len(live), np.int64)
        left = size[live].copy()
        while True:
            n = int(np.searchsorted(-left, 0))  # sizes fall, so the texts with words left come first
            if not n:
                return lengths, out
            i = at[:n]
            s, h = self.step(symbol[i], low[:n], high[:n])
            hit = known[i] & (h > s)
            got = np.where(hit, length[:n] + 1, 0)
            failed = np.flatnonzero(~hit & known[i] & (length[:n] > 0))
            if len(failed):
                s[failed], h[failed], got[failed] = self._shortened(symbol, known, i[failed], length[failed])
            s, h = np.where(got > 0, s, 0), np.where(got > 0, h, self.size)
            full = np.flatnonzero(got == k)
            lengths[i] = got
            out[i[full]] = s[full]
            if len(full):
                group = self.shorter.rank(s[full] + 1) - 1
                s[full], h[full] = self.shorter.select(group), self.shorter.select(group + 1)
            low[:n], high[:n] = s, h
            length[:n] = np.where(got == k, k - 1, got)
            at[:n] -= 1
            left[:n] -= 1

    def _shortened(self, symbol: np.ndarray, known: np.ndarray, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The longest matches of at most ``length`` words from each i on, by trying all lengths at once."""
        out_s, out_h, got = np.zeros(len(i), np.int64), np.full(len(i), self.size, np.int64), np.zeros(len(i), np.int64)
        for m in range(int(length.max(initial=0)), 0, -1):
            open_ = np.flatnonzero((got == 0) & (length >= m))
            low, high = np.zeros(len(open_), np.int64), np.full(len(open_), self.size, np.int64)
            for p in range(m - 1, -1, -1):
                if not len(open_):
                    break
                j = i[open_] + p
                low, high = self.step(symbol[j], low, high)
                ok = known[j] & (high > low)
                open_, low, high = open_[ok], low[ok], high[ok]
            out_s[open_], out_h[open_], got[open_] = low, high, m
        return out_s, out_h, got

    def least(self, positions: np.ndarray) -> np.ndarray:
        """The least label of the texts that hold each matched passage of ``depth`` words."""
        return self.labels[self.samples[self.whole.rank(positions + 1) - 1]]
