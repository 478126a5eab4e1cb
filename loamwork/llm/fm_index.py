"""FM-index over a shard of words: backward search through wavelet ranks, places by sampled suffix positions."""

from __future__ import annotations

import numpy as np

#: Every so many words of a run the suffix's position is kept.
SAMPLE = 8


class Wavelet:
    """Ranks of symbols in a sequence, a bit vector per level with the running count of its ones."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.ones, self.zeros = levels, [], []
        at = symbols
        for level in range(levels - 1, -1, -1):
            bit = (at >> level & 1).astype(bool)
            ones = np.zeros(len(at) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(at) - int(ones[-1]))
            at = np.concatenate([at[~bit], at[bit]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its end."""
        low, high = np.zeros(len(ends), np.int64), ends.astype(np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            set_bit = (symbols >> (self.levels - 1 - k) & 1).astype(bool)
            one_low, one_high = ones[low], ones[high]
            low = np.where(set_bit, zeros + one_low, low - one_low)
            high = np.where(set_bit, zeros + one_high, high - one_high)
        return high - low


class FMIndex:
    """Index of runs of words.  text: symbols from 1; every run ends in a 0, which no pattern holds.

    The zeros sort by their place, so no comparison goes on beyond a run.  A walk back never crosses a zero
    either, as the first place of each run is sampled.
    """

    def __init__(self, text: np.ndarray):
        self.text = text.astype(np.int64)
        n = len(text)
        levels = max(1, int(self.text.max(initial=0)).bit_length())
        ends = self.text == 0
        rank = np.where(ends, np.cumsum(ends) - 1, self.text + int(ends.sum()))
        order, width = np.argsort(rank, kind="stable"), 1
        rank = self._ranks(rank, order)
        while n and rank.max() < n - 1:
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            rank = self._ranks(key, order)
            width *= 2
        self.order = order
        self.last = self.text[order - 1]  # the word before each suffix
        self.wavelet = Wavelet(self.last, levels)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=1 << levels))])
        starts = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1]) if n else np.zeros(0, np.int64)
        lengths = np.diff(np.concatenate([starts, [n]]))
        within = np.arange(n) - np.repeat(starts, lengths)
        self.sampled = (within % SAMPLE == 0)[order]
        self.slot = np.cumsum(self.sampled) - 1
        self.places = order[self.sampled]
        del self.order

    @staticmethod
    def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
        ordered = key[order]
        out = np.empty(len(key), np.int64)
        out[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if len(key) else []
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of patterns (rows of symbols of one length), last word first."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.text), np.int64)
        alive = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, k]
            known = c < len(self.first) - 1
            c = np.where(known, c, 0)
            a = self.first[c] + self.wavelet.rank(c, low[alive])
            b = self.first[c] + self.wavelet.rank(c, high[alive])
            low[alive], high[alive] = np.where(known, a, 0), np.where(known, b, 0)
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        dead = np.ones(len(patterns), bool)
        dead[alive] = False
        low[dead] = high[dead] = 0
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of suffixes by their rank: walk back to the next sampled one."""
        out, rows, at = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        steps = 0
        while len(at):
            here = self.sampled[rows]
            out[at[here]] = self.places[self.slot[rows[here]]] + steps
            at, rows = at[~here], rows[~here]
            c = self.last[rows]
            rows = self.first[c] + self.wavelet.rank(c, rows)
            steps += 1
        return out
