"""Elias-Fano sequences in numpy, and an n-gram trie of memory-mapped levels over them."""

from __future__ import annotations

import json

import numpy as np


def _byte_select() -> np.ndarray:
    """[byte, k]: place of the k-th set bit."""
    out = np.zeros((256, 8), np.int64)
    for b in range(256):
        for k, i in enumerate(i for i in range(8) if b >> i & 1):
            out[b, k] = i
    return out


SELECT = _byte_select()


class EliasFano:
    """A non-decreasing sequence of n numbers below a universe u in about n * (2 + log2(u / n)) bits.

    The low bits are packed; the high parts are set bits at (high + index) of a bit
    vector. Lookups are vectorised over arrays of queries.
    """

    def __init__(self, n: int, shift: int, low: np.ndarray, high: np.ndarray):
        self.n, self.shift, self.low, self.high = n, shift, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate(([0], np.cumsum(ones)))[:-1]
        self.zeros = np.arange(len(high), dtype=np.int64) * 64 - self.ones

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        shift = max(0, int(np.log2(max(1, universe) / max(1, n))))
        place = (values >> np.uint64(shift)).astype(np.int64) + np.arange(n)
        bits = np.zeros(((n + (int(universe) >> shift) + 2 + 63) // 64 + 1) * 64, np.uint8)
        bits[place] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        low = np.zeros((n * shift + 63) // 64 + 1, np.uint64)
        if shift:
            part = values & np.uint64((1 << shift) - 1)
            at = np.arange(n, dtype=np.int64) * shift
            word, off = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << off)
            over = (off.astype(np.int64) + shift) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - off[over]))
        return cls(n, shift, low, high)

    def _select(self, k: np.ndarray, counts: np.ndarray, flip: bool) -> np.ndarray:
        w = np.searchsorted(counts, k, side="right") - 1
        rest = k - counts[w]
        word = ~self.high[w] if flip else self.high[w]
        place = w * 64
        for step in (32, 16, 8):
            c = np.bitwise_count(word & np.uint64((1 << step) - 1)).astype(np.int64)
            go = rest >= c
            rest = rest - np.where(go, c, 0)
            word = word >> np.where(go, np.uint64(step), np.uint64(0))
            place = place + np.where(go, step, 0)
        return place + SELECT[(word & np.uint64(255)).astype(np.int64), rest]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.shift:
            return np.zeros(len(i), np.uint64)
        at = i * self.shift
        word, off = at >> 6, (at & 63).astype(np.uint64)
        upper = np.where(off == 0, np.uint64(0), self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63)))
        return (self.low[word] >> off | upper) & np.uint64((1 << self.shift) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        high = self._select(i, self.ones, False) - i
        return (high << self.shift) | self._low(i).astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where it does not occur: its high part names a run, searched by the low part."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        high = values >> self.shift
        end = self._select(high, self.zeros, True) - high
        before = np.maximum(high - 1, 0)
        start = np.where(high > 0, self._select(before, self.zeros, True) - before, 0)
        want = (values & ((1 << self.shift) - 1)).astype(np.uint64)
        out = np.full(len(values), -1, np.int64)
        live = np.flatnonzero(start < end)
        lo, hi = start[live], end[live]
        while len(live):
            mid = (lo + hi) >> 1
            got = self._low(mid)
            hit = got == want[live]
            out[live[hit]] = mid[hit]
            less = got < want[live]
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            on = ~hit & (lo < hi)
            live, lo, hi = live[on], lo[on], hi[on]
        return out


#: Probabilities are kept as their log10 in steps of this size, unsigned 16-bit numbers; the largest is none at all.
STEP = 12 / 65535


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(np.log10(np.maximum(p, 1e-30)) / -STEP), 0, 65535).astype(np.uint16)


def restored(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == 65535, 0.0, 10 ** (codes.astype(np.float64) * -STEP))


class Trie:
    """n-grams up to order 3 over word numbers 0..words-1, kept in levels of a mapped file.

    Level 2 holds the successors of each word, level 3 those of each bigram; each
    level is an Elias-Fano sequence of context * span + successor. The successor of
    a bigram (u, v) is named relative to its shorter context: by its rank among the
    successors of v. Pointers to where a context's successors begin are Elias-Fano
    sequences too; probabilities and back-off weights are quantised logarithms.

    Probabilities are smoothed by interpolated absolute discounting down to the
    bigrams. What is left for single words is a weight: a word w of probability p(w)
    has a + b * p(w) after its context, with (a, b) from weights().
    """

    def __init__(self, arrays: dict[str, np.ndarray], meta: dict):
        self.words, self.span = meta["words"], meta["span"]
        self.sequences = {k: EliasFano(n, s, arrays[f"{k}.low"], arrays[f"{k}.high"]) for k, (n, s) in meta["sequences"].items()}
        self.arrays, self.meta = arrays, meta

    @classmethod
    def build(cls, counts: np.ndarray, two: np.ndarray, n2: np.ndarray, before: np.ndarray, here: np.ndarray, n3: np.ndarray, discount: float) -> Trie:
        """counts: of each word as a context (0: not known, its successors have no mass of their own);
        two, n2: keys u * words + v and counts of the kept bigrams, ascending;
        before, here, n3: kept trigrams (u, v, w) as the indices in ``two`` of (u, v) and (v, w), and their counts."""
        words = len(counts)
        context = two // max(1, words)
        ratio = np.where(counts[context] > 0, (n2 - discount) / np.maximum(1, counts[context]), 0.0) if len(two) else np.zeros(0)
        back1 = np.maximum(1e-12, 1 - np.bincount(context, ratio, words))
        first = np.searchsorted(two, np.arange(words + 1, dtype=np.int64) * words)
        span = int(np.diff(first).max(initial=0)) + 1
        three = before * span + here - first[two[before] % max(1, words)] if len(before) else np.zeros(0, np.int64)
        order = np.argsort(three)
        three, before, here, n3 = three[order], before[order], here[order], n3[order]
        ratio3 = (n3 - discount) / n2[before] if len(three) else np.zeros(0)
        back2 = np.maximum(1e-12, 1 - np.bincount(before, ratio3, len(two)))
        p3 = ratio3 + back2[before] * ratio[here] if len(three) else np.zeros(0)
        sequences = {"level2": EliasFano.of(two, words * words), "level3": EliasFano.of(three, max(1, len(two)) * span), "first2": EliasFano.of(first, len(two) + 1)}
        arrays = {"prob2": quantised(ratio), "prob3": quantised(p3), "back1": quantised(back1), "back2": quantised(back2)}
        for k, s in sequences.items():
            arrays |= {f"{k}.low": s.low, f"{k}.high": s.high}
        return cls(arrays, {"words": words, "span": span, "sequences": {k: (s.n, s.shift) for k, s in sequences.items()}})

    def save(self, path: str) -> None:
        """One file: a line of JSON, then the arrays at offsets divisible by 8."""
        at, places = 0, {}
        for k, x in self.arrays.items():
            places[k] = (at, str(x.dtype), len(x))
            at += (x.nbytes + 7) // 8 * 8
        head = json.dumps(self.meta | {"places": places}).encode()
        head += b" " * (-(len(head) + 1) % 8) + b"\n"
        with open(path, "wb") as f:
            f.write(head)
            for x in self.arrays.values():
                f.write(x.tobytes() + b"\0" * (-x.nbytes % 8))

    @classmethod
    def load(cls, path: str) -> Trie:
        """Map the file; pages come from disk as queries touch them."""
        with open(path, "rb") as f:
            head = f.readline()
        meta = json.loads(head)
        arrays = {k: np.memmap(path, d, "r", len(head) + at, (n,)) if n else np.zeros(0, d) for k, (at, d, n) in meta["places"].items()}
        return cls(arrays, meta)

    def bigrams(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Index of each bigram, -1 where it is not kept; negative words are in none."""
        out = np.full(len(u), -1, np.int64)
        known = np.flatnonzero((u >= 0) & (v >= 0))
        keys, back = np.unique(u[known].astype(np.int64) * self.words + v[known], return_inverse=True)
        out[known] = self.sequences["level2"].find(keys)[back]
        return out

    def trigrams(self, before: np.ndarray, v: np.ndarray, here: np.ndarray) -> np.ndarray:
        """Index of each trigram in level 3: under bigram ``before`` (u, v), by the rank of ``here`` (v, w) among the successors of v."""
        out = np.full(len(before), -1, np.int64)
        known = np.flatnonzero((before >= 0) & (here >= 0))
        if len(known):
            relative = here[known] - self.sequences["first2"].get(v[known].astype(np.int64))
            out[known] = self.sequences["level3"].find(before[known] * self.span + relative)
        return out

    def weights(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a, b) of each w after (u, v); a negative u is no word, a negative w one that no n-gram holds."""
        arrays = self.arrays
        here, before = self.bigrams(v, w), self.bigrams(u, v)
        a, b = np.zeros(len(v)), restored(arrays["back1"][v])
        if len(arrays["prob2"]):
            a = np.where(here >= 0, restored(arrays["prob2"][np.maximum(here, 0)]), 0.0)
            off = np.where(before >= 0, restored(arrays["back2"][np.maximum(before, 0)]), 1.0)
            a, b = a * off, b * off
            if len(arrays["prob3"]):
                third = self.trigrams(before, v, here)
                a = np.where(third >= 0, restored(arrays["prob3"][np.maximum(third, 0)]), a)
        return a, b
