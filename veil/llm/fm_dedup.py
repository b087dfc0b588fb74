"""Substring dedup with a compressed FM-index per shard.

Words are the symbols. ``repeats`` routes segments of text so that all occurrences of a window meet in
one shard; there the distinct segments are indexed: suffix order by rank doubling in numpy, its
Burrows-Wheeler transform in a wavelet matrix of packed bits with block counts, and LCP values capped
below the window length. Segments are streamed against the index from right to left, all of a shard
at once: backward search extends each match by a word while the pattern still occurs twice (segments
held by several texts count so often); where it doesn't, the match is cut on the right to the
enclosing LCP interval. This yields the matching statistics up to the window length, and a window is
reported where the match is that long. Words are compared, not hashes; only windows of hot passages, which
reach no shard, are compared by 128-bit digests of their words.

Defined results: null and empty texts have no words; a text shorter than the window keeps all; equal
rows (also with the same or a null doc_id) repeat each other; texts are handled whole; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veil.llm._common import sha256_hex, slices
from veil.llm.repeats import Unit, covered, keyed, union_mask, with_covered

WORDS, ROUTE = 35, 8


class WaveletMatrix:
    """Ranks of symbols in a sequence: one packed bit vector a level, with counts per 64 bits."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.n, self.depth = len(seq), max(1, int(sigma - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.depth - 1, -1, -1):
            bit = (seq >> level) & 1
            packed = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            packed[:self.n] = bit
            words = np.packbits(packed, bitorder="little").view(np.uint64)
            self.bits.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])[:-1])
            self.zeros.append(int(self.n - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        symbols = np.arange(sigma)
        self.base = self._walk(symbols, np.zeros(sigma, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.depth):
            word = at >> 6
            ones = self.counts[k][word] + np.bitwise_count(
                self.bits[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            bit = (symbol >> (self.depth - 1 - k)) & 1
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self._walk(symbol, at) - self.base[symbol]


class FmIndex:
    """Backward search over segments of symbols (integers from 1 on); 0 separates segments."""

    def __init__(self, segments: list[list[int]], weights: np.ndarray, cap: int):
        sizes = np.array([len(s) for s in segments])
        m = len(segments)
        flat = np.fromiter((x for s in segments for x in (*s, 0)), np.int64, int(sizes.sum()) + m)
        ends = np.cumsum(sizes + 1) - 1
        self.text, self.starts, self.sizes = flat, ends - sizes, sizes
        n = len(flat)
        self.n = n
        # every separator is a symbol of its own while suffixes are ordered
        rank = flat + m
        rank[ends] = np.arange(m)
        _, rank = np.unique(rank, return_inverse=True)
        levels, step = [rank], 1
        longest = int(sizes.max(initial=1)) + 1
        while step < longest:
            follow = np.zeros(n, np.int64)
            follow[:-step] = rank[step:] + 1
            key = rank * (n + 1) + follow
            order = np.argsort(key, kind="stable")
            new = np.r_[0, np.cumsum(key[order[1:]] != key[order[:-1]])]
            rank = np.empty(n, np.int64)
            rank[order] = new
            levels.append(rank)
            step *= 2
        suffix = np.empty(n, np.int64)
        suffix[rank] = np.arange(n)
        self.lcp = self._lcp(suffix, levels, cap)
        self.weight = np.r_[0, np.cumsum(np.repeat(weights, sizes + 1)[suffix])]
        sigma = int(flat.max(initial=0)) + 1
        self.first = np.r_[0, np.cumsum(np.bincount(flat, minlength=sigma))]
        self.bwt = WaveletMatrix(flat[suffix - 1], sigma)
        self.cap = cap
        self.left, self.right = self._nearest()

    def _lcp(self, suffix: np.ndarray, levels: list[np.ndarray], cap: int) -> np.ndarray:
        """LCP of neighbours, at most ``cap``; entry i is that of suffixes i-1 and i, the ends are -1."""
        n = len(suffix)
        a, b = suffix[:-1].copy(), suffix[1:].copy()
        got = np.zeros(n - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = (a < n) & (b < n)
            same = np.zeros(n - 1, bool)
            same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            a, b, got = a + (same << k), b + (same << k), got + (same << k)
        return np.r_[-1, np.minimum(got, cap), -1]

    def _nearest(self) -> tuple[np.ndarray, np.ndarray]:
        """For every entry the nearest one on either side with a smaller LCP."""
        n = len(self.lcp)
        left, right, at = np.zeros(n, np.int64), np.full(n, n - 1), np.arange(n)
        for v in range(0, self.cap + 1):
            here = self.lcp == v
            if here.any():
                smaller = self.lcp < v
                left[here] = np.maximum.accumulate(np.where(smaller, at, 0))[here]
                right[here] = np.minimum.accumulate(np.where(smaller, at, n - 1)[::-1])[::-1][here]
        return left, right

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of symbol + pattern from that of the pattern."""
        both = self.bwt.rank(np.r_[symbol, symbol], np.r_[lo, hi])
        k = len(symbol)
        return self.first[symbol] + both[:k], self.first[symbol] + both[k:]

    def matching(self, window: int) -> list[np.ndarray]:
        """For every segment, which places begin a window that occurs twice or more."""
        m = len(self.sizes)
        hit = np.zeros(self.n, bool)
        pos = self.starts + self.sizes
        lo, hi, length = np.zeros(m, np.int64), np.full(m, self.n), np.zeros(m, np.int64)
        alive = np.flatnonzero(self.sizes >= window)
        while len(alive):
            p, a, b, n = pos[alive], lo[alive], hi[alive], length[alive]
            new_a, new_b = self.step(self.text[p - 1], a, b)
            ok = self.weight[new_b] - self.weight[new_a] >= 2
            # extended
            p, n = p - ok, n + ok
            a, b = np.where(ok, new_a, a), np.where(ok, new_b, b)
            hit[p[ok & (n >= window)]] = True
            # cut on the right: to the cap first, then to the enclosing interval
            over = ~ok & (n > self.cap)
            shrink = ~ok & (n > 0) & (n <= self.cap)
            skip = ~ok & (n == 0)
            if over.any():
                x, y = a[over], b[over]
                a[over] = np.where(self.lcp[x] >= self.cap, self.left[x], x)
                b[over] = np.where(self.lcp[y] >= self.cap, self.right[y], y)
                n[over] = self.cap
            if shrink.any():
                x, y = a[shrink], b[shrink]
                depth = np.maximum(np.maximum(self.lcp[x], self.lcp[y]), 0)
                a[shrink] = np.where(depth == 0, 0, np.where(self.lcp[x] == depth, self.left[x], x))
                b[shrink] = np.where(depth == 0, self.n, np.where(self.lcp[y] == depth, self.right[y], y))
                n[shrink] = depth
            p = p - skip
            pos[alive], lo[alive], hi[alive], length[alive] = p, a, b, n
            # a match that can't grow to a whole window before the text begins is of no use
            alive = alive[(p > self.starts[alive]) & (p - self.starts[alive] + n >= window)]
        return [hit[s:s + max(k - window + 1, 0)] for s, k in zip(self.starts.tolist(), self.sizes.tolist())]


def index_words(runs: list[int], texts: list[bytes], weights: np.ndarray, window: int = WORDS) -> list[np.ndarray]:
    """Which windows of words occur twice among the segments of a shard."""
    number: dict[bytes, int] = {}
    segments = [[number.setdefault(w, len(number) + 1) for w in t.split()] for t in texts]
    return FmIndex(segments, weights, window - 1).matching(window)


def removed_words(df: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text and the spans of words that windows occurring twice or more cover."""
    unit = Unit(True, words, min(ROUTE, words))
    docs = keyed(df)
    return with_covered(docs, covered(docs, unit, lambda r, t, w: index_words(r, t, w, words)))


def _kept(text: str | None, spans) -> tuple[int, int, bytes]:
    found = (text or "").encode("utf-8").split()
    mask = union_mask(len(found), spans)
    return len(found), int(mask.sum()), b" ".join([w for w, gone in zip(found, mask.tolist()) if not gone])


def dedup_documents(df: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (joined by one space)."""
    return _assemble(removed_words(df, words), "kept string", lambda kept: kept.decode("utf-8"))


def digest_documents(df: DataFrame, words: int = WORDS) -> DataFrame:
    """The same with the SHA-256 of the kept words."""
    return _assemble(removed_words(df, words), "kept_sha256 string", sha256_hex)


def _assemble(found: DataFrame, column: str, show) -> DataFrame:
    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                rows = [_kept(t, s) for t, s in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([r[0] for r in rows], pa.int64()),
                     pa.array([r[1] for r in rows], pa.int64()), pa.array([show(r[2]) for r in rows], pa.string())],
                    names=["doc_id", "n_words", "n_removed", column.split()[0]])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, {column}")
