"""Suffix-array dedup of byte strings, the suffix order built by linear grouping.

``repeats`` routes segments of text so that all occurrences of a 200-byte string meet in one shard.
There the distinct segments are read as tokens (words up to one that ends in one of a quarter of all bytes, and the
white space behind it, so equal text is cut alike wherever it stands) and their suffixes are sorted in two linear phases, without recursive renaming. First, suffixes are grouped by Lyndon
prefix: groups are taken in descending order; every suffix of a group points to the previous smaller
one (the nearest to the left that is not in a group taken before), whose Lyndon prefix it
extends; the suffixes pointed to leave for a new group right above their old one, ordered by how
often they were pointed to. Then suffixes are emitted in ascending order: each emitted suffix lets the
chain of previous-smaller pointers that ends before it take the next free places of their groups.

LCP values of neighbours tell, for each token, how far its text is repeated; only a string whose whole
tokens are repeated can be. For these an exact check of all its bytes follows (two 64-bit hashes),
which settles the partial tokens at its ends.

Defined results: null and empty texts have no bytes; a text shorter than the string keeps all; equal
rows (also with the same or a null doc_id) repeat each other; overlapping repeats count; texts are
handled whole; an empty table gives an empty table. Kept bytes need not be valid UTF-8.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm._common import SMALL_BYTES, flat, give_back, sha256_hex, slices
from veil.llm.repeats import Unit, covered, document_key, keyed, mix, with_covered

BYTES, ROUTE = 200, 32

_BLANK = rb"\x09-\x0d\x20"
_CUT = b"".join(rb"\x%02x" % b for b in range(256) if b % 4 == 1 and b not in range(9, 14))
_TOKEN = re.compile(rb"(?:[^%b]++(?<![%b])[%b]++)*+[^%b]*+[%b]*+" % (_BLANK, _CUT, _BLANK, _BLANK, _BLANK))


def suffix_array(text: list[int]) -> list[int]:
    """Order of the suffixes of a sequence whose last symbol is smaller than all others."""
    n = len(text)
    if n == 0:
        return []
    # groups by first symbol, as a linked list in ascending order
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    ordered = sorted(by_symbol)
    members = [by_symbol[c] for c in ordered]
    below = list(range(-1, len(ordered) - 1))
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    size = [len(m) for m in members]
    link = list(range(n))  # of a suffix already taken: something to its left
    prev = [-1] * n
    taken: list[int] = []
    g = len(ordered) - 1
    above: dict[int, int] = {}
    for k in range(len(ordered) - 1):
        above[k] = k + 1
    def move(q: int, low: int, moved: list[int]) -> int:
        """Take suffixes out of group q into a new group right above group ``low``."""
        new = len(members)
        members.append(moved)
        size.append(len(moved))
        for j in moved:
            group[j] = new
        size[q] -= len(moved)
        up = above.get(low)
        below.append(low)
        above[low] = new
        if up is not None:
            above[new] = up
            below[up] = new
        return new

    while g >= 0:
        own = members[g] if len(members[g]) == size[g] else [i for i in members[g] if group[i] == g]
        taken.append(g)
        members[g] = own
        for i in own:
            link[i] = i - 1
        pointed: dict[int, int] = {}
        j = -1
        for i in own:
            j = i - 1
            while j >= 0 and link[j] != j:  # nearest to the left that is not taken
                link[j] = k = link[link[j]] if link[j] >= 0 else -1
                j = k
            link[i] = prev[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if len(pointed) == 1:
            j = next(iter(pointed))
            if size[group[j]] > 1:
                move(group[j], group[j], [j])
        elif pointed:
            split: dict[int, dict[int, list[int]]] = {}
            for j, times in pointed.items():
                split.setdefault(group[j], {}).setdefault(times, []).append(j)
            for q, by_times in split.items():
                if len(by_times) == 1 and len(next(iter(by_times.values()))) == size[q]:
                    continue  # the whole group moves: its place stays the same
                low = q
                for times in sorted(by_times):
                    low = move(q, low, by_times[times])
        g = below[g]
        while g >= 0 and size[g] == 0:
            g = below[g]
    start = [0] * len(members)
    at = 0
    for g in reversed(taken):
        start[g] = at
        at += len(members[g])
    order = [0] * n
    placed = [False] * n
    order[0] = n - 1
    placed[n - 1] = True
    start[group[n - 1]] += 1
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[start[g]] = j
            start[g] += 1
            placed[j] = True
            j = prev[j]
    return order


def _lcp(text: np.ndarray, order: np.ndarray, longest: int) -> np.ndarray:
    """LCP of each suffix with the one before it in order, by halving lengths over hashes of runs."""
    n = len(text)
    a, b = order[:-1].copy(), order[1:].copy()
    up = np.cumprod(np.r_[np.uint64(1), np.full(n, 0xD6E8FEB86659FD93, np.uint64)])
    values = mix(text.astype(np.uint64) + np.uint64(1))
    total = np.r_[np.uint64(0), np.cumsum(values * up[:n])]
    got = np.zeros(n - 1, np.int64)
    step = 1 << max(int(longest).bit_length() - 1, 0)
    while step:
        inside = (a + step <= n) & (b + step <= n)
        x, y = np.where(inside, a, 0), np.where(inside, b, 0)
        first, second = total[x + step * inside] - total[x], total[y + step * inside] - total[y]
        swap = x > y  # bring both runs to the same power
        small, large = np.where(swap, y, x), np.where(swap, x, y)
        low, high = np.where(swap, second, first), np.where(swap, first, second)
        same = inside & (low * up[large - small] == high)
        a, b, got = a + same * step, b + same * step, got + same * step
        step >>= 1
    return np.r_[0, got]


def index_bytes(runs: list[int], texts: list[bytes], weights: np.ndarray, window: int = BYTES) -> list[np.ndarray]:
    """Which strings of ``window`` bytes occur twice among the segments of a shard."""
    marks = [np.full(max(len(t) - window + 1, 0), w > 1) for t, w in zip(texts, weights)]
    # a segment held twice that is alone under its minimizer has nothing left to decide
    _, inverse, number = np.unique(np.array(runs), return_inverse=True, return_counts=True)
    several = np.flatnonzero((number[inverse] > 1) | (weights < 2))
    if not len(several):
        return marks
    several = several.tolist()
    tokens: list[list[int]] = []
    names: dict[bytes, int] = {}
    m = len(several)
    for s in several:
        tokens.append([names.setdefault(x, len(names)) for x in _TOKEN.findall(texts[s]) if x])
    text: list[int] = []
    for k, t in enumerate(tokens):  # separators all differ, the last one is the smallest
        text += [x + m for x in t]
        text.append(m - 1 - k)
    order = np.array(suffix_array(text))
    lcp = _lcp(np.array(text), order, max(map(len, tokens)))
    best = np.empty(len(text), np.int64)
    best[order] = np.maximum(lcp, np.r_[lcp[1:], 0])  # tokens of each suffix found elsewhere too
    size_of = np.array([len(x) for x in names] or [0])
    blank_of = size_of - np.array([len(x.rstrip(b"\x09\x0a\x0b\x0c\x0d\x20")) for x in names] or [0])
    picked, begin = [], 0
    for s, t in zip(several, tokens):
        n = len(texts[s])
        edges = np.r_[0, np.cumsum(size_of[t])]  # where tokens begin, and the end
        reach = edges[np.minimum(np.arange(len(t)) + best[begin:begin + len(t)], len(t))]
        begin += len(t) + 1
        at = np.arange(max(n - window + 1, 0))
        inner = edges[:-1]
        # the byte that ended the token before decides where a token begins; the first one's lies elsewhere
        decided = np.r_[-1, inner[1:] - blank_of[t[:-1]] - 1] if t else inner
        first = np.searchsorted(decided, at)  # first token of whose beginning the string itself decides
        last = np.searchsorted(inner, at + window - 1, side="right") - 1  # last that begins within it
        ok = last <= first
        whole = ~ok
        ok[whole] = reach[first[whole]] >= inner[last[whole]]
        picked.append(at[ok])
    data, starts = flat([texts[s] for s in several])
    places = np.concatenate([starts[k] + p for k, p in enumerate(picked)])
    if not len(places):
        return marks
    count = _occurrences(data, places, window)
    at = 0
    for s, p in zip(several, picked):
        marks[s][p[count[at:at + len(p)] > 1]] = True
        at += len(p)
    return marks


def _powers(base: int, n: int) -> np.ndarray:
    """The powers of an odd number from 0 to n - 1."""
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers, out=powers)


def _occurrences(data: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    """How many of the places hold the same string of bytes."""
    keys = []
    for base in (0xD6E8FEB86659FD93, 0xA24BAED4963EE407):  # three arrays of the data's length at most
        values = mix(np.arange(256, dtype=np.uint64) + np.uint64(base & 0xFF))[data]
        values *= _powers(base, len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        del values
        sums = total[places + window] - total[places]
        del total
        sums *= _powers(pow(base, -1, 1 << 64), len(data))[places]
        keys.append(mix(sums))
    order = np.lexsort(keys)
    a, b = keys[0][order], keys[1][order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    number = np.cumsum(new) - 1
    out = np.empty(len(places), np.int64)
    out[order] = np.bincount(number)[number]
    return out


def removed_bytes(df: DataFrame, length: int = BYTES) -> DataFrame:
    """doc_id, text and the spans of bytes that strings occurring twice or more cover."""
    unit = Unit(False, length, min(ROUTE, length))
    docs = keyed(df)
    return with_covered(docs, covered(docs, unit, lambda r, t, w: index_bytes(r, t, w, length)))


def dedup_texts(df: DataFrame, length: int = BYTES) -> DataFrame:
    """``df`` with the repeated bytes taken out of ``text`` (cut characters go whole), all columns
    kept; ``n_chars``, where there is one, follows."""
    unit = Unit(False, length, min(ROUTE, length))
    found = covered(keyed(df), unit, lambda r, t, w: index_bytes(r, t, w, length))
    spans = found.groupBy("key").agg(F.collect_set(F.struct("doc_id", "start", "end")).alias("_spans"))
    row, doc_id = F.struct(*df.columns).alias("row"), F.col("doc_id").alias("id")
    rows = df.select(row, doc_id, document_key(F.col("doc_id"), F.col("text")).alias("k")).join(
        spans, F.col("k") == F.col("key"), "left").select(
            *[F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(df.columns)],
            F.filter("_spans", lambda s: s.getField("doc_id").eqNullSafe(F.col("id"))).alias("spans"))
    at, width, names = df.columns.index("text"), len(df.columns), df.columns

    def run(batches):
        for batch in batches:
            for piece in slices(batch, at, SMALL_BYTES):
                texts = [None if t is None else _kept(t, s)[3].decode("utf-8", "ignore")
                         for t, s in zip(piece.column(at).to_pylist(), piece.column(width).to_pylist())]
                columns = [*piece.columns[:width]]
                columns[at] = pa.array(texts, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = rows.mapInArrow(give_back(run), df.schema)
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))
    return out


def _merge(spans) -> list[tuple[int, int]]:
    """The maximal runs that the spans cover; touching spans are one run."""
    out: list[list[int]] = []
    for s in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [(a, b) for a, b in out]


def _kept(text: str | None, spans) -> tuple[int, int, int, bytes]:
    data = (text or "").encode("utf-8")
    gone, parts, at = _merge(spans), [], 0
    for a, b in gone:
        parts.append(data[at:a])
        at = b
    kept = b"".join([*parts, data[at:]])
    return len(data), len(data) - len(kept), len(gone), kept


def _assemble(found: DataFrame, column: str, show) -> DataFrame:
    def run(batches):
        name, kind = column.split()
        for batch in batches:
            for piece in slices(batch, 1, SMALL_BYTES):
                rows = [_kept(t, s) for t, s in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist())]
                cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
                last = pa.array([show(r[3]) for r in rows], pa.binary() if kind == "binary" else pa.string())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), *cols, last], names=["doc_id", "n_bytes", "n_removed", "n_spans", name])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(give_back(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, {column}")


def dedup_documents(df: DataFrame, length: int = BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes."""
    return _assemble(removed_bytes(df, length), "kept binary", bytes)


def digest_documents(df: DataFrame, length: int = BYTES) -> DataFrame:
    """The same with the SHA-256 of the kept bytes."""
    return _assemble(removed_bytes(df, length), "kept_sha256 string", sha256_hex)
