"""Repeated windows of a whole corpus: routing that both substring operators share.

A window is ``length`` consecutive symbols (words or bytes) of one text. Every window is routed by
its minimizer, the smallest hash among its runs of ``k`` symbols. Equal windows have equal
minimizers, so all occurrences of a window meet in one shard. Neighbouring windows with the same
minimizer travel as one segment of text.

1. Segments' minimizers are counted over the corpus; one seen once cannot hold a repeat.
2. Texts are cut again and the segments that are left travel to the shard of their minimizer,
   where the operator's index decides which windows occur twice.
3. Covered intervals return to their texts.

Hot passages: runs of symbols that are frequent in a hash sample of the texts count as hot and are
chosen only if a window has no other selected run. So windows that reach beyond a common passage are
dealt by what is beside it if a selected run is there. Windows whose minimizer is hot or not selected
never go to the shard of that minimizer: each is dealt by a 128-bit digest of its own symbols, which
decides whether it occurs twice. Equal segments are merged within each task before that (their
number is kept), so a window inside of the passage is one row a flush, and what is found returns by
a join on the segment's digest, which Spark can split. The sample only decides on routes: any choice of
hot runs gives the same result.

Rows are known by a hash of doc_id and text. Equal rows share it and get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.llm._common import documents, flat, give_back, slices, utf8
from veil.session import ensure_checkpoint_dir

#: One text in so many is looked at for hot runs; a run is hot from this share of the sample on.
SAMPLE, HOT_SHARE, HOT_LEAST = 64, 1 / 20000, 8

#: Text bytes cut into segments at once (so many that the arrays stay in a core's cache), and symbols of a
#: shard that are indexed together (a group of one minimizer is never divided).
PIECE, SHARD_SYMBOLS = 1 << 17, 100_000

#: Runs that are hashed at once.
BLOCK = 1 << 13

#: Windows of hot segments that a task merges before it lets them go.
FLUSH_WINDOWS = 200_000

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_P = 0xD6E8FEB86659FD93
_P_INVERSE = pow(_P, -1, 1 << 64)
_U = np.uint64


@dataclass(frozen=True)
class Unit:
    """What a window is made of: ``words`` or bytes, its length, and the length of a routing run."""

    words: bool
    length: int
    k: int

    @property
    def runs(self) -> int:
        return self.length - self.k + 1


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            for name, base in (("up", _P), ("down", _P_INVERSE)):
                a = np.full(m, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, from running sums of values times powers."""
    up, down = _POWERS.get(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def symbols(blobs: list[bytes], unit: Unit):
    """Hash (of bytes: the byte) and text place (start, end) of every symbol, and where each text's symbols begin."""
    if not unit.words:
        data, first = flat(blobs)
        return data, None, None, first
    data, starts = flat([b + b"\n" for b in blobs])
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    a, b = edge[0::2], edge[1::2]
    h = run_hashes(data.astype(np.uint64) + _U(1), a, b)
    first = np.searchsorted(a, starts)
    owner = np.repeat(np.arange(len(blobs)), np.diff(first))
    return h, a - starts[owner], b - starts[owner], first


def _block_hashes(values: np.ndarray, k: int, begin: int, end: int) -> np.ndarray:
    """The hashes of the runs of k symbols that begin from begin to end."""
    n = end - begin
    up, down = _POWERS.get(n + k)
    total = np.zeros(n + k, np.uint64)
    np.cumsum(values[begin:end + k - 1] * up[:n + k - 1], out=total[1:])
    h = total[k:] - total[:n]
    h *= down[:n]
    return mix(h)


def selected_runs(values: np.ndarray, unit: Unit, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and order of the selected runs of k symbols (1 in 4): top bits 0, or 1 for hot ones."""
    n = max(len(values) - unit.k + 1, 0)
    places, orders = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if len(hot):  # most runs are told from the hot ones by their leading bits
        maybe = np.zeros(1 << 16, bool)
        maybe[hot >> _U(46)] = True
    for begin in range(0, n, BLOCK):
        h = _block_hashes(values, unit.k, begin, min(begin + BLOCK, n))
        chosen = np.flatnonzero((h & _U(3)) == 0)
        few = h[chosen]
        few >>= _U(2)
        if len(hot):
            at = np.flatnonzero(maybe[few >> _U(46)])
            near = hot[np.minimum(np.searchsorted(hot, few[at]), len(hot) - 1)]
            few[at] |= (near == few[at]).astype(np.uint64) << _U(62)
        chosen += begin
        places.append(chosen)
        orders.append(few)
    return np.concatenate(places), np.concatenate(orders)


def smallest_runs(values: np.ndarray, unit: Unit, place: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and order of the runs that are the leftmost smallest one of some window.

    ``place`` and ``order`` hold the selected runs. Windows without one get all their runs, ordered behind the
    selected (top bits 2). A run between two better ones (to the left: equally good) that no window has room to
    avoid is never the smallest; such runs leave until none is left.
    """
    edge = np.concatenate([[-1], place, [max(len(values) - unit.k + 1, 0)]])
    gap = np.flatnonzero(np.diff(edge) > unit.runs)
    if len(gap):
        more, rest = [], []
        for begin, end in zip((edge[gap] + 1).tolist(), edge[gap + 1].tolist()):
            more.append(np.arange(begin, end))
            rest.append(_block_hashes(values, unit.k, begin, end) >> _U(2) | _U(2 << 62))
        at = np.searchsorted(place, np.concatenate(more))
        place, order = np.insert(place, at, np.concatenate(more)), np.insert(order, at, np.concatenate(rest))
    while len(place) > 2:
        falls = order[1:] < order[:-1]
        stay = np.ones(len(place), bool)
        stay[1:-1] = falls[:-1] | ~falls[1:] | (place[2:] - place[:-2] > unit.runs)
        keep = np.flatnonzero(stay)
        if len(keep) == len(place):
            break
        place, order = place[keep], order[keep]
    return place, order


def segments(blobs: list[bytes], unit: Unit, hot: np.ndarray):
    """Segments of all texts: text index, first window, number of windows, minimizer, whether the
    minimizer stands there more than once; then the words' places.

    The minimizer is the leftmost run of the smallest order: selected runs first, then hot ones, then the rest.
    """
    values, a, b, first = symbols(blobs, unit)
    place, order = smallest_runs(values, unit, *selected_runs(values, unit, hot))
    # windows that begin from low to high have this run as their minimizer: a better one takes over when it
    # comes in, another one when the run before has gone; a text's windows end inside of it
    turn = np.where(order[1:] < order[:-1], place[1:] - unit.runs, place[:-1]) + 1
    doc = np.searchsorted(first, place, side="right") - 1
    low = np.maximum(np.r_[0, turn][:len(place)], first[doc])
    high = np.minimum(np.r_[turn, len(values)][:len(place)], first[doc + 1] - unit.length + 1)
    some = np.flatnonzero(low < high)
    if not len(some):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), none.astype(bool), a, b, first
    value, doc, low, high = order[some], doc[some], low[some], high[some]
    new = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]) | (low[1:] != high[:-1])])
    begin, end = low[new], high[np.r_[new[1:], len(some)] - 1]
    parts = -(-(end - begin) // unit.runs)  # runs of windows with one minimizer, cut at each unit.runs windows
    number = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, end = np.repeat(begin, parts) + number * unit.runs, np.repeat(end, parts)
    end = np.minimum(end, begin + unit.runs)
    at = np.searchsorted(low, begin, side="right") - 1
    again = at != np.searchsorted(low, end - 1, side="right") - 1
    return doc[at], begin - first[doc[at]], end - begin, value[at], again, a, b, first


def document_key(doc_id: Column, text: Column) -> Column:
    """The hash that a row is known by."""
    return F.xxhash64(doc_id.cast("string"), F.coalesce(text, F.lit("")))


def keyed(df: DataFrame) -> DataFrame:
    """key, doc_id and text (null as empty)."""
    return documents(df).select(document_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id",
                                F.coalesce("text", F.lit("")).alias("text"))


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.uint64).view(np.int64))


def hot_runs(docs: DataFrame, unit: Unit) -> np.ndarray:
    """The sample's frequent selected runs, in order: at most 1 / HOT_SHARE of them."""
    none = np.zeros(0, np.uint64)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, 2, PIECE):
                values, _, _, _ = symbols(utf8(piece.column(2).to_pylist()), unit)
                order, count = np.unique(selected_runs(values, unit, none)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([_long(order), pa.array(count, pa.int64())], names=["run", "n"])

    sample = docs.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0).mapInArrow(give_back(run), "run long, n long")
    counts = sample.groupBy("run").agg(F.sum("n").alias("n"))
    counts = counts.where(F.col("n") >= HOT_LEAST)  # so the total below is that of the repeated runs
    total = sample.agg(F.sum("n")).first()[0] or 0
    got = counts.where(F.col("n") >= total * HOT_SHARE).select("run").collect()  # at most 1 / HOT_SHARE rows
    return np.sort(np.array([r.run for r in got], np.int64).view(np.uint64))


def repeated_minimizers(docs: DataFrame, unit: Unit, hot: np.ndarray) -> DataFrame:
    """key and the first windows of its segments whose minimizer the corpus holds twice or more."""
    def run(batches):
        for batch in batches:
            for piece in slices(batch, 2, PIECE):
                doc, start, _, value, again, _, _, _ = segments(utf8(piece.column(2).to_pylist()), unit, hot)
                plain = np.repeat(np.flatnonzero(value < _U(1 << 62)), 1 + again[value < _U(1 << 62)])
                keys = piece.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [_long(value[plain]), pa.array(keys[doc[plain]]), pa.array(start[plain].astype(np.int32))],
                    names=["run", "key", "start"])

    rows = docs.mapInArrow(give_back(run), "run long, key long, start int")
    seen = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("run"))).where(F.col("n") > 1)
    return seen.groupBy("key").agg(F.collect_set("start").alias("starts"))


def _cut(blobs: list[bytes], doc, start, count, a, b, first, unit: Unit) -> list[bytes]:
    """The text of each segment."""
    end = start + count + unit.length - 1
    if unit.words:
        return [blobs[d][x:y] for d, x, y in zip(doc.tolist(), a[first[doc] + start].tolist(),
                                                 b[first[doc] + end - 1].tolist())]
    return [blobs[d][x:y] for d, x, y in zip(doc.tolist(), start.tolist(), end.tolist())]


def _digest(segment: bytes) -> bytes:
    return hashlib.blake2b(segment, digest_size=16).digest()


def covered(docs: DataFrame, unit: Unit, index: Callable) -> DataFrame:
    """key, doc_id and the intervals (in symbols) that repeated windows cover.

    ``index(texts, weights)`` gets the distinct segments of some minimizers and how often each is
    held (2 stands for more); it returns, for each, a boolean array: which of its windows occur twice.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    hot = hot_runs(docs, unit)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):  # columns key, doc_id, text, starts
        for batch in batches:
            for piece in slices(batch, 2, PIECE):
                blobs = utf8(piece.column(2).to_pylist())
                doc, start, count, value, _, a, b, first = segments(blobs, unit, hot)
                lists = piece.column(3).to_pylist()
                wanted = np.concatenate([np.zeros(0, np.int64), *[np.array(x, np.int64) for x in lists]])
                wanted += np.repeat(np.arange(len(blobs)), [len(x) for x in lists]) << 40
                take = (value < _U(1 << 62)) & np.isin((doc.astype(np.int64) << 40) + start, wanted)
                if take.any():
                    d = doc[take]
                    yield pa.RecordBatch.from_arrays(
                        [_long(value[take]), pa.array(piece.column(0).to_numpy()[d]), piece.column(1).take(pa.array(d)),
                         pa.array(start[take].astype(np.int32)),
                         pa.array(_cut(blobs, d, start[take], count[take], a, b, first, unit), pa.binary())],
                        names=["run", "key", "doc_id", "start", "segment"])

    candidates = repeated_minimizers(docs, unit, hot)
    pieces = docs.join(candidates, "key").select("key", "doc_id", "text", "starts").mapInArrow(
        give_back(cut), f"run long, key long, doc_id {kind}, start int, segment binary")

    def decide(batches):
        for rows in _groups(batches):
            yield from _decide(rows, unit, index)

    direct = pieces.repartition("run").sortWithinPartitions("run").mapInArrow(
        give_back(decide), f"key long, doc_id {kind}, start int, end int")
    shared = repeated_hot_windows(docs, unit, hot)

    def hot_places(batches):
        for batch in batches:
            for piece in slices(batch, 2, PIECE):
                blobs = utf8(piece.column(2).to_pylist())
                doc, start, count, value, _, a, b, first = segments(blobs, unit, hot)
                far = value >= _U(1 << 62)
                if not far.any():
                    continue
                doc, start, count = doc[far], start[far], count[far]
                texts = _cut(blobs, doc, start, count, a, b, first, unit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(t) for t in texts], pa.binary()), pa.array(piece.column(0).to_numpy()[doc]),
                     piece.column(1).take(pa.array(doc)), pa.array(start.astype(np.int32))],
                    names=["digest", "key", "doc_id", "at"])

    places = docs.mapInArrow(give_back(hot_places), f"digest binary, key long, doc_id {kind}, at int")
    returned = places.join(shared, "digest").select(
        "key", "doc_id", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"))
    return direct.unionByName(returned)


def _windows(segment: bytes, unit: Unit) -> list[bytes]:
    """The digest of every window of a segment; words count without the white space between them."""
    if unit.words:
        words = segment.split()
        return [_digest(b" ".join(words[i:i + unit.length])) for i in range(len(words) - unit.length + 1)]
    return [_digest(segment[i:i + unit.length]) for i in range(len(segment) - unit.length + 1)]


def _settle(merged: dict[bytes, int], unit: Unit) -> pa.RecordBatch:
    """What a task says of the segments it has merged: rows (window, digest, start, end, n).

    Windows held twice here are settled: their segments' intervals leave without a window, and the window
    itself once, without a segment, for other tasks. Only windows held once leave with their place.
    """
    times: dict[bytes, int] = {}
    windows = {text: _windows(text, unit) for text in merged}
    for text, found in windows.items():
        for w in found:
            times[w] = times.get(w, 0) + merged[text]
    rows: list[tuple] = [(w, None, None, None, 2) for w, n in times.items() if n > 1]
    for text, found in windows.items():
        digest = _digest(text)
        begin = None
        for i, w in enumerate(found):
            if times[w] > 1:
                begin = i if begin is None else begin
                continue
            rows.append((w, digest, i, i + unit.length, 1))
            if begin is not None:
                rows.append((None, digest, begin, i - 1 + unit.length, 0))
                begin = None
        if begin is not None:
            rows.append((None, digest, begin, len(found) - 1 + unit.length, 0))
    kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      names=["window", "digest", "start", "end", "n"])


def repeated_hot_windows(docs: DataFrame, unit: Unit, hot: np.ndarray) -> DataFrame:
    """digest of a segment without a plain minimizer, and the intervals that its repeated windows cover."""
    def windows(batches):
        merged: dict[bytes, int] = {}
        held = 0
        for batch in batches:
            for piece in slices(batch, 2, PIECE):
                blobs = utf8(piece.column(2).to_pylist())
                doc, start, count, value, _, a, b, first = segments(blobs, unit, hot)
                far = value >= _U(1 << 62)
                texts = _cut(blobs, doc[far], start[far], count[far], a, b, first, unit)
                for text, c in zip(texts, count[far].tolist()):
                    held += c if text not in merged else 0
                    merged[text] = 2 if text in merged else 1
                    if held > FLUSH_WINDOWS:
                        yield _settle(merged, unit)
                        merged, held = {}, 0
        if merged:
            yield _settle(merged, unit)

    rows = docs.mapInArrow(give_back(windows), "window binary, digest binary, start int, end int, n int").checkpoint()  # read twice
    seen = rows.where("window IS NOT NULL").withColumn("n", F.sum("n").over(Window.partitionBy("window"))).where(
        (F.col("n") > 1) & F.col("digest").isNotNull())
    return rows.where("window IS NULL").unionByName(seen).select("digest", "start", "end").distinct()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups of a sorted partition, gathered up to SHARD_SYMBOLS bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for piece in slices(batch, 4):
            held.append(piece)
            size += piece.nbytes
            if size >= 8 * SHARD_SYMBOLS:
                rows = pa.Table.from_batches(held)
                runs = rows.column("run").to_numpy()
                cut = int(np.searchsorted(runs, runs[-1]))
                if cut:
                    yield rows.slice(0, cut)
                    rest = rows.slice(cut)
                    held, size = rest.to_batches(), rest.nbytes
                    size = 0 if size >= 8 * SHARD_SYMBOLS else size
                else:
                    size = 0  # one large group: look again after as much again
    if held:
        yield pa.Table.from_batches(held)


def _decide(rows: pa.Table, unit: Unit, index: Callable) -> Iterator[pa.RecordBatch]:
    runs, texts = rows.column("run").to_pylist(), rows.column("segment").to_pylist()
    place: dict[tuple, int] = {}
    owner = np.array([place.setdefault(x, len(place)) for x in zip(runs, texts)], np.int64)
    marks = index([r for r, _ in place], [t for _, t in place], np.minimum(np.bincount(owner), 2))
    spans = []
    for m in marks:
        edge = np.flatnonzero(np.diff(np.r_[False, m, False].astype(np.int8)))
        spans.append((edge[0::2], edge[1::2] + unit.length - 1))
    number = np.array([len(s[0]) for s in spans], np.int64)
    keep = np.flatnonzero(number[owner] > 0)
    if len(keep):
        many = number[owner[keep]]
        base = np.repeat(rows.column("start").to_numpy()[keep], many)
        yield pa.RecordBatch.from_arrays(
            [rows.column("key").combine_chunks().take(pa.array(np.repeat(keep, many))),
             rows.column("doc_id").combine_chunks().take(pa.array(np.repeat(keep, many))),
             pa.array((base + np.concatenate([spans[j][0] for j in owner[keep]])).astype(np.int32)),
             pa.array((base + np.concatenate([spans[j][1] for j in owner[keep]])).astype(np.int32))],
            names=["key", "doc_id", "start", "end"])


def with_covered(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Every row with its own intervals, as (doc_id, text, spans)."""
    spans = found.groupBy("key").agg(F.collect_set(F.struct("doc_id", "start", "end")).alias("spans"))
    joined = docs.join(spans, "key", "left")
    own = F.filter("spans", lambda s: s.getField("doc_id").eqNullSafe(F.col("doc_id")))
    return joined.select("doc_id", "text", F.transform(own, lambda s: F.struct(
        s.getField("start").alias("start"), s.getField("end").alias("end"))).alias("spans"))


def union_mask(n: int, spans: list[dict] | None) -> np.ndarray:
    """Which of n symbols some span covers."""
    step = np.zeros(n + 1, np.int32)
    if spans:
        np.add.at(step, [s["start"] for s in spans], 1)
        np.add.at(step, [s["end"] for s in spans], -1)
    return np.cumsum(step[:-1]) > 0
