"""Importance resampling towards a target distribution over hashed n-grams.

Features are runs of one to ``MOST`` words, hashed into buckets by the CRC-32 of their bytes. A document is
scanned once: its words, joined by one space, go through a running CRC, which is kept at both ends of
each word. The CRC of any run follows from the two prefixes that it lies between: the earlier
prefix's CRC, shifted by the run's length (a multiplication over GF(2), here by tables for each
length), cancels out of the later one's. No run is ever cut out or hashed by itself.

Bucket counts of the corpus and the target are summed map-side to one row a bucket; a bucket's gain is the
log ratio of their smoothed shares, a document's weight the sum over its features. Gumbel noise from a
hash of the id turns the weights into scores whose highest ones are a sample without replacement;
places in that order come from a distributed sort.

Defined results: a null or empty text has no words, weight 0 and no rank; a null id stands as an empty one
in the noise and comes last among ties; repeated rows are rows of their own; long texts are read whole, in
blocks that keep two words of the one before; an empty table gives an empty table; an empty target counts
as zero everywhere; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm._common import slices, utf8
from veil.llm.places import with_places
from veil.llm.repeats import document_key, keyed
from veil.session import ensure_checkpoint_dir

BUCKETS, MOST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42

#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320

#: Words that are held before their features are counted, and bytes of a text split at once.
BLOCK_WORDS, PIECE = 1 << 16, 1 << 20

#: Lengths below this have a shift table of their own.
SHORT = 64


def _normal() -> bytes:
    """Every byte as itself, as a lowercase letter, or as a space."""
    table = bytearray(b" " * 256)
    for b in range(256):
        if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80:
            table[b] = b
        elif 0x41 <= b <= 0x5A:
            table[b] = b + 0x20
    return bytes(table)


NORMAL = _normal()


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit words, given by what it makes of each value of each of their four bytes."""
    return (tables[0][c & 0xFF] ^ tables[1][(c >> 8) & 0xFF] ^ tables[2][(c >> 16) & 0xFF] ^ tables[3][c >> 24])


def _identity() -> np.ndarray:
    return np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]


def _one_byte() -> np.ndarray:
    """The shift by one byte: eight divisions by x."""
    t = _identity()
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ (np.uint32(POLYNOMIAL) * (t & np.uint32(1)))
    return t


class Shifts:
    """Multiplication of CRCs by x ** (8 * length) over GF(2)."""

    def __init__(self):
        one = _one_byte()
        self.table = one[0]  # the CRC of single bytes
        short = [_identity()]
        for _ in range(SHORT - 1):
            short.append(_apply(one, short[-1]))
        self.short = np.stack(short).reshape(-1)
        self.doubled = [one]

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        at = np.minimum(length, SHORT - 1).astype(np.int64) << 10
        out = (self.short[at + (crc & 0xFF)] ^ self.short[at + 256 + ((crc >> 8) & 0xFF)]
               ^ self.short[at + 512 + ((crc >> 16) & 0xFF)] ^ self.short[at + 768 + (crc >> 24)])
        rest = np.flatnonzero(length >= SHORT)
        if len(rest):
            left = (length[rest] - (SHORT - 1)).astype(np.int64)
            c, k = out[rest], 0
            while left.any():
                if k == len(self.doubled):
                    self.doubled.append(_apply(self.doubled[-1], self.doubled[-1]))
                odd = (left & 1).astype(bool)
                c[odd] = _apply(self.doubled[k], c[odd])
                left >>= 1
                k += 1
            out[rest] = c
        return out

    def after_space(self, crc: np.ndarray) -> np.ndarray:
        """Running CRCs one space later."""
        r = ~crc
        return ~((r >> np.uint32(8)) ^ self.table[(r ^ np.uint32(0x20)) & np.uint32(0xFF)])


def _scan(blobs: list[bytes]) -> Iterator[tuple]:
    """For each stretch of a text: its number, and of every word the running CRC before the space that leads it,
    the running CRC behind it, and where it begins and ends among the normalised bytes."""
    for i, blob in enumerate(blobs):
        text = blob.translate(NORMAL)
        at = crc = place = 0
        while at < len(text):
            cut = text.find(b" ", at + PIECE)
            cut = cut if cut >= 0 else len(text)
            words = text[at:cut].split()
            at = cut
            if not words:
                continue
            led = [b" " + w for w in words]
            if not place:
                led[0] = words[0]
            before = crc
            crcs = [crc := zlib.crc32(w, crc) for w in led]
            prefixes = np.array([before, *crcs], np.uint32)
            size = np.fromiter(map(len, words), np.int64, len(words))
            begin = np.cumsum(size + 1) - size - 1 + (place + 1 if place else 0)
            yield i, prefixes[:-1], prefixes[1:], begin, begin + size
            place = int(begin[-1] + size[-1])


def features(blobs: list[bytes], shifts: Shifts, most: int = MOST) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(text number, CRC) of every run of 1 to ``most`` words, in blocks, with the runs' number of words."""
    held: list[tuple] = []
    words = old = 0

    def flush():
        doc = np.concatenate([np.full(len(h[1]), h[0], np.int64) for h in held])
        before, behind, begin, end = (np.concatenate([h[k] for h in held]) for k in range(1, 5))
        start = np.where(begin == 0, np.uint32(0), shifts.after_space(before))
        for n in range(1, most + 1):
            first = np.arange(max(old - n + 1, 0), len(doc) - n + 1)  # the last word is a new one
            last = first + n - 1
            first, last = (x[doc[first] == doc[last]] for x in (first, last))
            yield doc[first], behind[last] ^ shifts(start[first], end[last] - begin[first]), n
        keep = [doc[-(most - 1):], before[-(most - 1):], behind[-(most - 1):], begin[-(most - 1):], end[-(most - 1):]]
        keep = [x[keep[0] == doc[-1]] for x in keep]
        return (int(doc[-1]), *keep[1:])

    for stretch in _scan(blobs):
        held.append(stretch)
        words += len(stretch[1])
        if words >= BLOCK_WORDS:
            last = yield from flush()
            held, words, old = [last], 0, len(last[1])
    if words:
        yield from flush()


def bucket_counts(df: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; one row a bucket reaches the driver."""
    def run(batches):
        shifts, total = Shifts(), np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in slices(batch, 0):
                for _, crc, _ in features(utf8(piece.column(0).to_pylist()), shifts):
                    total += np.bincount((crc % np.uint32(buckets)).astype(np.int64), minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit])], names=["bucket", "n"])

    rows = df.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy(
        "bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the ratio of the smoothed shares of each bucket."""
    n = len(corpus)
    all_s, all_t = float(corpus.sum()) + n, float(target.sum()) + n
    return np.array([math.floor(1000 * math.log((float(t + 1) * all_s) / (float(s + 1) * all_t)))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(df: DataFrame, gain: np.ndarray) -> DataFrame:
    """key (a hash of id and text), doc_id, n_words, n_features and weight of every document."""
    buckets = len(gain)
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches):
        shifts = Shifts()
        for batch in batches:
            for piece in slices(batch, 2):
                m = piece.num_rows
                words, count, weight = (np.zeros(m, np.int64) for _ in range(3))
                for doc, crc, n in features(utf8(piece.column(2).to_pylist()), shifts):
                    own = np.bincount(doc, minlength=m)
                    count += own
                    if n == 1:
                        words += own
                    # sums of integers below 2 ** 53 are exact in doubles
                    weight += np.bincount(doc, gain[(crc % np.uint32(buckets)).astype(np.int64)], m).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(words), pa.array(count), pa.array(weight)],
                    names=["key", "doc_id", "n_words", "n_features", "weight"])

    return keyed(df).mapInArrow(run, f"key long, doc_id {kind}, n_words long, n_features long, weight long")


def ranked(df: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
           buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """key, doc_id, n_features, weight, score and rank (null if not drawn) of every document."""
    ensure_checkpoint_dir(df.sparkSession)
    gain = gains(bucket_counts(df, buckets), bucket_counts(target, buckets))
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))
    scored = weights(df, gain).withColumn("score", (F.col("weight") + noise).cast("long")).checkpoint()
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = eligible.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("key")]
    columns = ["key", "doc_id", "n_features", "weight", "score"]
    placed = with_places(eligible, order).select(
        *columns, F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
    return placed.unionByName(scored.where(F.col("n_words") < least_words).select(
        *columns, F.lit(None).cast("long").alias("rank")))


def resample(df: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every document."""
    return ranked(df, target, **settings).drop("key")


def resampled_documents(df: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of ``df`` that are drawn, with all columns; rows equal in id and text go together."""
    drawn = ranked(df, target, **settings).where(F.col("rank").isNotNull()).select(
        F.struct("key", "doc_id").alias("_drawn")).distinct()
    row = F.struct(*df.columns).alias("row")
    own = F.struct(document_key(F.col("doc_id"), F.col("text").cast("string")).alias("key"), "doc_id")
    return df.select(row, own.alias("_own")).join(
        drawn, F.col("_own").eqNullSafe(F.col("_drawn")), "left_semi").select("row.*")
