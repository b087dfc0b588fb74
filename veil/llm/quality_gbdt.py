"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed where a document is read (one pass over its bytes and words). Trees are
grown in numpy on the driver from a bounded sample of labelled documents (``sample_rows``, by lowest
hash of doc_id), each split chosen from per-bin sums of gradients and hessians. The forest is
flattened into arrays of features, thresholds, children and leaf values, which vectorised numpy
walks for all documents of a batch at once. No shuffle is needed to score.

Defined results: null and empty texts have all statistics 0 and get the forest's score for them;
without any usable label every score is 0.5; labels given twice for a document count as their
maximum; very long texts are measured whole; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.llm._common import (SMALL_BYTES, bounded_sample, documents, flat, fold, give_back, map_documents, one_text_an_id,
                              slices, utf8)

FEATURES = [
    "log_words", "mean_word_bytes", "longest_word", "distinct_words", "same_as_before", "upper", "digits", "symbols",
    "shouts", "stops", "other_punct", "high_bytes", "blank_share", "lines_per_word", "dup_lines", "distinct_pairs",
]

#: Byte classes: 1 upper, 2 lower, 3 digit, 4 white space, 5 symbol, 6 shout, 7 sentence mark, 8 other, 9 high.
_CLASS = np.zeros(256, np.uint8)
_CLASS[:] = 8
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 9
for _chars, _k in ((b" \t\n\r\x0b\x0c", 4), (b"#*$%&|<>", 5), (b"!?", 6), (b".,;:", 7)):
    _CLASS[list(_chars)] = _k


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    blobs = utf8(texts)
    data, starts = flat(blobs)
    n = len(blobs)
    kinds = np.zeros((n, 10))
    if len(data):
        owner = np.repeat(np.arange(n, dtype=np.int64) * 10, np.diff(starts))
        kinds = np.bincount(owner + _CLASS[data], minlength=10 * n).reshape(n, 10).astype(float)
    out = np.zeros((n, len(FEATURES)))
    for i, blob in enumerate(blobs):
        words = blob.split()
        if not words:
            continue
        m = len(words)
        lines = [x for x in blob.split(b"\n") if x.strip()]
        k = kinds[i]
        size = len(blob)
        pairs = len(set(zip(words, words[1:])))
        out[i] = (
            np.log1p(m), (size - k[4]) / m, max(map(len, words)), len(set(words)) / m,
            sum(map(bytes.__eq__, words, words[1:])) / m, k[1] / size, k[3] / size, k[5] / m, k[6] / m, k[7] / m,
            k[8] / m, k[9] / size, k[4] / size, len(lines) / m, 1 - len(set(lines)) / len(lines), (pairs + 1) / m)
    return out


class Forest:
    """Boosted trees as flat arrays: an inner node sends ``x[feature] <= threshold`` left."""

    def __init__(self, bias=0.0, roots=(), feature=(), threshold=(), left=(), right=(), value=()):
        self.bias = float(bias)
        self.roots = np.asarray(roots, np.int32)
        self.feature = np.asarray(feature, np.int32)
        self.threshold = np.asarray(threshold, float)
        self.left, self.right = np.asarray(left, np.int32), np.asarray(right, np.int32)
        self.value = np.asarray(value, float)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root, np.int32)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(inner, down, at)
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2,
          penalty: float = 1.0, least: float = 2.0) -> Forest:
    """Newton boosting of the logistic loss on binned features."""
    if not len(y):
        return Forest()
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    forest = dict(bias=np.log(share / (1 - share)), roots=[], feature=[], threshold=[], left=[], right=[], value=[])
    if y.min() == y.max():
        return Forest(bias=forest["bias"])
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    margin = np.full(n, forest["bias"])

    def node(**v) -> int:
        for key, default in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("value", 0.0)):
            forest[key].append(v.get(key, default))
        return len(forest["feature"]) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)

        def grow(rows: np.ndarray, level: int) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, None, None)
            if level < depth:
                for j in range(d):
                    b = binned[rows, j]
                    gl = np.cumsum(np.bincount(b, g[rows], bins + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], bins + 1))[:-1]
                    ok = (hl >= least) & (hs - hl >= least)
                    gain = np.where(ok, gl ** 2 / (hl + penalty) + (gs - gl) ** 2 / (hs - hl + penalty)
                                    - gs ** 2 / (hs + penalty), 0)
                    k = int(gain.argmax())
                    if gain[k] > best[0] and k < len(edges[j]):
                        best = (gain[k], j, k)
            if best[1] is None:
                v = -rate * gs / (hs + penalty)
                margin[rows] += v
                return node(value=v)
            _, j, k = best
            at = node(feature=j, threshold=edges[j][k])
            goes = binned[rows, j] <= k
            forest["left"][at] = grow(rows[goes], level + 1)
            forest["right"][at] = grow(rows[~goes], level + 1)
            return at

        forest["roots"].append(grow(np.arange(n), 0))
    return Forest(**forest)


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """At most ``rows`` documents with a usable label: (doc_id, text, y). The label side is cut first,
    so the joined side has a known bound; of rows that share a doc_id, the smallest text is learned from."""
    picked = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn)
              .groupBy("doc_id").agg(F.max(F.col(label).cast("double")).alias("y")))
    picked = bounded_sample(picked, "doc_id", rows)
    return one_text_an_id(documents(docs).join(F.broadcast(picked), "doc_id"), "y").select("doc_id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None,
        sample_rows: int = 8192) -> Forest:
    """Grow the forest from at most ``sample_rows`` labelled documents."""
    sample = labelled(docs, labels, label, F.lit(True) if learn is None else learn, sample_rows)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for b in slices(batch, 1, SMALL_BYTES):
                x = statistics(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sorted(sample.mapInArrow(give_back(run), f"doc_id {kind}, y double, x array<double>").collect())  # sample_rows at most
    if not got:
        return Forest()
    return train(np.array([r.x for r in got]), np.array([r.y for r in got]))


def score_documents(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id and score (0 to 1) of every document."""
    def make():
        def run(ids, texts):
            return ids, forest.score(statistics(texts))
        return run

    return map_documents(docs, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double", SMALL_BYTES)


def accepted_documents(df: DataFrame, forest: Forest, threshold: float = 0.3) -> DataFrame:
    """The rows of ``df`` that score ``threshold`` or more, with all columns and without a shuffle."""
    at = df.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch, at, SMALL_BYTES):
                ok = forest.score(statistics(piece.column(at).to_pylist())) >= threshold
                yield piece.filter(pa.array(ok))

    return df.mapInArrow(give_back(run), df.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, modulus: int = 5, held: int = 0,
                   sample_rows: int = 8192) -> DataFrame:
    """Score every document; labels of the held-out fold are not learned from."""
    forest = fit(docs, labels, learn=fold("doc_id", modulus) != held, sample_rows=sample_rows)
    return score_documents(docs, forest).select(
        "doc_id", F.coalesce(fold("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
