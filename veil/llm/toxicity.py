"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the average of the embeddings of its character n-grams, its first letters and the whole word, so
a misspelling that shares n-grams with known words gets a near vector. A document's vector is the average of the
vectors of its words, and a linear softmax of two classes turns it into a margin. Embeddings and softmax weights
are trained together on the driver, on averages of documents and on single words at once, from a bounded sample
of labelled documents (``sample_rows``, half of them toxic if there are so many). One insult fades in the average of a
long text, so the margins of the TOP strongest words are further features of the document. Training of words
alternates: words of a toxic document that score low are taken out of its positives, words of clean documents
always are negatives. A last logistic step weighs the average's margin and the strongest words' margins; its offset
is set back from the sample's share of toxic documents to that of all labels.

Scoring keeps a bounded table of words already scored and needs no shuffle.

Defined results: null, empty and letterless texts score the probability of a document without any
word; without labels of both kinds every score is
next to 0 (1e-13); labels given twice for a document count as
their maximum; very long texts are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.llm._common import fold, map_documents
from veil.llm.quality_gbdt import labelled

BUCKETS, WIDTH, NGRAMS, PREFIXES, TOP = 1 << 18, 4, (3, 4, 5), (5, 6, 7, 8, 9), 3

#: A word counts as if PRIOR more documents of the usual toxicity held it; a subword is learned from
#: SHARED documents on.
PRIOR, SHARED = 2.0, 3

#: Words whose score a task keeps at hand.
TABLE_ROWS = 300_000

_WORDS = regex.compile(r"[\p{L}'@$]*\p{L}[\p{L}\p{N}'@$]*")


def words(text: str | None) -> set[str]:
    return set(_WORDS.findall(text.lower())) if text else set()


def _hash(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (a ^ (a >> np.uint64(29))) & np.uint64(BUCKETS - 1)


def subwords(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of every ``<word>``, and the index of its word."""
    marked = [f"<{w}>" for w in vocabulary]
    sizes = np.array([len(w) for w in marked])
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), sizes)
    buckets, owners = [], []
    for n in NGRAMS:
        if len(codes) < n:
            continue
        m = len(codes) - n + 1
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k:m + k]
        inside = owner[:m] == owner[n - 1:]
        buckets.append(_hash(h[inside]))
        owners.append(owner[:m][inside])
    first = np.cumsum(sizes) - sizes
    for n in PREFIXES:  # longer n-grams at the word's beginning, where stems stand
        long = np.flatnonzero(sizes >= n)
        h = np.full(len(long), 1000 + n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[first[long] + k]
        buckets.append(_hash(h))
        owners.append(long)
    h = np.zeros(len(marked), np.uint64)  # the whole word
    power = np.ones(int(sizes.max(initial=0)) + 1, np.uint64)
    power[1:] = np.uint64(0xD6E8FEB86659FD93)
    power = np.cumprod(power, dtype=np.uint64)
    if len(codes):
        place = np.arange(len(codes)) - np.repeat(first, sizes)
        h = np.add.reduceat(codes * power[place], first)
    buckets.append(_hash(h))
    owners.append(np.arange(len(marked)))
    b, o = np.concatenate(buckets).astype(np.int64), np.concatenate(owners)
    return b, o


class SubwordSoftmax:
    """Vectors of words, margins (toxic against clean) of words and documents, probabilities of documents.

    ``word_weights`` and ``doc_weights`` are the softmax's weights, toxic less clean, for a word's own vector and for
    the average of a document's; ``slope`` weighs a document's margin and its strongest words' margins.
    """

    def __init__(self, embeddings: np.ndarray, word_weights: np.ndarray, word_bias: float, doc_weights: np.ndarray,
                 doc_bias: float, slope: np.ndarray, offset: float):
        self.embeddings = embeddings.astype(np.float32)
        self.word_weights, self.word_bias = word_weights, word_bias
        self.doc_weights, self.doc_bias = doc_weights, doc_bias
        self.slope, self.offset = slope, offset

    def word_vectors(self, vocabulary: list[str]) -> np.ndarray:
        """Averages of the subwords' embeddings."""
        if not vocabulary:
            return np.zeros((0, self.embeddings.shape[1]))
        b, o = subwords(vocabulary)
        n = len(vocabulary)
        many = np.bincount(o, minlength=n)
        return np.stack([np.bincount(o, e, n) / many for e in self.embeddings[b].T], 1)

    def word_margins(self, vocabulary: list[str]) -> np.ndarray:
        return self.word_vectors(vocabulary) @ self.word_weights + self.word_bias

    def features(self, vectors: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """From the vectors of all documents' words in a row and each document's number of words: the margin of its
        average vector and the TOP largest margins of its words."""
        average = averages(vectors, sizes)
        margins = vectors @ self.word_weights + self.word_bias
        return np.concatenate([(average @ self.doc_weights + self.doc_bias)[:, None], strongest(margins, sizes)], 1)

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.slope + self.offset, -30, 30)))


#: Margin taken for each word that a document lacks.
NO_WORD = -20.0


def averages(vectors: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean vector of each document's words; zero for a document without words."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    total = np.stack([np.bincount(doc, v, len(sizes)) for v in vectors.T], 1)
    return total / np.maximum(sizes, 1)[:, None]


def strongest(margins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The TOP largest margins of each document, largest first."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((-margins, doc))
    place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # doc is ascending already
    out = np.full((len(sizes), TOP), NO_WORD)
    use = place < TOP
    out[doc[use], place[use]] = margins[order[use]]
    return np.clip(out, NO_WORD, -NO_WORD)


def train(texts: list[str | None], y: np.ndarray, rounds: int = 3, steps: int = 25, rate: float = 0.08,
          seed: int = 7, share: float | None = None) -> SubwordSoftmax:
    """Embeddings and softmax weights by Adam on three documents in four, their words and their averages; the rest
    fit the logistic step, so that words never seen count as they will when scoring."""
    if not len(y) or y.min() == y.max():
        return SubwordSoftmax(np.zeros((BUCKETS, WIDTH)), np.zeros(WIDTH), 0.0, np.zeros(WIDTH), 0.0,
                              np.zeros(1 + TOP), -30.0)
    all_bags, all_y = [sorted(words(t)) for t in texts], y
    rest = np.arange(len(y)) % 4 == 3
    if min((rest & (y > 0.5)).sum(), (rest & (y <= 0.5)).sum(), (~rest & (y > 0.5)).sum(), (~rest & (y <= 0.5)).sum()) < 2:
        rest[:] = False
    bags, y = [b for b, r in zip(all_bags, rest) if not r], y[~rest]
    vocabulary = sorted(set().union(*bags))
    index = {w: i for i, w in enumerate(vocabulary)}
    sizes = np.array([len(b) for b in bags])
    doc = np.repeat(np.arange(len(bags)), sizes)
    word = np.array([index[w] for b in bags for w in b], np.int64)
    n = len(vocabulary)
    b, o = subwords(vocabulary)
    many = np.bincount(o, minlength=n)[:, None].astype(np.float32)
    # what fewer than SHARED documents hold is noise: such n-grams and words keep a zero vector
    number = np.bincount(b, np.bincount(word, minlength=n)[o], BUCKETS)
    b, o = b[number[b] >= SHARED], o[number[b] >= SHARED]
    seen, b = np.unique(b, return_inverse=True)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (len(seen), WIDTH)).astype(np.float32)
    out = np.zeros((WIDTH, 2), np.float32)
    out[:, 1] = rng.normal(0, 0.5, WIDTH)
    out[:, 0] = -out[:, 1]
    bias = np.zeros(2, np.float32)
    doc_out, doc_bias = out.copy(), np.zeros(2, np.float32)
    toxic = y[doc] > 0.5
    clean = np.bincount(word[~toxic], minlength=n).astype(np.float32)
    positive = toxic.copy()
    params = (emb, out, bias, doc_out, doc_bias)
    state = [np.zeros_like(p) for p in params for _ in range(2)]
    share_of = (1 / np.maximum(sizes, 1))[doc]  # a word's part of its document's average
    t = 0
    order = np.argsort(b, kind="stable")
    bs, os_ = b[order], o[order]
    cuts = np.flatnonzero(np.r_[True, bs[1:] != bs[:-1]])

    def vectors() -> np.ndarray:
        return np.stack([np.bincount(o, emb[b, k], n) for k in range(WIDTH)], 1).astype(np.float32) / many

    for _ in range(rounds):
        bad = np.bincount(word[positive], minlength=n).astype(np.float32) + PRIOR * y.mean()
        total = np.bincount(word[positive], minlength=n) + clean + PRIOR
        weight = np.sqrt(total) / np.maximum(total, 1)  # a word's weight grows as the root of its documents
        for _ in range(steps):
            t += 1
            v = vectors()
            z = v @ out + bias
            p1 = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -30, 30)))
            d1 = weight * (p1 * total - bad) / np.sqrt(n)
            dz = np.stack([-d1, d1], 1).astype(np.float32)
            g_out, g_bias = v.T @ dz, dz.sum(0)
            average = averages(v[word], sizes)
            zd = average @ doc_out + doc_bias
            pd1 = 1 / (1 + np.exp(np.clip(zd[:, 0] - zd[:, 1], -30, 30)))
            dd = np.stack([y - pd1, pd1 - y], 1) / np.sqrt(len(bags))
            g_doc = (dd @ doc_out.T)[doc] * share_of[:, None]
            g_avg = np.stack([np.bincount(word, g, n) for g in g_doc.T], 1)
            per_word = ((dz @ out.T + g_avg) / many).astype(np.float32)
            grads = (np.add.reduceat(per_word[os_], cuts, axis=0), g_out, g_bias, average.T @ dd, dd.sum(0))
            for i, (p, g) in enumerate(zip(params, grads)):
                state[2 * i] += 0.1 * (g - state[2 * i])
                state[2 * i + 1] += 0.001 * (g * g - state[2 * i + 1])
                p -= rate * (state[2 * i] / (1 - 0.9 ** t)) / (np.sqrt(state[2 * i + 1] / (1 - 0.999 ** t)) + 1e-8)
        z = vectors() @ out + bias
        margin = z[:, 1] - z[:, 0]
        best = np.full(len(bags), -np.inf)
        np.maximum.at(best, doc, margin[word])
        positive = toxic & (margin[word] >= np.minimum(best[doc], np.maximum(best[doc] * 0.5, 0)))
    table = np.zeros((BUCKETS, WIDTH), np.float32)
    table[seen] = emb
    model = SubwordSoftmax(table, out[:, 1] - out[:, 0], float(bias[1] - bias[0]), doc_out[:, 1] - doc_out[:, 0],
                           float(doc_bias[1] - doc_bias[0]), np.zeros(1 + TOP), 0.0)
    held = [(b, v) for b, v, r in zip(all_bags, all_y, rest) if r] or list(zip(bags, y))
    x = model.features(model.word_vectors([w for b, _ in held for w in b]), np.array([len(b) for b, _ in held]))
    model.slope, model.offset = _logistic(x, np.array([v for _, v in held]))
    if share is not None:
        here = np.clip(all_y.mean(), 1e-6, 1 - 1e-6)
        model.offset += np.log(share / (1 - share)) - np.log(here / (1 - here))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[np.ndarray, float]:
    """Newton fit of P(y) = s(x @ slope + offset), slightly regularised; no slope is negative."""
    use = np.ones(x.shape[1], bool)
    while True:
        a = np.concatenate([x[:, use], np.ones((len(x), 1))], 1)
        w = np.zeros(a.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            g = a.T @ (p - y) + 1e-2 * w
            h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(a.shape[1])
            step = np.linalg.solve(h, g)
            w = w - np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-8:
                break
        if (w[:-1] >= 0).all():
            slope = np.zeros(x.shape[1])
            slope[use] = w[:-1]
            return slope, float(w[-1])
        use[np.flatnonzero(use)[w[:-1] < 0]] = False


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn: Column | None = None,
        sample_rows: int = 2048) -> SubwordSoftmax:
    """Train on at most ``sample_rows`` labelled documents."""
    usable = labels.where(F.lit(True) if learn is None else learn).where(
        F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    counts = usable.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) > 0).alias("toxic")).first()
    if not counts.toxic or counts.toxic == counts.n:
        return train([], np.zeros(0))
    toxic = min(counts.toxic, sample_rows // 2)
    sample = (labelled(docs, usable.where(F.col(label) > 0), label, F.lit(True), toxic)
              .unionByName(labelled(docs, usable.where(F.col(label) <= 0), label, F.lit(True), sample_rows - toxic)))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            bags = [" ".join(sorted(words(t))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(bags, pa.string())],
                                             names=["doc_id", "y", "bag"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sorted(sample.mapInArrow(run, f"doc_id {kind}, y double, bag string").collect())  # sample_rows at most
    got.sort(key=lambda r: zlib.crc32(str(r.doc_id).encode()))
    return train([r.bag for r in got], np.array([r.y for r in got]), share=counts.toxic / counts.n)


def score_documents(docs: DataFrame, model: SubwordSoftmax) -> DataFrame:
    """doc_id and score (0 to 1) of every document."""
    def make():
        known: dict[str, int] = {}
        table = np.zeros((0, WIDTH))

        def run(ids, texts):
            nonlocal table
            bags = [words(t) for t in texts]
            new = sorted(set().union(*bags) - known.keys())
            if len(known) + len(new) > TABLE_ROWS:
                known.clear()
                table = table[:0]
                new = sorted(set().union(*bags))
            known.update(zip(new, range(len(known), len(known) + len(new))))
            table = np.concatenate([table, model.word_vectors(new)])
            sizes = np.array([len(b) for b in bags], np.int64)
            at = np.fromiter((known[w] for b in bags for w in sorted(b)), np.int64, int(sizes.sum()))
            return ids, model.probability(model.features(table[at], sizes))
        return run

    return map_documents(docs, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, modulus: int = 3, held: int = 1,
                    sample_rows: int = 2048) -> DataFrame:
    """Score every document; labels of the held-out fold are not learned from."""
    model = fit(docs, labels, learn=fold("doc_id", modulus) != held, sample_rows=sample_rows)
    return score_documents(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
