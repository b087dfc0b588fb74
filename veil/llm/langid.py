"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

The network reads the UTF-8 bytes of a text in both directions, labels every position (a softmax
over both states) and pools the positions' probabilities into the document's. Long texts are cut
into spans of ``SPAN`` bytes that are read side by side, so that whole texts of any length cost the
same per byte; every byte is labelled. The weights are trained on the driver by backpropagation
through time on a bounded, documented sample: at most ``sample_rows`` documents, of each at most
``spans`` spans spread over the whole text. Scoring needs no shuffle.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any
labelled row every text is ``und``; equal probabilities go to the language that sorts first;
repeated rows get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.llm._common import bounded_sample, documents, fold, map_documents, one_text_an_id, utf8

SPAN, HIDDEN, LANES = 96, 12, 4096

_LETTER = regex.compile(r"\p{L}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


class Gru:
    """One direction: byte table ``e`` (256, 3h; bias included) and recurrent weights ``u`` (h, 3h).

    Gates: update z, reset r, candidate c; h' = (1 - z) h + z c with c = tanh(e_c + r * (h u_c)).
    """

    def __init__(self, e: np.ndarray, u: np.ndarray):
        self.e, self.u = e, u

    def run(self, x: np.ndarray, keep: list | None = None):
        """States after each row of ``x`` (positions, lanes); ``keep`` gathers what training needs."""
        k = self.u.shape[0]
        h = np.zeros((x.shape[1], k), np.float32)
        for row in x:
            a, b = self.e[row], h @ self.u
            zr = _sigmoid(a[:, :2 * k] + b[:, :2 * k])
            z, r, bc = zr[:, :k], zr[:, k:], b[:, 2 * k:]
            c = np.tanh(a[:, 2 * k:] + r * bc)
            new = h + z * (c - h)
            if keep is not None:
                keep.append((h, z, r, c, bc))
            h = new
            yield h

    def back(self, x: np.ndarray, keep: list, d_states: np.ndarray):
        """Gradients by backpropagation through time, given the gradient of every state."""
        k = self.u.shape[0]
        g_e, g_u = np.zeros_like(self.e), np.zeros_like(self.u)
        dh = np.zeros_like(d_states[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c, bc = keep[t]
            dh = dh + d_states[t]
            dz, dc = dh * (c - h) * z * (1 - z), dh * z * (1 - c * c)
            dr = dc * bc * r * (1 - r)
            da = np.concatenate([dz, dr, dc], 1)
            db = np.concatenate([dz, dr, dc * r], 1)
            for j in range(3 * k):
                g_e[:, j] += np.bincount(x[t], da[:, j], 256)
            g_u += h.T @ db
            dh = dh * (1 - z) + db @ self.u.T
        return g_e, g_u


class ByteTagger:
    """Both directions and the softmax at every position."""

    def __init__(self, classes: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        k, n = HIDDEN, max(len(classes), 1)
        self.classes = classes

        def new(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        self.nets = [Gru(new(256, 3 * k, scale=0.3), new(k, 3 * k, scale=0.3)) for _ in range(2)]
        for net in self.nets:
            net.e[:, :k] -= 1.0
        self.w, self.b = new(2 * k, n, scale=0.3), np.zeros(n, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.nets[0].e, self.nets[0].u, self.nets[1].e, self.nets[1].u, self.w, self.b]

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Loss and gradients of the mean cross-entropy over labelled positions; x is (positions, lanes)."""
        k = HIDDEN
        keeps: list[list] = [[], []]
        fwd = np.stack(list(self.nets[0].run(x, keeps[0])))
        bwd = np.stack(list(self.nets[1].run(x[::-1], keeps[1])))[::-1]
        s = np.concatenate([fwd, bwd], 2)
        z = s @ self.w + self.b
        z -= z.max(2, keepdims=True)
        p = np.exp(z)
        p /= p.sum(2, keepdims=True)
        lanes = np.arange(x.shape[1])
        loss = float((-np.log(p[:, lanes, y] + 1e-9) * weight).sum())
        d = p.copy()
        d[:, lanes, y] -= 1
        d *= weight[:, :, None]
        g_w, g_b = np.tensordot(s, d, ((0, 1), (0, 1))), d.sum((0, 1))
        ds = d @ self.w.T
        g0 = self.nets[0].back(x, keeps[0], ds[:, :, :k])
        g1 = self.nets[1].back(x[::-1], keeps[1], ds[::-1, :, k:])
        return loss, [*g0, *g1, g_w, g_b]

    def train(self, spans: list[bytes], y: np.ndarray, epochs: int = 6, batch: int = 256, rate: float = 0.02,
              seed: int = 5) -> None:
        if len(spans) == 0:
            return
        lengths = np.array([len(s) for s in spans])
        x = np.zeros((len(spans), SPAN), np.uint8)
        for i, s in enumerate(spans):
            x[i, :len(s)] = np.frombuffer(s, np.uint8)
        rng, ps = np.random.default_rng(seed), self.parameters()
        m, v, t = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps], 0
        for epoch in range(epochs):
            for rows in np.array_split(rng.permutation(len(spans)), max(1, len(spans) // batch)):
                if not len(rows):
                    continue
                weight = (np.arange(SPAN)[:, None] < lengths[rows][None, :]).astype(np.float32)
                weight /= max(weight.sum(), 1)
                _, gs = self.gradients(np.ascontiguousarray(x[rows].T), y[rows], weight)
                t += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in gs))
                step = rate * 0.5 ** (epoch // 2) * min(1.0, 1.0 / (norm + 1e-9))
                for i, (p, g) in enumerate(zip(ps, gs)):
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.01 * (g * g - v[i])
                    p -= (step * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.99 ** t)) + 1e-6)).astype(np.float32)

    def spans(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Per lane, the sum of its positions' probabilities; x is (positions, lanes)."""
        k, n = HIDDEN, len(self.classes)
        z = np.empty((*x.shape, n), np.float32)
        for t, h in enumerate(self.nets[0].run(x)):
            np.matmul(h, self.w[:k], out=z[t])
        total = np.zeros((x.shape[1], n))
        for t, h in zip(range(len(x) - 1, -1, -1), self.nets[1].run(x[::-1])):
            a = z[t] + h @ self.w[k:] + self.b
            a -= a.max(1, keepdims=True)
            np.exp(a, out=a)
            a /= a.sum(1, keepdims=True)
            a[t >= lengths] = 0
            total += a
        return total

    def pool(self, blobs: list[bytes]) -> np.ndarray:
        """Mean probability of each class over all positions of each text (0 for empty texts)."""
        counts = [-(-len(b) // SPAN) for b in blobs]
        owner = np.repeat(np.arange(len(blobs)), counts)
        out = np.zeros((len(blobs), len(self.classes)))
        if not len(owner):
            return out
        data = np.frombuffer(b"".join(b + b"\0" * (c * SPAN - len(b)) for b, c in zip(blobs, counts)), np.uint8)
        data = data.reshape(-1, SPAN)
        size = np.array([len(b) for b in blobs])
        first = np.cumsum(counts) - counts
        lengths = np.minimum(SPAN, size[owner] - (np.arange(len(owner)) - first[owner]) * SPAN)
        for a in range(0, len(owner), LANES):
            part = self.spans(np.ascontiguousarray(data[a:a + LANES].T), lengths[a:a + LANES])
            for j in range(out.shape[1]):
                out[:, j] += np.bincount(owner[a:a + LANES], part[:, j], len(blobs))
        return out / np.maximum(size, 1)[:, None]


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def fit(docs: DataFrame, learn: Column | None = None, sample_rows: int = 2048, spans: int = 4) -> ByteTagger:
    """Train on at most ``sample_rows`` labelled documents, ``spans`` spans spread over each. Rows that share a
    doc_id are one document: the smallest lang, and the smallest text in it."""
    ids = docs.select("doc_id", F.col("lang").cast("string").alias("lang"))
    picked = ids.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()
                       & (F.lit(True) if learn is None else learn))
    picked = bounded_sample(picked.groupBy("doc_id").agg(F.min("lang").alias("lang")), "doc_id", sample_rows)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for i, blob, lang in zip(b.column(0).to_pylist(), utf8(b.column(1).to_pylist()), b.column(2).to_pylist()):
                room = max(len(blob) - SPAN, 0)
                starts = sorted({room * k // max(spans - 1, 1) for k in range(spans)})
                rows += [(i, s, lang, blob[s:s + SPAN]) for s in starts if blob]
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary())],
                names=["doc_id", "at", "lang", "span"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    got = (one_text_an_id(texts.join(F.broadcast(picked), ["doc_id", "lang"]), "lang").select("doc_id", "text", "lang")
           .mapInArrow(run, f"doc_id {kind}, at long, lang string, span binary").collect())  # sample_rows * spans
    got = sorted((r.doc_id, r.at, r.lang, bytes(r.span)) for r in got)
    classes = sorted({g[2] for g in got})
    model = ByteTagger(classes)
    model.train([g[3] for g in got], np.array([classes.index(g[2]) for g in got], np.int64))
    return model


def label_documents(docs: DataFrame, model: ByteTagger) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    def make():
        def run(ids, texts):
            n = len(texts)
            if not model.classes:
                return ids, ["und"] * n, [0.0] * n
            p = model.pool(utf8(texts))
            best = p.argmax(1)
            ok = [has_letter(t) for t in texts]
            return (ids, [model.classes[k] if o else "und" for k, o in zip(best, ok)],
                    [min(float(p[i, k]), 1.0) if o else 0.0 for i, (k, o) in enumerate(zip(best, ok))])
        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_documents(docs, make, f"doc_id {kind}, lang_pred string, score double")


def language_ids(docs: DataFrame, modulus: int = 4, held: int = 2, sample_rows: int = 2048) -> DataFrame:
    """Label every document; ``lang`` of the held-out fold is not learned from."""
    model = fit(docs, fold("doc_id", modulus) != held, sample_rows)
    return label_documents(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
