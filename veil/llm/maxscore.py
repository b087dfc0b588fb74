"""Exact top-k search by inner product with MaxScore.

A component of a vector is a term: the posting of a term lists the vectors for which it adds to the
score, in order of their component. Equal rows are counted first; then candidates are dealt into shards of
about ``SHARD`` rows and queries into blocks of ``BLOCK`` rows; each pair of a shard and a block is one
group, so the work spreads and no side is broadcast. Within a shard, a query's terms are ordered by the most
that they can add there. The first ones, whose bounds alone lift a vector above the k-th best score known, are
essential: their postings are traversed and add up what a vector can gain. Vectors that gain too little to
compete are never looked at; for the others the essential terms are made exact, then the other terms are probed, a
few at a time, while partial score plus remaining bounds stays competitive. Shards are merged by rank.

Scores are exact integers (float64 sums are used only while all of them stay below 2**53).

Defined results: vectors that are null, or hold null, NaN or infinite components, take no part;
vectors of different lengths are not compared; equal scores go to the smaller vec_id; rows sharing a
vec_id are rows of their own: each is a query with its own k answers, and a candidate for all others, the ones with
its id included; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veil.llm._common import numbered_copies

SHARD, BLOCK, PROBE = 4096, 2048, 8


def integer_vectors(df: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and floor(scale * x) of every usable vector."""
    ok = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


class Shard:
    """Different integer vectors, how many rows each stands for, and their postings."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, copies: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, x, self.copies = ids[order], x[order], copies[order]
        top = int(np.abs(x).max(initial=0))
        self.exact_float = top * top * max(x.shape[1], 1) < 2 ** 52
        self.top = top
        self.x = x.astype(np.float64) if self.exact_float else x
        self.high, self.low = x.max(0, initial=-(1 << 62)), x.min(0, initial=1 << 62)
        self.postings = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T)  # of each term, by component
        self.values = np.ascontiguousarray(np.take_along_axis(x.T, self.postings, 1))
        self.below, self.upto = (x < 0).sum(0), (x <= 0).sum(0)  # where a posting's signs change

    def posting(self, term: int, weight: float) -> tuple[np.ndarray, np.ndarray]:
        """Vectors to which the term adds when its weight in the query is ``weight``, and their components."""
        part = slice(int(self.upto[term]), None) if weight > 0 else slice(0, int(self.below[term]) if weight < 0 else 0)
        return self.postings[term, part], self.values[term, part]

    def own(self, query: int, q: np.ndarray) -> int:
        """Place of the query's own vector, -1 if it is in another shard."""
        a, b = np.searchsorted(self.ids, [query, query + 1])
        at = np.flatnonzero((self.x[a:b] == q).all(1))
        return int(a + at[0]) if len(at) else -1

    def search(self, query: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows other than the query's own, best first."""
        n, d = self.x.shape
        x, ids = self.x, self.ids
        q = q.astype(x.dtype)
        own = self.own(query, q)
        banned = own if own >= 0 and self.copies[own] == 1 else -1

        def answer(rows: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            best = np.lexsort((ids[rows], -scores))[:k]
            best = np.repeat(best, np.minimum(self.copies[rows[best]] - (rows[best] == own), k))[:k]
            return ids[rows[best]], scores[best].astype(np.int64)

        everyone = np.flatnonzero(np.arange(n) != banned)
        if not n or not d:
            return answer(everyone, np.zeros(len(everyone), np.int64))
        bound = np.maximum(q * self.high.astype(x.dtype), q * self.low.astype(x.dtype))
        terms = np.argsort(-bound, kind="stable")
        rest = np.zeros(d + 1, x.dtype)  # the most that the terms from here on can add
        rest[:-1] = np.cumsum(bound[terms][::-1])[::-1]
        seeds = np.unique(np.concatenate([
            self.postings[t, -8 * k:] if q[t] > 0 else self.postings[t, :8 * k] for t in terms[:4]]))
        scores = np.sort(x[seeds[seeds != banned]] @ q)
        floor_ = scores[-k] if len(scores) >= k else -np.inf
        # a vector to which no essential term adds anything scores at most what the others can add
        essential = int(np.searchsorted(-np.maximum.accumulate(rest[::-1])[::-1], -floor_, side="right"))
        if essential > d:  # a score of nothing would do, so every vector competes
            return answer(everyone, x[everyone] @ q)
        essential = max(essential, 1)
        gain = np.zeros(n, x.dtype)
        for t in terms[:essential].tolist():
            at, component = self.posting(t, q[t])
            gain[at] += q[t] * component
        rows = np.flatnonzero((gain > 0) & (gain + rest[essential] >= floor_))
        rows = rows[rows != banned]
        partial = x[np.ix_(rows, terms[:essential])] @ q[terms[:essential]]
        at = essential
        while at < d:
            keep = partial + rest[at] >= floor_
            rows, partial = rows[keep], partial[keep]
            some = terms[at:at + PROBE]
            partial = partial + x[np.ix_(rows, some)] @ q[some]
            at += len(some)
            if len(partial) > k:  # rest of the terms may lower a score: only their least counts as certain
                least = np.minimum(q * self.high.astype(x.dtype), q * self.low.astype(x.dtype))[terms[at:]].sum()
                floor_ = max(floor_, np.partition(partial, -k)[-k] + least)
        return answer(rows, partial)


def top_k(df: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id ``every`` divides."""
    vectors = integer_vectors(df, scale)
    sizes = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    shards, blocks = max(1, -(-sizes.n // SHARD)), max(1, -(-sizes.q // BLOCK))
    h = F.xxhash64("vec_id", "v")
    shard, block = F.pmod(h, F.lit(shards)), F.pmod(F.shiftright(h, 20), F.lit(blocks))

    def upto(n: int):
        return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))

    def place(s, b, asked: bool):
        return F.struct(s.alias("shard"), b.alias("block"), F.lit(asked).alias("is_query"))

    candidate = F.transform(upto(blocks), lambda b: place(shard, b, False))
    asked = F.transform(upto(shards), lambda s: place(s, block, True))
    rows = vectors.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n")).select(
        "vec_id", "v", "n", h.alias("h"), F.size("v").alias("d"),
        F.explode(F.when(F.col("vec_id") % every == 0, F.concat(candidate, asked)).otherwise(candidate)).alias("p"))

    def run(table: pa.Table) -> pa.Table:
        d = table.column("d")[0].as_py()
        x = pc.list_flatten(table.column("v")).to_numpy().reshape(len(table), d)
        ids, n, h, is_query = (table.column(c).to_numpy() for c in ("vec_id", "n", "h", "is_query"))
        index = Shard(ids[~is_query], x[~is_query], n[~is_query])
        if index.exact_float and np.abs(x).max(initial=0) > index.top:  # a query larger than any candidate
            index.exact_float = float(np.abs(x).max()) * index.top * max(d, 1) < 2 ** 52
            index.x = index.x if index.exact_float else index.x.astype(np.int64)
        out: list[tuple] = []
        for query, key, rows_, q in zip(ids[is_query].tolist(), h[is_query].tolist(), n[is_query].tolist(), x[is_query]):
            got, score = index.search(query, q, k)
            out += [(query, key, rows_, i, s) for i, s in zip(got.tolist(), score.tolist())]
        columns = list(zip(*out)) or [[]] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "h", "n", "vec_id", "score"])

    found = rows.select("vec_id", "v", "n", "h", "d", "p.*").groupBy("shard", "block", "d").applyInArrow(
        run, "query_id long, h long, n long, vec_id long, score long")
    w = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
    best = found.select("query_id", F.row_number().over(w).alias("rank"), "vec_id", "score", "n").where(F.col("rank") <= k)
    return numbered_copies(best, "n").select("query_id", "rank", "vec_id", "score")
