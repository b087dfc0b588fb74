"""Merkle manifest, importance resampling and sharding against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from veil.llm import importance, merkle, places, sharding

LOWER = {c: c + 32 for c in range(65, 91)}


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    fields = (r.doc_id, r.source, r.lang, r.n_chars, text)
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields])


def tree(leaves):
    """Root, and for each leaf its (left, right) siblings level by level."""
    paths = [[] for _ in leaves]
    at = list(range(len(leaves)))
    nodes = leaves
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // 16 * 16:p // 16 * 16 + 16]
            paths[i].append(("".join(run[:p % 16]), "".join(run[p % 16 + 1:])))
            at[i] = p // 16
        nodes = [h(*nodes[k:k + 16]) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def manifest_by_brute_force(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subs = []
    for s in sources:
        by_source[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)))
        subs.append(tree([leaf_of(r, r.text) for r in by_source[s]]))
    root, ups = tree([x[0] for x in subs]) if subs else (None, [])
    out = []
    for s, (sub, paths), up in zip(sources, subs, ups):
        for r, path in zip(by_source[s], paths):
            path, leaf = path + up, leaf_of(r, r.text)
            folded = leaf
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
                folded = leaf_of(r, None if r.text is None else r.text.translate(LOWER))
            for left, right in path:
                folded = h(left, folded, right)
            out.append((r.doc_id, leaf, sub, root, h(*[x + y for x, y in path]), folded, folded == root))
    return out


def check_manifest(df):
    got = [tuple(r) for r in merkle.verified_documents(df).collect()]
    assert Counter(got) == Counter(manifest_by_brute_force(df.collect()))
    return got


def test_manifest_of_messy_documents(messy):
    assert {r[-1] for r in check_manifest(messy)} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 1], [600, 3, 1, 256, 257], [1] * 40, [4100]])
def test_manifest_of_many_shapes(make_documents, sizes):
    rows = [(100 * k + i, f"Text {i % 7}", "en", f"s{k}" if k else None) for k, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    check_manifest(make_documents(rows))


def test_manifest_of_equal_rows_and_of_nothing(make_documents):
    check_manifest(make_documents([(3, "Same", "en", "a")] * 500 + [(None, None, None, None)] * 30))
    assert merkle.verified_documents(make_documents([])).collect() == []


def test_manifest_and_proofs(messy):
    got = merkle.manifest(messy).collect()
    assert sum(r.rows for r in got) == messy.count() and len({r.root for r in got}) == 1
    rows = merkle.proofs(messy).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path")))
    assert rows.where("folded <> root").count() == 0 and rows.where("leaf <> claimed").count() == 0


def test_pointers_double(spark):
    """A chain of 11 nodes reaches its root in 4 rounds with the segments in order."""
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", [(f"l{i}", f"r{i}")]) for i in range(10)],
                                  "node string, up string, path array<struct<l: string, r: string>>")
    got = {r.node: (r.up, [x.l for x in r.path]) for r in merkle.jump(chain, "n10", 10).collect()}
    assert got == {f"n{i}": ("n10", [f"l{k}" for k in range(i, 10)]) for i in range(10)}


def test_places(spark):
    rows = [(random.Random(i).randrange(5) or None, i % 3) for i in range(400)] + [(9, 1)] * 300
    df = spark.createDataFrame(rows, "g int, v int").repartition(7).checkpoint()
    got = places.with_places(df, [F.col("v").desc()], "g").collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append((r.place, r.v, r.group_rows))
    for g, found in by.items():
        values = sorted((v for x, v in rows if x == g), reverse=True)
        assert [(p, v, n) for p, v, n in sorted(found)] == [(i, v, len(values)) for i, v in enumerate(values)]
    assert sorted(r.place for r in places.with_places(df, [F.col("v")]).collect()) == list(range(700))


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features_by_brute_force(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def resample_by_brute_force(rows, bench, buckets=10_000):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets
    found = [features_by_brute_force(t) for _, t in rows]
    s = Counter(bucket(f) for _, fs in found for f in fs)
    t = Counter(bucket(f) for x in bench for f in features_by_brute_force(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for (i, _), (words, fs) in zip(rows, found):
        w = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
                for b in map(bucket, fs))
        x = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = w + math.floor(-1000 * math.log(-math.log((x + 0.5) / 4294967296)))
        out.append([i, len(fs), w, score, None, len(words)])
    drawn = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(drawn[:5 * len(drawn) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


def test_resampling(spark, make_documents, messy):
    bench = [prose(9, 80), prose(4, 30).upper(), None, "", "ñandú-x 12"]
    target = spark.createDataFrame([(i, t, 0) for i, t in enumerate(bench)], "item_id int, text string, weight int")
    rows = [(100 + i, prose(i, 15 + i), "en", "a") for i in range(90)] + [(100, prose(0, 25), "en", "b")] * 40
    for df in (messy, make_documents(rows), make_documents(rows + [(None, None, None, None), (None, prose(3, 33), "x", "y")])):
        texts = [(r.doc_id, r.text) for r in df.collect()]
        assert Counter(map(tuple, importance.resample(df, target).collect())) == resample_by_brute_force(texts, bench)
    df = make_documents(rows)
    drawn = importance.resampled_documents(df, target, percent=20)
    ids = {r.doc_id for r in importance.resample(df, target, percent=20).collect() if r.rank}
    assert drawn.columns == df.columns and {r.doc_id for r in drawn.collect()} == ids
    assert importance.resample(make_documents([]), target).collect() == []
    none = importance.resample(df, target.where("false")).collect()
    assert len(none) == len(rows)


def test_features_across_blocks(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abÄ9") for _ in range(rng.choice((1, 3, 70, 300)))) for _ in range(rng.randrange(40)))
             for _ in range(60)] + ["", " .. ", "A"]
    want = [sorted((len(f.split(" ")), zlib.crc32(f.encode())) for f in features_by_brute_force(t)[1]) for t in texts]
    for block, piece in ((1 << 16, 1 << 20), (1, 1), (5, 64), (64, 5)):
        monkeypatch.setattr(importance, "BLOCK_WORDS", block)
        monkeypatch.setattr(importance, "PIECE", piece)
        got = [[] for _ in texts]
        for doc, crc, n in importance.features([t.encode() for t in texts], importance.Shifts()):
            for d, c in zip(doc.tolist(), crc.tolist()):
                got[d].append((n, c))
        assert [sorted(g) for g in got] == want


def test_shifts_cancel_prefixes():
    shifts, data = importance.Shifts(), bytes(random.Random(1).randbytes(5000))
    for a, b in ((0, 1), (17, 80), (1, 64), (3, 4999), (100, 163), (100, 164)):
        before, behind = (np.array([zlib.crc32(data[:x])], np.uint32) for x in (a, b))
        assert int((behind ^ shifts(before, np.array([b - a])))[0]) == zlib.crc32(data[a:b])


def jump_by_brute_force(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    known = [(1, 1, 0), (42, 57, 43), (0xDEAD10CC, 1, 0), (0xDEAD10CC, 666, 361), (256, 1024, 520)]
    for key, n, want in known:
        assert jump_by_brute_force(key, n) == want
        assert spark.range(1).select(sharding.jumps(F.lit(key).cast("long"), n)["shard"]).first()[0] == want
    keys = [random.Random(i).randrange(-(1 << 63), 1 << 63) for i in range(300)] + [0, -1, (1 << 63) - 1]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 40, 3000):
        got = df.select("k", sharding.jumps(F.col("k"), n)["shard"]).collect()
        assert all(s == jump_by_brute_force(k % (1 << 64), n) for k, s in got)


def test_more_steps_than_the_first(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_STEPS", 1)
    got = spark.range(200).select("id", sharding.jumps(F.col("id"), 40)["shard"]).collect()
    assert all(s == jump_by_brute_force(k, 40) for k, s in got)


@pytest.mark.parametrize("part", [1 << 16, 7])
def test_shards(make_documents, messy, monkeypatch, part):
    monkeypatch.setattr(sharding, "PART", part)
    rows = [(i, prose(i, 5 + i % 9), "en", "a") for i in range(300)] + [(5, "same", "en", "a")] * 100
    for df in (messy, make_documents(rows), make_documents([])):
        texts = [(r.doc_id, r.text or "") for r in df.collect()]
        got = sharding.shard_documents(df).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
            (i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts)
        slots = defaultdict(list)
        for r in got:
            key = int(h("-" if r.doc_id is None else str(r.doc_id))[:15], 16)
            assert (r.law, r.shard, r.grown_shard) == ("key", jump_by_brute_force(key, 40), jump_by_brute_force(key, 41))
            assert r.grown_shard in (r.shard, 40)
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert Counter(map(tuple, sharding.shard_documents(df.repartition(5)).collect())) == Counter(map(tuple, got))


def test_written_shards(spark, messy, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(messy, path, shards=4, files=2)
    back = spark.read.parquet(path)
    assert Counter(r[:13] for r in map(tuple, back.select(*messy.columns, "shard").collect())) == Counter(map(tuple, messy.collect()))
    assert {(r.doc_id, r.shard) for r in back.collect()} == {
        (r.doc_id, r.s) for r in messy.select("doc_id", sharding.shard_of(F.col("doc_id"), 4).alias("s")).collect()}
    with pytest.raises(ValueError):
        sharding.write_shards(messy.withColumn("shard", F.lit(1)), path)
