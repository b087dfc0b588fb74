"""Substring, suffix-array and near-duplicate dedup against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veil.llm import fm_dedup, minhash_odd, queries, repeats, sa_dedup


def covered_by_brute_force(sequences, length):
    seen = Counter(tuple(s[i:i + length]) for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if seen[tuple(s[i:i + length])] > 1:
                gone[i:i + length] = [True] * length
        out.append(gone)
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()


def by_brute_force_words(rows, length=35):
    seqs = [(t or "").encode().split() for _, t in rows]
    return sorted(((i, len(w), sum(g), sha(b" ".join(x for x, y in zip(w, g) if not y)))
                   for (i, _), w, g in zip(rows, seqs, covered_by_brute_force(seqs, length))), key=str)


def by_brute_force_bytes(rows, length=200):
    seqs = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), b, g in zip(rows, seqs, covered_by_brute_force(seqs, length)):
        spans = sum(1 for k, x in enumerate(g) if x and not (k and g[k - 1]))
        out.append((i, len(b), sum(g), spans, sha(bytes(x for x, y in zip(b, g) if not y))))
    return sorted(out, key=str)


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_words_on_messy_documents(messy):
    got = sorted((tuple(r) for r in fm_dedup.digest_documents(messy).collect()), key=str)
    assert got == by_brute_force_words(pairs_of(messy))


def test_bytes_on_messy_documents(messy):
    got = sorted((tuple(r) for r in sa_dedup.digest_documents(messy).collect()), key=str)
    assert got == by_brute_force_bytes(pairs_of(messy))


@pytest.mark.parametrize("hot_least", [1, 8])
def test_hot_runs_do_not_change_results(make_documents, monkeypatch, hot_least):
    """With every run of the sample hot, all segments take the merged way."""
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    monkeypatch.setattr(repeats, "HOT_LEAST", hot_least)
    rng = random.Random(4)
    line = " ".join(f"w{i}" for i in range(45))
    rows = [(i, " ".join(f"v{rng.randrange(3000)}" for _ in range(rng.randrange(60))) + " " + line + " "
             + " ".join(f"u{rng.randrange(9)}" for _ in range(30)), "en", "s") for i in range(120)]
    df = make_documents(rows)
    assert sorted((tuple(r) for r in fm_dedup.digest_documents(df).collect()), key=str) == by_brute_force_words(pairs_of(df))
    assert sorted((tuple(r) for r in sa_dedup.digest_documents(df).collect()), key=str) == by_brute_force_bytes(pairs_of(df))


def test_empty_tables(make_documents):
    empty = make_documents([])
    assert fm_dedup.digest_documents(empty).collect() == []
    assert sa_dedup.digest_documents(empty).collect() == []
    assert sa_dedup.dedup_texts(empty).collect() == []
    assert minhash_odd.near_duplicates(empty).collect() == []


def test_texts_and_words_come_back(messy):
    words = {r.doc_id: r.kept for r in fm_dedup.dedup_documents(messy).collect()}
    assert words[4] == "one" and words[16] == "" and words[1] == ""
    out = sa_dedup.dedup_texts(messy)
    assert out.columns == messy.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text is None and rows[4].text == "one" and rows[9].n_chars == len(rows[9].text)
    kept = {r.doc_id: bytes(r.kept) for r in sa_dedup.dedup_documents(messy).collect()}
    assert all(kept[i].decode("utf-8", "ignore") == (r.text or "") for i, r in rows.items())


def test_suffix_array_by_grouping():
    rng = random.Random(1)
    for _ in range(800):
        k = rng.choice([1, 2, 3, 7])
        s = [rng.randrange(1, k + 1) for _ in range(rng.randrange(60))] + [0]
        assert sa_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("index, cut, lengths", [(fm_dedup.index_words, bytes.split, (2, 5, 8)),
                                                 (sa_dedup.index_bytes, list, (3, 7, 20))])
def test_shard_indexes(index, cut, lengths):
    rng = random.Random(2)
    for _ in range(150):
        vocabulary = [b"a", b"bb", b"c ", b"dd\n", b"e"][:rng.randrange(1, 6)]
        texts = list({b" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 40)))
                      for _ in range(rng.randrange(1, 9))})
        weights = np.array([rng.choice([1, 1, 2]) for _ in texts])
        length = rng.choice(lengths)
        seqs = [cut(t) for t in texts]
        seen = Counter()
        for s, w in zip(seqs, weights):
            for i in range(len(s) - length + 1):
                seen[tuple(s[i:i + length])] += w
        want = [[seen[tuple(s[i:i + length])] > 1 for i in range(len(s) - length + 1)] for s in seqs]
        got = index([0] * len(texts), texts, weights, length)
        assert [g.tolist() for g in got] == want


def near_by_brute_force(rows, width, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width
                    else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((d, len(sets[i]), least, d == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates_on_messy_documents(messy, width, percent):
    got = sorted((tuple(r) for r in minhash_odd.near_duplicates(messy, width, percent).collect()), key=str)
    assert got == near_by_brute_force(pairs_of(messy), width, percent)


def test_near_duplicate_families(make_documents):
    """Families whose members are near the threshold and linked through others only."""
    rng = random.Random(8)
    rows = []
    for f in range(4):
        base = [f"w{f}_{i}" for i in range(rng.choice([40, 120]))]
        for m in range(25):
            copy = list(base)
            for _ in range(rng.randrange(1, 5)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(10 ** 6)}"
            rows.append((100 * f + m, " ".join(copy), "en", "s"))
    df = make_documents(rows)
    got = sorted((tuple(r) for r in minhash_odd.near_duplicates(df, 3, 85).collect()), key=str)
    assert got == near_by_brute_force(pairs_of(df), 3, 85)


def test_one_document_of_each_group_stays(messy):
    out = minhash_odd.kept_documents(messy, 5, 80)
    assert out.columns == messy.columns
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and 7 in ids and 8 not in ids and 10 not in ids


def test_kept_documents_with_any_column_names(make_documents):
    names = ["_key", "_id", "_m", "own", "gone", "again", "worded", "key", "first", "node"]
    df = make_documents([(1, "one two three", "en", "a"), (2, "one two three", "en", "a"), (3, None, "en", "a")])
    df = df.select("doc_id", "text", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    out = minhash_odd.kept_documents(df, 5, 80)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_band_plans_miss_hardly_any_pair():
    assert minhash_odd.band_plan(85) == (24, 5)
    for percent in range(30, 100, 5):
        count, rows = minhash_odd.band_plan(percent)
        assert (1 - (percent / 100) ** rows) ** count <= minhash_odd.MISS and (count <= minhash_odd.BANDS or rows == 1)
    with pytest.raises(ValueError):
        minhash_odd.band_plan(0)


def test_odd_sketch_counts_differences():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 1 << 63, 600).astype(np.uint64) * np.uint64(2))
    for extra in (0, 5, 40):
        other = np.unique(np.r_[base[extra:], rng.integers(0, 1 << 63, extra).astype(np.uint64)])
        flips = int(np.bitwise_count(minhash_odd.odd_sketch(base) ^ minhash_odd.odd_sketch(other)).sum())
        assert flips <= 2 * extra and (flips > extra or not extra)


def test_registered_queries_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = pairs_of(spark.read.parquet(f"{sf}/documents.parquet"))
    assert sorted((tuple(r) for r in queries.op1_substring_dedup(spark, sf).collect()), key=str) == by_brute_force_words(rows)
    assert sorted((tuple(r) for r in queries.op6_suffix_array_dedup(spark, sf).collect()), key=str) == by_brute_force_bytes(rows)
    assert sorted((tuple(r) for r in queries.op10_near_dedup(spark, sf).collect()), key=str) == near_by_brute_force(rows, 3, 85)


def kept_by_brute_force(rows, width, percent):
    """(doc_id, text) of the rows that stay: one of each component, all without shingles."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return {g: [rows[i] for i in range(len(rows)) if group[i] == g] for g in group}


def check_kept(rows, out, width=5, percent=80):
    """One row of each component leaves, with the smallest id that is not null, and no other row."""
    left = Counter(out)
    for members in kept_by_brute_force(rows, width, percent).values():
        ids = [d for d, _ in members if d is not None]
        allowed = [m for m in members if m[0] == (min(ids) if ids else None)]
        got = [m for m in dict.fromkeys(allowed) if left[m]]
        assert got, members
        left[got[0]] -= 1
    assert not +left


def test_rows_with_null_or_shared_ids_stay(make_documents):
    """Different texts stay whatever their ids; a near copy leaves although another row with its id stays."""
    from tests.llm.conftest import prose

    a, b = prose(9, 300), prose(23, 80)
    rows = [(None, prose(50, 60)), (None, prose(61, 60)), (None, prose(72, 60)), (None, prose(72, 60)), (None, None),
            (None, ""), (3, prose(13, 70)), (3, prose(14, 70)), (1, a), (2, a + " tail"), (2, b), (4, b), (4, b),
            (5, ""), (5, " "), (6, "one two"), (6, "one two"), (7, prose(9, 300).upper())]
    df = make_documents([(i, t, "en", "s") for i, t in rows])
    out = minhash_odd.kept_documents(df, 5, 80)
    assert out.columns == df.columns
    check_kept(rows, pairs_of(out))


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    """No group holds much more than two blocks, and every pair across components meets in exactly one."""
    monkeypatch.setattr(minhash_odd, "BLOCK", 8)
    rng = np.random.default_rng(3)
    members = {1: 60, 2: 40, 3: 5}  # bucket: classes; node 1000 * bucket + i
    label = {1: lambda i: 0 if i < 45 else i, 2: lambda i: i, 3: lambda i: 0 if i < 4 else i}
    nodes = [(b, 1000 * b + i, 1000 * b + label[b](i)) for b, m in members.items() for i in range(m)]
    sketch = [int(x) for x in rng.integers(0, 1 << 62, 32)]
    places = spark.createDataFrame([(n, b) for b, n, _ in nodes], "node long, band long")
    labels = spark.createDataFrame([(n, x) for _, n, x in nodes if n != x], "node long, label long")
    sketches = spark.createDataFrame([(n, 100, sketch) for _, n, _ in nodes], "node long, n long, sketch array<long>")
    groups = minhash_odd.block_groups(places, labels, sketches)
    held = Counter((r.band, r.i, r.j) for r in groups.collect())
    assert max(held.values()) <= 4 * 8 and sum(1 for g in held if g[0] == 3) == 1
    assert sum(1 for g in held if g[0] == 1) > 10
    want = {(x, y) for b, x, p in nodes for c, y, q in nodes if b == c and x < y and p != q}
    got = Counter((r.a, r.b) for r in minhash_odd.meeting_pairs(groups, 0.8, False).collect())
    assert set(got) == want and set(got.values()) == {1}
    found = groups.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(
        lambda batches: minhash_odd._block_pairs(batches, 0.8, False),
        "band long, node long, label long, flips long, other long").count()
    assert found == len(want)
    best = minhash_odd.meeting_pairs(groups, 0.8, True).collect()
    assert 0 < len(best) <= len(want) and {(r.a, r.b) for r in best} <= want


def test_blocks_do_not_change_results(make_documents, monkeypatch):
    """A template family below the threshold, near copies and outsiders in the same buckets."""
    monkeypatch.setattr(minhash_odd, "BLOCK", 4)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for m in range(50):
        copy = list(base)
        for _ in range(1 if m < 20 else 4):
            copy[rng.randrange(60)] = f"z{rng.randrange(10 ** 6)}"
        rows.append((m, " ".join(copy), "en", "s"))
    df = make_documents(rows)
    got = sorted((tuple(r) for r in minhash_odd.near_duplicates(df, 3, 85).collect()), key=str)
    assert got == near_by_brute_force(pairs_of(df), 3, 85)


@pytest.mark.parametrize("unit", [repeats.Unit(True, 35, 8), repeats.Unit(False, 200, 32)])
def test_windows_at_the_edge_of_a_hot_passage_are_dealt(make_documents, monkeypatch, unit):
    """A passage in every text: no shard holds its edges, and no window is sent once a text."""
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    rng = random.Random(6)
    line = " ".join(f"w{i}" for i in range(90))
    n = 200
    rows = [(i, " ".join(f"v{rng.randrange(10 ** 6)}" for _ in range(40)) + " " + line + " "
             + " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(40)), "en", "s") for i in range(n)]
    docs = repeats.keyed(make_documents(rows)).coalesce(2)
    def index(runs, texts, weights):
        assert max(Counter(runs).values()) <= n // 4, "edges of the passage met in one shard"
        make = fm_dedup.index_words if unit.words else sa_dedup.index_bytes
        return make(runs, texts, weights, unit.length)

    assert repeats.covered(docs, unit, index).count() >= n
    hot = repeats.hot_runs(docs, unit)
    assert len(hot)
    blobs = [r[1].encode() for r in rows]
    doc, start, count, value, _, a, b, first = repeats.segments(blobs, unit, hot)
    far = value >= np.uint64(1 << 62)
    texts = repeats._cut(blobs, doc[far], start[far], count[far], a, b, first, unit)
    merged = Counter(texts)
    told = repeats._settle({t: min(c, 2) for t, c in merged.items()}, unit).to_pydict()
    assert max(Counter(w for w in told["window"] if w is not None).values()) == 1
    whole = Counter(w for t, c in merged.items() for w in repeats._windows(t, unit) for _ in range(min(c, 2)))
    assert max(whole.values()) > n // 2  # windows inside stand in most edge segments


@pytest.mark.parametrize("words", [True, False])
def test_segments_hold_every_window_under_its_smallest_run(monkeypatch, words):
    """Each window once, under the leftmost run of the smallest order, in blocks of any size."""
    monkeypatch.setattr(repeats, "BLOCK", 7)
    rng = random.Random(11)
    top = np.uint64(62)
    for _ in range(150):
        k = rng.choice([1, 2, 5])
        unit = repeats.Unit(words, k + rng.choice([0, 2, 12, 40]), k)
        vocabulary = [b"a", b"b ", b"c", b" ", b"dd\n", b"\xc3\xa4 "][:rng.randrange(2, 7)]
        blobs = [b"".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 30, 150])))
                 for _ in range(rng.randrange(1, 6))]
        values, _, _, first = repeats.symbols(blobs, unit)
        at = np.arange(max(len(values) - k + 1, 0))
        h = repeats.run_hashes(values, at, at + k)
        order = np.where(h & np.uint64(3), h >> np.uint64(2) | np.uint64(2) << top, h >> np.uint64(2))
        seen = np.unique(order[order < np.uint64(1) << top])
        hot = np.sort(np.array(rng.sample(seen.tolist(), len(seen) // 3), np.uint64))
        order = np.where(np.isin(order, hot), order | np.uint64(1) << top, order)
        want = {}
        for d in range(len(blobs)):
            for s in range(first[d], first[d + 1] - unit.length + 1):
                want[d, s - first[d]] = int(order[s:s + unit.runs].min()), s + int(order[s:s + unit.runs].argmin())
        got, before = {}, None
        for d, s, n, value, again in zip(*[x.tolist() for x in repeats.segments(blobs, unit, hot)[:5]]):
            assert 0 < n <= unit.runs and again == (want[d, s][1] != want[d, s + n - 1][1])
            assert before != (d, s, value), "cut without need"
            before = (d, s + n, value) if n < unit.runs else None
            for i in range(s, s + n):
                assert (d, i) not in got
                got[d, i] = value
        assert got == {w: value for w, (value, _) in want.items()}


def test_cutting_keeps_no_array_of_all_places():
    """Only selected runs are held for a text's whole length: places and order of 1 in 4, not of every byte."""
    rng = random.Random(3)
    blobs = [" ".join(f"w{rng.randrange(10 ** 5)}" for _ in range(2000)).encode() for _ in range(10)]
    unit = repeats.Unit(False, 200, 32)
    hot = np.arange(1, 500, dtype=np.uint64) << np.uint64(50)
    repeats.segments(blobs, unit, hot)
    tracemalloc.start()
    try:
        repeats.segments(blobs, unit, hot)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 24 * sum(map(len, blobs)), "arrays of every place"
