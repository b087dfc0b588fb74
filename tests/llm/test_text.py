"""Tokenizing, classifying, rules, search, mixing and the pipeline."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veil.llm import bpe, langid, maxscore, mixing, quality_gbdt, quality_rules, queries, toxicity
from veil.llm._common import Scratch, fold

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


ODD = ["Hello World's  THE\n12 a<|endoftext|>b é ñ #### don't ııİ ẞ", "naïve ﷺ \U0001F600 \x00\x07z <|startoftext|> <|x",
       "ΟΔΟΣ ΑΣ", "a\x1cb\x1d \x85c d　e​f", " '’s'S I'LL don'T", "각 é ́e", "٣٤ 12½²", "ǅ Å",
       "abcdefgh" * 400, "\U0001F600" * 200, "-=-=" * 100, "<|endoftext|>", "x <|endoftext|>"]


def test_bpe_equals_the_library(spark, make_documents, messy):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    df = messy.unionByName(make_documents([(100 + i, t, "en", "s") for i, t in enumerate(ODD)]))
    texts = defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        e = library.encode(r.text or "", add_special_tokens=False)
        ids = " ".join(map(str, e.ids))
        decoded = library.decode(e.ids, skip_special_tokens=False)
        texts[r.doc_id].append((len(e.ids), e.ids, decoded, hashlib.sha256(ids.encode()).hexdigest(),
                                hashlib.sha256(decoded.encode()).hexdigest()))
    for r in bpe.digest_documents(df, queries.tokenizer_path()).collect():
        n, _, _, a, b = texts[r.doc_id][0]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (n, a, b), r.doc_id
    for r in bpe.encode_documents(df, queries.tokenizer_path()).collect():
        assert (r.ids, r.decoded) == (texts[r.doc_id][0][1], texts[r.doc_id][0][2])


def test_bpe_tables_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_ROWS", 50)
    coder = bpe.ForcedBoundaryBpe(queries.tokenizer_path())
    fresh = bpe.ForcedBoundaryBpe(queries.tokenizer_path())
    for k in range(8):
        text = " ".join(f"word{k}x{i}" for i in range(40))
        assert coder.encode(text) == fresh.encode(text)
        assert len(coder.ids_of) <= 50


def test_empty_tables(spark, make_documents, labels):
    none = make_documents([])
    no_labels = labels.limit(0)
    assert bpe.digest_documents(none, queries.tokenizer_path()).collect() == []
    assert langid.language_ids(none).collect() == []
    assert quality_rules.quality_rules(none).collect() == []
    assert toxicity.toxicity_scores(none, no_labels).collect() == []
    assert quality_gbdt.quality_scores(none, no_labels).collect() == []
    assert mixing.mix_copies(none).collect() == []
    assert mixing.mixed_documents(none).collect() == []
    assert maxscore.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_language_on_held_out_documents(documents):
    got = langid.language_ids(documents).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == 1000 and (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_gradients():
    model = langid.ByteTagger(["a", "b", "c"])
    rng = np.random.default_rng(0)
    for p in model.parameters():
        p[...] = p.astype(np.float32)
    model.nets = [langid.Gru(n.e.astype(float), n.u.astype(float)) for n in model.nets]
    model.w, model.b = model.w.astype(float), model.b.astype(float)
    x, y, weight = rng.integers(0, 256, (7, 5)).astype(np.uint8), rng.integers(0, 3, 5), np.full((7, 5), 1 / 35)
    _, grads = model.gradients(x, y, weight)
    for p, g in zip(model.parameters(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, eps = p[at], 1e-3
        p[at] = old + eps
        up, _ = model.gradients(x, y, weight)
        p[at] = old - eps
        down, _ = model.gradients(x, y, weight)
        p[at] = old
        assert abs((up - down) / (2 * eps) - g[at]) < 1e-3 * max(1, abs(g[at]))


def test_language_scores_equal_plain_loops(messy):
    model = langid.ByteTagger(["de", "en", "fr"])  # random weights: any mistake in order or gates would show
    k = langid.HIDDEN

    def sigmoid(v):
        return 1 / (1 + math.exp(-v))

    def states(net, data):
        e, u, h, out = net.e.astype(float), net.u.astype(float), [0.0] * k, []
        for byte in data:
            b = [sum(h[i] * u[i, j] for i in range(k)) for j in range(3 * k)]
            z = [sigmoid(e[byte, j] + b[j]) for j in range(k)]
            r = [sigmoid(e[byte, k + j] + b[k + j]) for j in range(k)]
            c = [math.tanh(e[byte, 2 * k + j] + r[j] * b[2 * k + j]) for j in range(k)]
            h = [(1 - z[j]) * h[j] + z[j] * c[j] for j in range(k)]
            out.append(h)
        return out

    def plain(text):
        data, total = text.encode(), [0.0] * 3
        for at in range(0, len(data), langid.SPAN):
            span = data[at:at + langid.SPAN]
            padded = span + bytes(langid.SPAN - len(span))
            forth, back = states(model.nets[0], padded), states(model.nets[1], padded[::-1])[::-1]
            for f, g in list(zip(forth, back))[:len(span)]:
                a = [sum(v * float(model.w[i, j]) for i, v in enumerate(f + g)) + float(model.b[j]) for j in range(3)]
                top = max(a)
                p = [math.exp(v - top) for v in a]
                total = [t + v / sum(p) for t, v in zip(total, p)]
        return [t / len(data) for t in total]

    some = messy.where("doc_id in (1, 2, 3, 4, 6, 7, 18, 20)")
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in langid.label_documents(some, model).collect())
    want = []
    for r in some.collect():
        if not langid.has_letter(r.text):
            want.append((r.doc_id, "und", 0.0))
            continue
        p = plain(r.text)
        best = max(range(3), key=p.__getitem__)
        want.append((r.doc_id, model.classes[best], p[best]))
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
    assert np.allclose([g[2] for g in got], [w[2] for w in sorted(want)], atol=1e-4)


def test_models_on_messy_documents(messy, labels):
    n = messy.count()
    lang = langid.language_ids(messy).collect()
    assert len(lang) == n
    assert {r.lang_pred for r in lang if r.doc_id in (1, 2, 3)} == {"und"}
    tox = toxicity.toxicity_scores(messy, labels.where("doc_id < 0")).collect()
    assert len(tox) == n and all(0 <= r.score <= 1 and r.predicted == 0 for r in tox)
    quality = quality_gbdt.quality_scores(messy, labels.where("doc_id < 0")).collect()
    assert len(quality) == n and {r.score for r in quality} == {0.5}
    twice = labels.unionByName(labels).withColumn("text", F.lit("clash"))
    assert quality_gbdt.quality_scores(messy, twice).count() == n
    assert toxicity.toxicity_scores(messy, twice).count() == n


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    assert (toxic.predicted == 1).mean() > 0.8 and (clean.predicted == 1).mean() < 0.02


def _toxicity_model():
    bad, good = ["dreadful", "horrible"], ["pleasant", "wonderful", "morning", "garden", "window", "river"]
    texts = [f"{good[i % 6]} {good[(i + 1) % 6]} {bad[i % 2] if i % 3 == 0 else good[(i + 2) % 6]}" for i in range(240)]
    return toxicity.train(texts, np.array([float(i % 3 == 0) for i in range(240)]))


def test_toxicity_scores_equal_plain_loops(messy, make_documents):
    model = _toxicity_model()
    texts = messy.unionByName(make_documents([(200, "a horribel garden", "en", "a"), (201, "dreadful " * 30, "en", "a")]))
    assert model.slope[0] > 0 and model.embeddings.shape == (toxicity.BUCKETS, toxicity.WIDTH)  # the average counts

    def plain(text):
        vectors = []
        for w in sorted(toxicity.words(text)):
            buckets = toxicity.subwords([w])[0].tolist()
            vectors.append([sum(float(model.embeddings[b, k]) for b in buckets) / len(buckets)
                            for k in range(toxicity.WIDTH)])
        mean = [sum(v[k] for v in vectors) / max(len(vectors), 1) for k in range(toxicity.WIDTH)]
        document = sum(a * b for a, b in zip(mean, model.doc_weights)) + model.doc_bias
        margins = sorted((sum(a * b for a, b in zip(v, model.word_weights)) + model.word_bias for v in vectors), reverse=True)
        margins = [max(min(m, 20.0), -20.0) for m in margins[:toxicity.TOP]]
        margins += [toxicity.NO_WORD] * (toxicity.TOP - len(margins))
        z = sum(a * b for a, b in zip(model.slope, [document, *margins])) + model.offset
        return 1 / (1 + math.exp(-max(min(z, 30.0), -30.0)))

    want = sorted(((r.doc_id, plain(r.text)) for r in texts.collect()), key=str)
    got = sorted(((r.doc_id, r.score) for r in toxicity.score_documents(texts, model).collect()), key=str)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-6)
    same = model.word_vectors(["horrible", "garden"])
    assert np.allclose(toxicity.averages(same, np.array([2, 0])), [same.mean(0), np.zeros(toxicity.WIDTH)])


def test_strongest_words_with_ties_and_empty_documents():
    got = toxicity.strongest(np.array([1.0, 3.0, 3.0, 2.0, -50.0]), np.array([4, 0, 1]))
    assert got.tolist() == [[3.0, 3.0, 2.0], [-20.0] * 3, [-20.0] * 3]


def test_misspellings_share_subwords():
    model = _toxicity_model()
    seen = dict(zip(["horrible", "horribel", "horible", "garden"],
                    model.word_margins(["horrible", "horribel", "horible", "garden"])))
    assert min(seen["horrible"], seen["horribel"], seen["horible"]) > seen["garden"]


def test_quality_on_held_out_documents(documents, labels):
    got = quality_gbdt.quality_scores(documents, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.9


def test_forest_walk_equals_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    forest = quality_gbdt.train(x, ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float), trees=12)

    def plain(row):
        total = forest.bias
        for at in forest.roots:
            while forest.feature[at] >= 0:
                at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            total += forest.value[at]
        return total

    assert np.allclose(forest.logit(x), [plain(r) for r in x])
    assert ((forest.score(x) > 0.5) == ((x[:, 0] > 0) ^ (x[:, 1] > 0.3))).mean() > 0.95


def rules_by_brute_force(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    again = [False] * len(w)
    for i in range(len(w) - 4):
        if grams[tuple(w[i:i + 5])] > 1:
            again[i:i + 5] = [True] * 5
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(again),
            len(w) < 10 or 100 * sum(again) > 20 * len(w))


def test_quality_rules_on_messy_documents(messy):
    got = quality_rules.quality_rules(messy).collect()
    texts = {r.doc_id: r.text for r in messy.select("doc_id", "text").collect()}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                r.base_failed) == rules_by_brute_force(texts[r.doc_id])
        assert r.kept == (not r.base_failed and r.broken_rules == [])


def test_filters_extract_words_once(documents):
    rules = quality_rules.quality_rules(documents)
    for df in (rules, rules.where("kept"), rules.where("NOT base_failed AND n_repeat_words > 3").select("doc_id")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_quality_rules_keep_clean_documents(documents, labels):
    got = quality_rules.quality_rules(documents).join(labels, "doc_id").where("NOT base_failed").toPandas()
    assert got[got.quality == 1].kept.all()
    assert got[got.quality == 0].kept.mean() < 0.2


def top_by_brute_force(rows, every=50, k=5):
    usable = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(usable):
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for place, (j, v) in enumerate(usable)
                           if place != at and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [3, 4096])
def test_top_k_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(maxscore, "SHARD", shard)
    monkeypatch.setattr(maxscore, "BLOCK", 2)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=12)]) for i in range(40)]
    rows += [(50 + i, rows[i % 4][1]) for i in range(12)]  # ties
    rows += [(100, rows[0][1]), (150, None), (200, [None] * 12), (201, [float("nan")] * 12), (202, [float("inf")] * 12),
             (250, []), (300, [1.0, 2.0]), (301, [2.0, 1.0]), (350, [0.0] * 12), (400, [1e6] * 12), (401, [-1e6] * 12)]
    df = spark.createDataFrame([(i, v, 1, True) for i, v in rows],
                               "vec_id long, embedding array<double>, shard int, is_query boolean")
    assert sorted(tuple(r) for r in maxscore.top_k(df).collect()) == top_by_brute_force(rows)


@pytest.mark.parametrize("shard", [2, 4096])
def test_top_k_of_repeated_rows(spark, monkeypatch, shard):
    monkeypatch.setattr(maxscore, "SHARD", shard)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(30)]
    rows += [(50, rows[3][1])] * 9 + [(50, rows[4][1]), (100, rows[5][1]), (100, rows[5][1])] + [(22, rows[3][1])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(tuple(r) for r in maxscore.top_k(df).collect()) == top_by_brute_force(rows)


def test_top_k_reads_few_vectors():
    rng = np.random.default_rng(7)
    x = rng.integers(-256, 256, (2000, 32))
    shard = maxscore.Shard(np.arange(2000), x, np.ones(2000, np.int64))
    for query in (0, 50):
        ids, scores = shard.search(query, x[query], 5)
        want = sorted((-int(x[j] @ x[query]), j) for j in range(2000) if j != query)[:5]
        assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist())] == want
    at, component = shard.posting(3, -1.0)
    assert (component < 0).all() and set(at.tolist()) == set(np.flatnonzero(x[:, 3] < 0).tolist())
    assert len(shard.posting(3, 0.0)[0]) == 0


def test_samples_are_bounded_by_ids(spark):
    docs = spark.range(5000).selectExpr("id % 2 AS doc_id", "concat('text ', id) AS text", "'en' AS lang")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    got = quality_gbdt.labelled(docs, labels, "quality", F.lit(True), 10).collect()
    assert sorted(map(tuple, got)) == [(0, "text 0", 1.0), (1, "text 1", 0.0)]
    assert langid.fit(docs, sample_rows=10).classes == ["en"]


def targets_by_brute_force(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            open_.discard(s)
        left = 1.5 * sum(sizes.values()) - sum(target.values())


@pytest.mark.parametrize("table", ["messy", "documents"])
def test_mixing_targets(request, table):
    df = request.getfixturevalue(table)
    got = mixing.mix_copies(df).collect()
    assert len(got) == df.count()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken == r.copies * r.size and r.copies <= 2
    texts = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in df.select("doc_id", "text").collect())
    assert texts == Counter((r.doc_id, r.size) for r in got)
    want = targets_by_brute_force(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert Counter(map(tuple, mixing.mix_copies(df).collect())) == Counter(map(tuple, got))
    if table == "messy":  # rows equal in doc_id and text are drawn one by one above, together in the mix itself
        df = df.dropDuplicates(["doc_id", "text"])
        got = mixing.mix_copies(df).collect()
    copies = Counter(r.doc_id for r in mixing.mixed_documents(df).collect())
    assert copies == Counter({k: v for k, v in sum((Counter({r.doc_id: r.copies}) for r in got), Counter()).items() if v})


def test_tilts_meet_the_targets(spark):
    """Every document's rate is min(2, exp(tilt * size / longest)), and the rates' words are the target."""
    rng = np.random.default_rng(3)
    sizes = {"down": [int(x) for x in rng.lognormal(5, 1.5, 400) + 1], "up": [int(x) for x in rng.lognormal(4, 2, 300) + 1],
             "all": [3, 7], "one": [50], None: [1, 20000], "few": [5, 6, 7]}
    target = {"down": 0.03, "up": 1.97, "all": 2.0, "one": 0.4, None: 1.5, "few": 0.0}
    rows = [(s, n, Counter(v)[n]) for s, v in sizes.items() for n in set(v)]
    plans = [(s, sum(v), 1.0, target[s] * sum(v)) for s, v in sizes.items()]
    got = mixing.source_tilts(
        spark.createDataFrame(rows, "source string, size long, n long"),
        spark.createDataFrame(plans, "source string, source_size long, weight double, target double"), Scratch(spark)).collect()
    for r in got:
        if r.source == "few":
            assert r.tilt is None
            continue
        rates = [min(2.0, math.exp(min(r.tilt * n / r.longest, 50))) for n in sizes[r.source]]
        assert abs(sum(n * x for n, x in zip(sizes[r.source], rates)) - r.target) <= 1e-4 * r.target, r
        assert r.gap <= 1e-9
        if r.source in ("down", "up"):
            assert len(set(rates)) > 20


def test_mixing_repeated_rows(spark):
    """Equal rows are drawn one by one, so a source that is mostly one repeated row still meets its target."""
    rows = [(1, "ten words " * 5, "a")] * 100 + [(2, "two words", "a")] + [(3, "w " * 901, "b")] + [(None, "x y", "b")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_copies(df).collect()
    assert len(got) == len(rows)
    taken, target = defaultdict(int), {}
    for r in got:
        source = "a" if r.source_size == 1002 else "b"
        taken[source] += r.taken
        target[source] = r.target
        assert r.taken <= 2 * r.size
    assert abs(taken["a"] - target["a"]) <= 10 and abs(taken["b"] - target["b"]) <= 901
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_copies(df.repartition(7)).collect()))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want.fetchall())


def test_pipeline_stages(spark, documents):
    numbers = [name for name, _ in corpus_pipeline.STAGES]
    assert numbers == ["quality classifier", "MinHash near-dedup", "suffix-array dedup",
                       "mixing sources to target weights", "BPE encoding"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).checkpoint()
        assert out.schema.simpleString() == docs.schema.simpleString()
        if name != "mixing sources to target weights":
            assert 0 < out.count() <= seen
            seen = out.count()
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count()
    clean = spark.read.parquet(f"{sf}/labels.parquet").where(fold("doc_id", 5) == 0).where("quality = 1")
    first = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert first.join(clean, "doc_id").count() >= 0.9 * clean.count()
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in whole.collect()) == sorted(r.doc_id for r in last.collect())
