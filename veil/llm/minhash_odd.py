"""MinHash near-dedup verified through odd sketches.

Documents whose shingle sets are equal form one class (a 64-bit sum over the set decides), so groups
of copies cost one row from then on. A class has BANDS x ROWS MinHash values; classes that agree in a
band are candidates. Besides, the set's MinHash samples (the least hash of each of SAMPLES partitions)
are folded into an odd sketch: each sample flips one of BITS bits. The population count of two
sketches' XOR estimates the size of the sets' difference precisely where they are similar, so few
pairs below the threshold reach the exact comparison of full sets.

No bucket's pairs are listed. First each class of a bucket is paired with one center only (the same
for most buckets of a group). Confirmed links give components. Then, in buckets where components
still meet, sketches are compared across components, inside the task: first the most similar pair of a
class and another component leaves, then, after another confirmation, all pairs that may reach the
threshold and are not connected by then. So every pair of a bucket is either connected
already or compared, whatever the bucket's size. Members of one bucket are gathered as sketches, 256
bytes a class, in blocks: a large bucket's blocks meet pairwise, each pair in a group of its own, and the
largest component's members are never compared among themselves.

The band plan follows from the threshold: a pair right at it shares no band with probability MISS at
most (24 bands of 5 rows at 0.85, 27 of 4 at 0.8). The sketch test allows five standard deviations.

Buckets that hold the same classes as another one are left out. Texts move once: those of classes that
share a bucket with another one, brought to their class, serve every confirmation. Tables that
later steps read again are written to the scratch folder, and deleted when no step needs them any more.

Defined results: null and empty texts and texts without words have no shingles, are linked with
nothing and are their own component; fewer words than a shingle count as one shingle; equal rows are
linked; NULL ids never are a component's id unless it has no other; texts are read whole; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.llm._common import WORD, Scratch, give_back, slices, utf8
from veil.llm.places import bounded
from veil.llm.repeats import Unit, document_key, keyed, mix, run_hashes, symbols

SAMPLES, BITS = 1 << 16, 2048

#: Classes of a bucket that one group compares; a larger bucket is cut into blocks of about so many.
BLOCK = 4096

SIGMAS = 5.0

#: Chance that a pair at the threshold shares no band, and the most bands that a plan has.
MISS, BANDS = 1e-6, 28

#: Rows (two numbers each) up to which a list of classes or rows is broadcast.
FEW = 1_000_000

_U = np.uint64


def shingle_sets(blobs: list[bytes], width: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; A-Z count as a-z."""
    values, _, _, first = symbols([b.lower() for b in blobs], Unit(True, width, width))
    at = np.arange(max(len(values) - width + 1, 0))
    hashes = run_hashes(values, at, at + width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(hashes[a:b - width + 1]))
        elif b > a:
            out.append(run_hashes(values[a:b], np.array([0]), np.array([b - a])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def band_plan(percent: int) -> tuple[int, int]:
    """Number of bands and rows a band: the most rows with which BANDS bands are enough."""
    if not 0 < percent <= 100:
        raise ValueError("The threshold is a percentage above 0.")
    if percent == 100:
        return 1, 8
    best = None
    for rows in range(1, 17):
        shared = (percent / 100) ** rows
        count = math.ceil(math.log(MISS) / math.log1p(-shared))
        if best is None or count <= BANDS:
            best = count, rows
    return best


def _multipliers(count: int) -> np.ndarray:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * _U(2) + _U(1)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity bitmap of the partition-wise MinHash samples, as BITS / 64 words."""
    part = shingles >> _U(64 - (SAMPLES - 1).bit_length())
    least = shingles[np.r_[True, part[1:] != part[:-1]]] if len(shingles) else shingles
    flips = np.bincount((mix(least + _U(1)) % _U(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


def signatures(sets: list[np.ndarray], count: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Size, class, band hashes and odd sketch of each set."""
    n = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(n)
    bands = np.zeros((len(sets), count), np.uint64)
    node = np.zeros(len(sets), np.uint64)
    sketch = np.zeros((len(sets), BITS // 64), np.uint64)
    if len(full):
        values = np.concatenate([sets[i] for i in full])
        starts = np.cumsum(n[full]) - n[full]
        node[full] = mix(np.add.reduceat(mix(values), starts) + n[full].astype(np.uint64))
        least = np.empty((len(full), count * rows), np.uint64)
        for k, m in enumerate(_multipliers(count * rows)):
            np.minimum.reduceat(values * m, starts, out=least[:, k])
        for b in range(count):
            h = np.full(len(full), b + 1, np.uint64)
            for r in range(rows):
                h = mix(h * _U(0x9E3779B97F4A7C15) + least[:, b * rows + r])
            bands[full, b] = h
        for i in full:
            sketch[i] = odd_sketch(sets[i])
    return n, node, bands, sketch


def signature_table(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """key, doc_id, n, node, bands and sketch of every row of ``keyed`` documents."""
    count, band_rows = band_plan(percent)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, 2, 1 << 20):
                sets = shingle_sets(utf8(piece.column(2).to_pylist()), width)
                n, node, bands, sketch = signatures(sets, count, band_rows)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(n), pa.array(node.view(np.int64)),
                     pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())),
                     pa.array(list(sketch.view(np.int64)), pa.list_(pa.int64()))],
                    names=["key", "doc_id", "n", "node", "bands", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(give_back(run), f"key long, doc_id {kind}, n long, node long, bands array<long>, sketch array<long>")


def most_flips(n_a, n_b, threshold: float, exp, sqrt, least):
    """The largest XOR count that two sets at the threshold show, with a margin of SIGMAS deviations.

    Written over the given functions, so that columns and arrays share it.
    """
    both = n_a + n_b
    union = both / (1 + threshold)
    filled = SAMPLES * (1 - exp(-union / SAMPLES))  # partitions that hold anything
    shared = 1 - exp(-both / (2 * SAMPLES))  # a differing sample flips a second bit where both sets have one
    differ = (1 - threshold) * filled * (1 + shared)
    # samples are all of a small set, so only large sets vary here
    differ = differ + SIGMAS * sqrt(2 * differ * least(union / SAMPLES, 1.0)) + 2
    # flips that meet in one bit cancel: the count falls short of the samples, and varies
    return BITS / 2 * (1 - exp(-2 * differ / BITS)) + SIGMAS * sqrt(least(1.7 * differ * differ / BITS, BITS / 4))


def near_enough(n_a: Column, n_b: Column, flips: Column, threshold: float) -> Column:
    """Whether sizes and sketches allow the threshold."""
    sizes = F.least(n_a, n_b) >= threshold * F.greatest(n_a, n_b) - 1e-9
    return sizes & (flips <= most_flips(n_a.cast("double"), n_b.cast("double"), threshold, F.exp, F.sqrt,
                                        lambda x, y: F.least(x, F.lit(y))))


def flip_count(a: Column, b: Column) -> Column:
    return sum((F.bit_count(F.get(a, k).bitwiseXOR(F.get(b, k))) for k in range(BITS // 64)), F.lit(0))


def class_texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """node and text of the classes in ``needed`` (node, key): other texts stay where they are read, unless
    the list is too long to be brought to them."""
    return docs.join(bounded(needed, FEW), "key").select("node", "text").dropDuplicates(["node"])


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the threshold."""
    rows = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
            .select("a", "b", "text_a", "text_b"))

    def run(batches):
        for batch in batches:
            for piece in slices(batch, 2, 1 << 20):
                a = shingle_sets(utf8(piece.column(2).to_pylist()), width)
                b = shingle_sets(utf8(piece.column(3).to_pylist()), width)
                same = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)], np.int64)
                union = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64) - same
                ok = pa.array(100 * same >= percent * union)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).filter(ok), piece.column(1).filter(ok)], names=["a", "b"])

    return rows.mapInArrow(give_back(run), "a long, b long")


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node and label (the component's smallest node) of every node that has a link.

    Every node joins its smallest neighbour, links are renamed and loops dropped, until none is left;
    each round at least halves the nodes that still have links.
    """
    scratch = scratch or Scratch(links.sparkSession)
    left = scratch.write(links.where("a <> b").distinct(), "links")
    labels = scratch.write(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn(
        "label", F.col("node")), "labels")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("old"), F.least("a", "m").alias("new")), "to")
        next_labels = scratch.write(labels.join(to, F.col("label") == F.col("old"), "left").select(
            "node", F.coalesce("new", "label").alias("label")), "labels")
        next_left = scratch.write(
            left.join(to, F.col("a") == F.col("old")).select(F.col("new").alias("a"), "b")
            .join(to, F.col("b") == F.col("old")).select("a", F.col("new").alias("b"))
            .where("a <> b").distinct(), "links")
        scratch.drop(left, labels, to)
        left, labels = next_left, next_labels
    scratch.drop(left)
    return labels


def block_groups(places: DataFrame, labels: DataFrame, sketches: DataFrame) -> DataFrame:
    """The classes of every bucket in which components still meet, dealt into groups (band, i, j).

    A bucket of up to ``BLOCK`` classes is one group. A larger one is cut by a hash of node into blocks
    of about ``BLOCK``: first the blocks of the classes outside the largest component, then those of its
    members (``big``). Each of the former meets itself and every other block, so all pairs across
    components have a group, and the largest component is only streamed past the others.
    """
    placed = places.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    held = placed.groupBy("band", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("band").agg(
        F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("m"), F.count(F.lit(1)).alias("kinds"))
    others = F.col("m") - F.col("most.c")
    whole = F.col("m") <= BLOCK
    number = lambda n: F.when(whole, 1).otherwise(F.ceil(n / BLOCK)).cast("int")
    open_ = held.where("kinds > 1").select(
        "band", F.col("most.label").alias("_label"), whole.alias("_whole"), number(others).alias("_others"),
        number(F.col("most.c")).alias("_bigs"))
    h = F.xxhash64("node")
    big = F.col("label") == F.col("_label")
    of_big = F.when(F.col("_whole"), 0).otherwise(F.col("_others") + F.pmod(h, F.col("_bigs"))).cast("int")
    block = F.when(big, of_big).otherwise(F.pmod(h, F.col("_others"))).cast("int")
    last = F.when(F.col("_whole"), 0).when(F.col("big"), F.col("_others") - 1).otherwise(
        F.col("_others") + F.col("_bigs") - 1).cast("int")
    return (placed.join(open_, "band").withColumns({"big": big, "block": block}).join(sketches, "node")
            .withColumn("other", F.explode(F.sequence(F.lit(0), last)))
            .select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                    "block", "big", "node", "label", "n", "sketch"))


def _block_pairs(batches: Iterator[pa.RecordBatch], threshold: float, best: bool):
    """band, node, label of the other, flips and the other of pairs across components in each group of a
    partition sorted by group; with ``best`` only the most similar one of each class and component."""
    held: list[pa.Table] = []

    def pairs(rows: pa.Table):
        label, node, n, block = (rows.column(c).to_numpy() for c in ("label", "node", "n", "block"))
        big = rows.column("big").to_numpy(zero_copy_only=False)
        words = rows.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(rows), -1)
        apart = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
        for i in np.flatnonzero(~big).tolist():
            # members of the largest component, and of the others each pair once
            meets = big | (label > label[i])
            if apart:
                meets &= block != block[i]  # pairs within a block have a group of their own
            other = np.flatnonzero(meets)
            a, b = n[i], n[other]
            other = other[np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9]
            if not len(other):
                continue
            flips = np.bitwise_count(words[other] ^ words[i]).sum(1)
            limit = most_flips(float(a), n[other].astype(float), threshold, np.exp, np.sqrt, np.minimum)
            other, flips = other[flips <= limit], flips[flips <= limit]
            if best and len(other) > 1:
                order = np.lexsort((flips, label[other]))
                other, flips = other[order], flips[order]
                first = np.r_[True, label[other][1:] != label[other][:-1]]
                other, flips = other[first], flips[first]
            if len(other):
                yield pa.RecordBatch.from_arrays(
                    [rows.column("band").combine_chunks().take(pa.array(np.full(len(other), i))),
                     pa.array(np.full(len(other), node[i])), pa.array(label[other]),
                     pa.array(flips.astype(np.int64)), pa.array(node[other])],
                    names=["band", "node", "label", "flips", "other"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows = pa.concat_tables(held)
        group = [rows.column(c).to_numpy() for c in ("band", "i", "j")]
        cuts = [0, *(np.flatnonzero(np.any([np.diff(g) != 0 for g in group], axis=0)) + 1).tolist()]
        for x, y in zip(cuts, cuts[1:]):
            yield from pairs(rows.slice(x, y - x))
        held = [rows.slice(cuts[-1])]
    if held:
        yield from pairs(pa.concat_tables(held))


def meeting_pairs(groups: DataFrame, threshold: float, best: bool) -> DataFrame:
    """Pairs (a, b) across components that may reach the threshold; with ``best`` one for each class and
    other component of a bucket."""
    pairs = groups.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(
        give_back(lambda batches: _block_pairs(batches, threshold, best)),
        "band long, node long, label long, flips long, other long")
    if best:  # the blocks of a bucket each have found one
        pairs = pairs.groupBy("band", "node", "label").agg(F.min(F.struct("flips", "other")).alias("s")).select(
            "node", F.col("s.other").alias("other"))
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def open_places(nodes: DataFrame) -> DataFrame:
    """band, node and center (the same for all of a bucket) of every bucket with several classes; of buckets
    that hold the same classes, only one."""
    places = nodes.select("node", F.explode("bands").alias("band"))
    held = places.groupBy("band").agg(
        F.min_by("node", F.xxhash64("node")).alias("center"), F.count(F.lit(1)).alias("m"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    first = held.where("m > 1").groupBy("m", "x", "y").agg(F.min(F.struct("band", "center")).alias("f"))
    return places.join(first.select("f.band", "f.center"), "band")


def labelled(df: DataFrame, width: int, percent: int) -> DataFrame:
    """key, doc_id, n and label (its component, null without shingles) of every row."""
    scratch = Scratch(df.sparkSession)
    threshold = percent / 100
    docs = keyed(df)
    full = scratch.write(signature_table(docs, width, percent), "signatures")
    nodes = scratch.write(full.where("n > 0").groupBy("node").agg(
        F.min("key").alias("key"), F.first("n").alias("n"), F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch")), "nodes")
    rows = scratch.write(full.select("key", "doc_id", "n", "node"), "rows")
    scratch.drop(full)
    active = scratch.write(open_places(nodes), "places")
    met = active.select("node").distinct()
    sketches = scratch.write(nodes.join(met, "node").select("node", "key", "n", "sketch"), "sketches")
    scratch.drop(nodes)
    texts = scratch.write(class_texts(docs, sketches.select("node", "key")), "texts")
    pairs = active.where("node <> center").select(
        F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct()
    x = sketches.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    y = sketches.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    pairs = scratch.write(pairs.join(x, "a").join(y, "b").where(near_enough(
        F.col("n_a"), F.col("n_b"), flip_count(F.col("s_a"), F.col("s_b")), threshold)).select("a", "b"), "pairs")
    links = scratch.write(confirm(pairs, texts, width, percent), "links")
    scratch.drop(pairs)
    labels = components(links, scratch)
    # buckets in which different components still meet: first the most similar pairs, which join most of
    # what belongs together, then every pair across components that may reach the threshold
    for best in (True, False):
        more = scratch.write(meeting_pairs(
            block_groups(active.select("band", "node"), labels, sketches), threshold, best), "pairs")
        joined = scratch.write(links.unionByName(confirm(more, texts, width, percent)), "links")
        scratch.drop(more, links, labels)
        links = joined
        labels = components(links, scratch)
    scratch.drop(active, sketches, texts, links)
    return rows.join(labels, "node", "left").select(
        "key", "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label"))


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    of_row = labelled(df, width, percent)
    least = of_row.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"))
    out = of_row.join(least, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def kept_documents(df: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, with all columns: exactly one row of each component, the one with the
    smallest id (null last, then the smallest key), and every row without shingles.

    Rows are told apart by id and key, so neither shared nor null ids make them one document. What goes is
    a list of ids and keys; the texts stay where they are read unless that list is too long.
    """
    scratch = Scratch(df.sparkSession)
    own = F.struct("doc_id", "key").alias("own")
    same = scratch.write(labelled(df, width, percent).where("label IS NOT NULL").groupBy("label", own).agg(
        F.count(F.lit(1)).alias("m")), "classes")
    order = F.struct(F.col("own.doc_id").isNull().alias("none"), "own")
    first = same.groupBy("label").agg(F.min(order).alias("f")).select("label", F.col("f.own").alias("first"))
    judged = same.join(first, "label")
    gone = scratch.write(judged.where("NOT own <=> first").select(F.col("own").alias("gone")), "gone")
    # equal rows share id and key: one of them stays
    again = scratch.write(judged.where("own <=> first AND m > 1").select(F.col("own").alias("again")), "again")
    scratch.drop(same)
    text = F.col("text").cast("string")
    rows = df.select(F.struct(*df.columns).alias("row"), F.struct(
        "doc_id", document_key(F.col("doc_id"), text).alias("key")).alias("own"),
        F.coalesce(text.rlike(WORD), F.lit(False)).alias("worded"))
    worded = rows.where("worded").join(bounded(gone, FEW), F.col("own").eqNullSafe(F.col("gone")), "left_anti")
    kept = rows.where("NOT worded").select("row")
    if again.isEmpty():
        return kept.unionByName(worded.select("row")).select("row.*")
    twice = F.col("own").eqNullSafe(F.col("again"))
    return (kept.unionByName(worded.join(bounded(again, FEW), twice, "left_anti").select("row"))
            .unionByName(worded.join(bounded(again, FEW), twice, "left_semi").groupBy("own").agg(
                F.first("row").alias("row")).select("row")).select("row.*"))
