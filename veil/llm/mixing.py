"""Mixing sources to target weights by entropy balancing; DataFrame functions only.

Targets: every source's share of the mix by weight, capped at a multiple of the source's own words,
the excess shared again among the others. Rates: minimise the relative entropy of the documents' rates
against one copy each, subject to each source's words meeting its target and no rate above the cap. The
convex dual has one multiplier per source, and the rate of a document of n words is
``min(cap, exp(multiplier * n / longest))``: sources that give less than they have lose long documents first, sources
that give more repeat long documents first. A Newton step on the logarithm of the words taken needs two sums a
source over all documents; equal sizes of a source are counted once, then each step is an aggregate over
these counts. A step that leaves the bracket of the root is replaced by a cut of the bracket.

Rates are rounded into copies: the whole part for certain, and one more for the documents of the smallest ``u / f``
(u a hash in (0, 1), f the rest of the rate; a document then gets it with a chance near f) while a running total
stays within the target; then FILLS times the largest document that still fits. The total is taken over
ranges of that order, then over finer ranges of the one where it passes the target, so no task orders
a whole source. What remains is one row a source, which is joined to the documents.

The single-task windows see one row per source; sources are the settings of a mix, not data.

Defined results: a null text has size 0 and takes nothing; a null source is a source, sorted last;
rows with a null doc_id are documents like others; a source without words has target 0; an empty table gives an empty
table. Rows equal in doc_id, source and text are numbered and drawn one by one in ``mix_copies``;
``mixed_documents``, which carries other columns along, gives rows equal in doc_id and text equal copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.llm._common import WORD, Scratch, numbered_copies
from veil.session import ensure_checkpoint_dir

WEIGHTS, SHARE, CAP, FILLS = (5, 2, 1), 1.5, 2.0, 2

#: Newton steps at most (about ten do), and the relative distance from the target that ends them.
STEPS, NEAR = 100, 1e-9

#: Ranges of each of the two levels of the running total, as a power of two, and bits of a place in the order.
LEVEL, PLACE = 12, 48


def text_size(text: Column) -> Column:
    """Number of words: where a word begins, a character that isn't white space follows white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, weight, target from (source, size) rows.

    A source is capped when its part of what the not yet capped ones leave exceeds its cap. In the
    order of cap per weight the capped ones come first, so running sums find them.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", weight.alias("weight"))
    most = F.col("source_size") * cap
    before = Window.orderBy(most / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(
        Window.unboundedPreceding, -1)
    per = per.select(
        "*", (F.sum("source_size").over(whole) * share - F.coalesce(F.sum(most).over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weights"))
    open_ = most * F.col("weights") > F.col("left") * F.col("weight")
    # what the first source that stays below its cap finds is what all such sources share
    per = per.withColumn("rate", F.max(F.when(open_, F.col("left") / F.col("weights"))).over(whole))
    return per.select("source", "source_size", "weight",
                      F.when(open_, F.col("weight") * F.col("rate")).otherwise(most).alias("target"))


def _rate(size: Column, cap: Column) -> Column:
    """The tilted rate of a document with words, from its source's plan; 0 in a source that gives nothing."""
    tilt = F.col("tilt").cast("double")
    return F.coalesce(F.least(cap, F.exp(F.least(tilt * size / F.col("longest"), F.lit(50.0)))), F.lit(0.0))


def source_tilts(counts: DataFrame, targets: DataFrame, scratch: Scratch, cap: float = CAP) -> DataFrame:
    """targets with ``longest`` (size), ``tilt`` (the multiplier, null where nothing is taken) and ``gap`` (relative distance
    of the tilted words from the target). ``counts`` has source, size (over 0) and n, the documents of that size."""
    ends = counts.groupBy(F.col("source").alias("s")).agg(F.max("size").alias("longest"), F.min("size").alias("shortest"))
    words, target = F.col("source_size").cast("double"), F.col("target")
    highest = F.log(F.lit(float(cap))) * F.col("longest") / F.col("shortest") * 2  # every rate is at the cap
    full = target >= words * cap * (1 - 1e-12)
    some = (words > 0) & (target > 0)
    plan = targets.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select(
        *targets.columns, "longest", F.when(some, F.when(full, highest).otherwise(0.0)).alias("tilt"),
        F.when(target < words, F.lit(float("-inf"))).otherwise(0.0).alias("lo"),
        F.when(target < words, F.lit(0.0)).otherwise(highest).alias("hi"),
        F.when(some & ~full, F.lit(float("inf"))).otherwise(0.0).alias("gap"))
    plan = scratch.write(plan, "tilts")
    for _ in range(STEPS):
        if not plan.where(F.col("gap") > NEAR).limit(1).count():
            break
        after = scratch.write(_newton_step(counts, plan, cap), "tilts")
        scratch.drop(plan)
        plan = after
    # sums of doubles may differ in the last bits between runs; single precision hides that, rounding hits the target
    return plan.select(*targets.columns, "longest", F.col("tilt").cast("float").alias("tilt"), "gap")


def _newton_step(counts: DataFrame, plan: DataFrame, cap: float) -> DataFrame:
    """Sums of the tilted words and of their slope over all documents, then each source's next multiplier."""
    open_ = plan.where(F.col("gap") > NEAR).select(F.col("source").alias("s"), "longest", "tilt")
    rows = counts.join(open_, F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", _rate(F.col("size"), F.lit(float(cap))))
    tilted = F.col("n") * F.col("size") * F.col("rate")
    sums = rows.groupBy("s").agg(
        F.sum(tilted).alias("words"),
        F.sum(F.when(F.col("rate") < cap, tilted * F.col("size") / F.col("longest")).otherwise(0.0)).alias("slope"))
    words, x, target = F.col("words"), F.col("tilt"), F.col("target")
    lo = F.when(words < target, x).otherwise(F.col("lo"))
    hi = F.when(words > target, x).otherwise(F.col("hi"))
    newton = x - F.log(F.try_divide(words, target)) * F.try_divide(words, F.col("slope"))
    middle = F.when(F.col("lo2") >= 0, F.sqrt((F.col("lo2") + 1) * (F.col("hi2") + 1)) - 1).otherwise(
        F.when(F.col("lo2") == float("-inf"), F.col("hi2") * 2 - 1).otherwise((F.col("lo2") + F.col("hi2")) / 2))
    gap = F.abs(F.try_divide(words, target) - 1)
    return plan.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "*", lo.alias("lo2"), hi.alias("hi2"), newton.alias("next")).select(
        *[c for c in plan.columns if c not in ("tilt", "lo", "hi", "gap")],
        F.when(words.isNull() | (gap <= NEAR), x).when(
            (F.col("next") > F.col("lo2")) & (F.col("next") < F.col("hi2")), F.col("next")).otherwise(middle).alias("tilt"),
        F.coalesce("lo2", "lo").alias("lo"), F.coalesce("hi2", "hi").alias("hi"), F.coalesce(gap, "gap").alias("gap"))


def mix_plan(slim: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row a source: size, target, tilt, and up to which place of the source's order a document gets one
    copy more. ``slim`` has source, size and h, which fixes the order."""
    scratch = Scratch(slim.sparkSession)
    counts = scratch.write(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    targets = source_targets(counts.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, cap)
    used = counts.where(F.col("size") > 0)
    plan = source_tilts(used, targets, scratch, cap).withColumn("cap", F.lit(float(cap)))
    # what the whole copies take is certain; the rest of the target is the room of the order
    certain = used.join(plan.select(F.col("source").alias("s"), "longest", "tilt"), F.col("source").eqNullSafe(F.col("s"))
                        ).groupBy("s").agg(F.sum(F.col("n") * F.col("size") * F.floor(_rate(F.col("size"), F.lit(float(cap))))).alias("certain"))
    plan = plan.join(certain, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "longest", "tilt", "cap",
        (F.rint("target").cast("long") - F.coalesce("certain", F.lit(0))).alias("rest")).checkpoint()
    rows = _drawn(_joined(slim.select("source", "size", "h"), plan)).where("may").select(
        F.col("source").alias("s"), "size", "place", "b1", "b2")
    # first the range, then the finer range in which the running total passes the room that is left
    level1 = _edge(rows.groupBy("s", "b1").agg(F.sum("size").alias("w")), plan.withColumn("room", F.col("rest")), "b1", "e1")
    inside = rows.join(level1.select(F.col("source").alias("s1"), "e1"), F.col("s").eqNullSafe(F.col("s1"))
                       & (F.col("b1") == F.col("e1"))).select("s", "b2", "place", "size")
    level2 = _edge(inside.groupBy("s", "b2").agg(F.sum("size").alias("w")), level1, "b2", "e2")
    last = inside.join(level2.select(F.col("source").alias("s2"), "e2", "room"), F.col("s").eqNullSafe(F.col("s2"))
                       & (F.col("b2") == F.col("e2")))
    line = Window.partitionBy("s").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = last.withColumn("upto", F.sum("size").over(line)).where(F.col("upto") <= F.col("room")).groupBy("s").agg(
        F.max("place").alias("cut"))
    ends = level2.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(
        *plan.columns, "e1", "e2", "cut", F.array().cast("array<long>").alias("fills"))
    for _ in range(FILLS):
        ends = _fill(slim, ends.checkpoint())
    return ends


def _fill(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """One more document a source: the largest that the words still missing have room for."""
    rows = _drawn(_joined(slim.select("source", "size", "h"), plan)).where("may")
    used = rows.groupBy("_source").agg(F.sum(F.when(_extra(), F.col("size")).otherwise(0)).alias("used"))
    missing = plan.join(used, F.col("source").eqNullSafe(F.col("_source"))).select(
        *plan.columns, (F.col("rest") - F.col("used")).alias("gap"))
    rows = _drawn(_joined(slim.select("source", "size", "h"), missing.checkpoint())).where(
        F.col("may") & ~_extra() & (F.col("size") <= F.col("gap")))
    best = rows.groupBy(F.col("_source").alias("s")).agg(F.max(F.struct("size", "h")).alias("best"))
    return plan.join(best, F.col("source").eqNullSafe(F.col("s")), "left").select(
        *[c for c in plan.columns if c != "fills"],
        F.when(F.col("best").isNull(), F.col("fills")).otherwise(F.concat("fills", F.array("best.h"))).alias("fills"))


def _drawn(rows: DataFrame) -> DataFrame:
    """Rows joined to their plan with rate, whole copies, whether one more may come (``may``) and the place in the order."""
    rows = rows.withColumn("rate", F.when(F.col("size") > 0, _rate(F.col("size"), F.col("cap"))).otherwise(0.0))
    rows = rows.withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    u = (F.pmod("h", F.lit(1 << 52)) + 0.5) / float(1 << 52)
    place = F.floor(u / (u + F.col("part")) * float((1 << PLACE) - 1))
    rows = rows.withColumn("may", (F.col("part") > 0) & (F.col("whole") + 1 <= F.col("cap"))).withColumn("place", place)
    mask = (1 << LEVEL) - 1
    return rows.withColumn("b1", F.shiftright("place", PLACE - LEVEL)).withColumn(
        "b2", F.shiftright("place", PLACE - 2 * LEVEL).bitwiseAND(F.lit(mask)))


def _edge(sums: DataFrame, plan: DataFrame, bucket: str, name: str) -> DataFrame:
    """For every source the first bucket that the room doesn't hold whole, and the room left there
    (no bucket and so a number behind all if it holds all). A source has at most ``2 ** LEVEL`` rows."""
    line = Window.partitionBy("s").orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("w").over(line))
    first = (sums.join(plan.select("source", "room"), F.col("s").eqNullSafe(F.col("source")))
             .where(F.col("upto") > F.col("room"))
             .groupBy("s").agg(F.min(F.struct(bucket, (F.col("room") - F.col("upto") + F.col("w")).alias("left"))).alias("f")))
    return plan.withColumnRenamed("room", "_room").join(first, F.col("source").eqNullSafe(F.col("s")), "left").select(
        *[c for c in plan.columns if c != "room"], F.coalesce(F.col(f"f.{bucket}"), F.lit(1 << LEVEL)).alias(name),
        F.coalesce("f.left", F.lit(0)).alias("room"))


#: Sources up to which the plan is broadcast; a longer one is joined by a shuffle.
BROADCAST_SOURCES = 10_000


def _joined(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each row with its source's plan."""
    few = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    plan = plan.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("_source")))


def _extra() -> Column:
    """Whether a document that may get one copy more stands before its source's end, or was filled in."""
    b1, b2 = F.col("b1"), F.col("b2")
    before = (b1 < F.col("e1")) | ((b1 == F.col("e1")) & (
        (b2 < F.col("e2")) | ((b2 == F.col("e2")) & F.coalesce(F.col("place") <= F.col("cut"), F.lit(False)))))
    return before | F.array_contains("fills", F.col("h"))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each row (with source, size and h) with its source's figures, copies and taken words."""
    rows = _drawn(_joined(rows, plan))
    copies = (F.col("whole") + (F.col("may") & _extra()).cast("int")).cast("int")
    return rows.withColumn("copies", copies).withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))


def _place(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.cast("string"), text)


def mix_copies(df: DataFrame, **settings) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken words of every document."""
    ensure_checkpoint_dir(df.sparkSession)
    equal = df.select("doc_id", "source", text_size(F.col("text")).alias("size"),
                      _place(F.col("doc_id"), F.col("text")).alias("same")).groupBy(
        "doc_id", "source", "size", "same").agg(F.count(F.lit(1)).alias("n"))
    slim = numbered_copies(equal, "n", "number", deal=True).select(
        "doc_id", "source", "size", F.xxhash64("same", "number").alias("h")).checkpoint()
    plan = mix_plan(slim, **settings).checkpoint()
    return _with_plan(slim, plan).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def mixed_documents(df: DataFrame, **settings) -> DataFrame:
    """The mix itself: every document as often as it has copies, with all its columns. The texts stay
    where they are read; only the plan (one row a source) is brought to them."""
    ensure_checkpoint_dir(df.sparkSession)
    size = text_size(F.col("text")).alias("size")
    place = F.xxhash64(_place(F.col("doc_id"), F.col("text")), F.lit(0).cast("long")).alias("h")
    plan = mix_plan(df.select("source", size, place).checkpoint(), **settings).checkpoint()
    rows = df.select(F.struct(*df.columns).alias("row"), "source", size, place)
    out = _with_plan(rows, plan).where(F.col("copies") > 0)
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
