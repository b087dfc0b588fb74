"""Exact order statistics by radix selection.

Each round counts, for all columns at once, how many values fall into each digit of their column's
bracket, with the digit's least and greatest value. These counts are summed in every task before they are
shuffled, so a round moves at most columns x digits x tasks rows, whatever the table holds. The digit that
holds the wanted rank becomes the next bracket, from its least to its greatest value; a digit of one
value is the answer. Nothing is sorted or written.

Digits are equal parts of a bracket. Where that takes too few bits off the bracket (as seen by the numbers'
order-preserving 64-bit keys, their bit patterns), the next round's digits are binary exponents with
their signs; from then on the bracket lies within one exponent, where values are evenly spaced and each
round takes BITS bits off. That bounds the rounds by 64 / LEAST_BITS and a few more; most data takes two or three.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._util import local_frame

#: Bits that a round of equal parts resolves, and the fewest that it may take off before exponents are tried.
BITS, LEAST_BITS = 12, 6

_BRACKET = T.StructType([T.StructField(n, t) for n, t in (
    ("o", T.IntegerType()), ("b", T.IntegerType()), ("lo", T.DoubleType()), ("hi", T.DoubleType()),
    ("even", T.BooleanType()), ("r1", T.LongType()), ("r2", T.LongType()))])

#: Digits of exponents: floor(log2) of the smallest double is -1074; infinity gets one of its own.
_SMALLEST, _INFINITE = -1080, 1100


def key_of(x: float) -> int:
    """The bit pattern of a number as an integer, negated for negative ones: sorts as the numbers do."""
    size = struct.unpack(">q", struct.pack(">d", abs(x)))[0]
    return -size if x < 0 else size


def width(lo: float, hi: float) -> int:
    """How many bits it takes to tell the doubles of a bracket apart."""
    return (key_of(hi) - key_of(lo)).bit_length()


def digit_of(x: Column, lo: Column, hi: Column, even: Column, parts: int) -> Column:
    """A number that never falls as ``x`` rises from ``lo`` to ``hi``."""
    equal = F.floor((x - lo) / (hi - lo) * F.lit(float(parts)))
    exponent = F.least(F.floor(F.log2(F.abs(x))), F.lit(_INFINITE)) - F.lit(_SMALLEST)
    signed = F.when(x == 0, F.lit(0)).when(x < 0, -exponent).otherwise(exponent)
    return F.when(even, equal).otherwise(signed).cast("long")


def select_ranks(values: DataFrame, wanted: dict[int, tuple[int, int]],
                 bounds: dict[int, tuple[float, float]]) -> dict[tuple[int, int], float]:
    """The numbers at two ranks (from 0, the first not above the second) of each column.

    ``values`` has rows (o, x, c), c times the value x of column o, without nulls; ``wanted`` and ``bounds`` give each column's ranks, and its least
    and greatest value. Returns {(o, rank): number}.
    """
    found: dict[tuple[int, int], float] = {}
    # (o, least value, greatest value) -> rows below the bracket, ranks in it, whether equal parts come next
    open_ = {(o, *bounds[o]): (0, sorted(set(ranks)), True) for o, ranks in wanted.items()}
    while True:
        for (o, a, z), (_, ranks, _) in list(open_.items()):
            if a == z:
                found |= {(o, r): a for r in ranks}
                del open_[(o, a, z)]
        if not open_:
            return found
        asked = [(key, state, state[2] and math.isfinite(key[2] - key[1])) for key, state in open_.items()]
        table = [(o, b, a, z, even, ranks[0] - below, ranks[-1] - below)
                 for b, ((o, a, z), (below, ranks, _), even) in enumerate(asked)]
        brackets = F.broadcast(local_frame(values.sparkSession, table, _BRACKET))  # two a column at most
        inside = values.withColumnRenamed("o", "_o").join(
            brackets, (F.col("_o") == F.col("o")) & F.col("x").between(F.col("lo"), F.col("hi")))
        digit = digit_of(F.col("x"), F.col("lo"), F.col("hi"), F.col("even"), 1 << BITS)
        counted = inside.groupBy("b", "r1", "r2", digit.alias("digit")).agg(
            F.sum("c").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        # a bracket has some thousand digits at most
        line = Window.partitionBy("b").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        end = F.col("before") + F.col("n") - 1
        hit = counted.withColumn("before", F.coalesce(F.sum("n").over(line), F.lit(0))).where(
            F.col("r1").between(F.col("before"), end) | F.col("r2").between(F.col("before"), end)).collect()  # two a column
        open_ = {}
        for r in hit:
            (o, a, z), (below, ranks, _), even = asked[r["b"]]
            start = below + r["before"]
            slow = even and width(a, z) - width(r["least"], r["most"]) < LEAST_BITS
            open_[(o, r["least"], r["most"])] = start, [k for k in ranks if start <= k < start + r["n"]], not slow


def medians(values: DataFrame, sizes: dict[int, tuple[int, float, float]]) -> dict[int, float]:
    """The median of each column from its number of values, least and greatest one."""
    wanted = {o: ((n - 1) // 2, n // 2) for o, (n, _, _) in sizes.items()}
    found = select_ranks(values, wanted, {o: (a, z) for o, (_, a, z) in sizes.items()})
    return {o: (found[(o, a)] + found[(o, b)]) / 2 for o, (a, b) in wanted.items()}
